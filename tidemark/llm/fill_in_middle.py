"""Fill-in-the-middle transformation of whole texts, as a pipeline of Arrow kernels.

A text is cut into lines (its units). Two hashes of the document's id choose the cuts, two more
the form: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``. Per
batch, the units become list arrays, are flattened with the index of their text, get their
ordinals, are filtered by role, rebuilt as lists and joined. No Python runs per row, and a
batch covers a bounded number of bytes or one text.

Defined cases: a null text is an empty one. Empty texts and texts that hold a marker stay
plain, so that every output can be read back; ``restored`` rebuilds the exact text. A null
``doc_id`` is hashed as the text ''. Repeated rows give equal results; an empty table gives an
empty one. Other columns pass through; columns named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.words import pieces

# Fixed values of the query contract: markers, seed, and shares of 100.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
TRANSFORMED_IN_100, SPM_IN_100 = 100, 50

_BATCH_BYTES = 1 << 23
_NEW = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the id."""
    digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, index of each one's text, its ordinal there): lines with their line feeds."""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ordinal = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[parent]
    last = ordinal == sizes[parent] - 1
    ends = pc.if_else(pa.array(last), pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    units = pc.binary_join_element_wise(flat, ends, pa.scalar("", flat.type))
    real = ~last | (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
    return units.filter(pa.array(real)), parent[real], ordinal[real]


def _joined(units: pa.Array, parent: np.ndarray, chosen: np.ndarray, n_texts: int) -> pa.Array:
    """The chosen units of each text as one text."""
    counts = np.bincount(parent[chosen], minlength=n_texts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    lists = pa.LargeListArray.from_arrays(offsets, units.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.scalar("", units.type))


def _transform(in_100: int, spm_in_100: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", _BATCH_BYTES):
                texts = pc.fill_null(batch["text"], "").cast(pa.large_string())
                h = pc.list_flatten(batch["draws"]).to_numpy(zero_copy_only=False).reshape(-1, 4)
                units, parent, ordinal = _units(texts)
                n = np.bincount(parent, minlength=len(texts)).astype(np.int64)
                cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                role = (ordinal >= cuts[parent, 0]).astype(np.int8) + (ordinal >= cuts[parent, 1])
                prefix, middle, suffix = (_joined(units, parent, role == r, len(texts)) for r in range(3))

                plain = pc.equal(texts, "")
                for marker in (PREFIX, SUFFIX, MIDDLE):
                    plain = pc.or_(plain, pc.match_substring(texts, marker))
                plain = pc.or_(plain, pa.array(h[:, 2] % 100 >= in_100))
                spm = pa.array(h[:, 3] % 100 < spm_in_100)
                mark = {m: pa.scalar(m, pa.large_string()) for m in (PREFIX, SUFFIX, MIDDLE, "")}
                first = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, mark[""])
                second = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, mark[""])
                nothing = pa.scalar(None, pa.int64())
                new = {
                    "n": pa.array(n),
                    "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
                    "prefix_chars": pc.if_else(plain, nothing, pc.utf8_length(prefix)),
                    "middle_chars": pc.if_else(plain, nothing, pc.utf8_length(middle)),
                    "output": pc.if_else(plain, texts, pc.if_else(spm, second, first)).cast(pa.string()),
                }
                yield pa.RecordBatch.from_arrays([batch["row"], *new.values()], names=["row", *new])

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, in_100: int = TRANSFORMED_IN_100, spm_in_100: int = SPM_IN_100
) -> DataFrame:
    """``docs`` without ``text``, with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``."""
    others = [docs[c] for c in docs.columns if c != "text" and c not in _NEW]
    rows = docs.select(F.struct(*others).alias("row"), docs["text"].alias("text"), draws(docs["doc_id"], seed).alias("draws"))
    schema = StructType([rows.schema["row"]])
    for name, kind in _NEW.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(_transform(in_100, spm_in_100), schema).select("row.*", *_NEW)


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``output`` was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
    )


#: Twin of ``op13_fill_in_middle``.
ORACLE = rf"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h
    FROM documents
), drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
           CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
    FROM units
), cut AS (
    SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(u[greatest(a, b) + 1:], '') AS s,
           CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                     OR c >= {TRANSFORMED_IN_100} THEN 'plain' WHEN d < {SPM_IN_100} THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
