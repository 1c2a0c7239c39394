"""Line-level deduplication: lines that several documents hold stay in one of them.

The lines of all documents become rows of a 128-bit hash, the distinct documents of each
hash are counted with map-side combining, and hashes over the threshold meet the lines
again. Only hashes and positions are shuffled up to there; each text moves once, when its
dropped positions come home.

Defined cases: a null or empty text is one empty line. A key shorter than ``min_key_chars``
is never dropped. Rows that share a ``doc_id`` are one document (a line repeated only there
counts once) but are reassembled one by one. A null ``doc_id`` counts as no document and
holds no line first. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

#: Fixed value of the query contract: what is stripped at the ends of a line.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, min_docs: int = 2, min_key_chars: int = 10) -> DataFrame:
    """(doc_id, row_hash, pos) of every line to drop; ``row_hash`` tells the texts of one id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_key_chars).select(
        "doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    keyed = written(keyed, "lines")
    holders = keyed.where("doc_id IS NOT NULL").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = (
        holders.groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "first_doc")
    )
    # Written, so that both inputs of the join are plain scans and a hot line can be split.
    common = written(common, "common-lines")
    return (
        keyed.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .select("doc_id", "row_hash", "pos")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_key_chars: int = 10) -> DataFrame:
    """``docs`` with shortened ``text`` and the new columns ``n_lines`` and ``n_dropped``."""
    gone = (
        repeated_lines(docs, min_docs, min_key_chars)
        .groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"))
        .agg(F.collect_set("pos").alias("_gone"))
    )
    joined = docs.join(
        gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left"
    )
    others = [docs[c] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    # The lines are a column of their own: inside a lambda they would be split for every line again.
    split = joined.select(
        F.struct(*others).alias("row"), docs["text"].alias("whole"), _lines(docs["text"]).alias("lines"), gone["_gone"].alias("gone")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda i: F.element_at(F.col("lines"), i + 1)))
    )
    return split.select(
        "row.*",
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: Twin of ``op5_line_dedup`` on tables whose doc_ids are distinct.
ORACLE = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), common AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
    SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.first_doc <> k.doc_id AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
