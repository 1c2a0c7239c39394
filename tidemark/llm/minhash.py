"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Texts become sets of hashed word shingles. Equal sets are one class at once. Each class gets a
SuperMinHash signature: every element walks through its own permutation of the slots, and the
walk of a set stops as soon as all its slots are filled, since later steps only give larger
ranks. Slots are cut into bands; classes that agree on a band are candidates. Candidate
classes are brought together by the components of the band links, large components in pairs of
blocks, and in each task candidates are compared on their full sets, skipping pairs that
links found before already join. The components of the confirmed links are the result.

No pair is emitted: a task returns at most one link per class. With the default 25 bands of
5 slots, a pair of similarity 0.85 is missed with probability 4e-7, one of 0.8 with 5e-5.

Defined cases: a null text or one without words has an empty set and links with nothing. A
text of fewer words than a shingle is one shingle. Rows with the same ``doc_id`` are the same
node, so their links are shared; a null ``doc_id`` links with nothing, has a null component and
is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.llm import words
from tidemark.llm.common import written
from tidemark.llm.components import connected_components

BANDS, ROWS = 25, 5
#: A block of a large candidate group: as many shingles at most, on average.
BLOCK_SHINGLES = 400_000
BLOCK_CLASSES = 500

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of non-empty sets of 64-bit hashes: (sets, slots) of level and rank."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    filled = np.full((len(sets), slots), _EMPTY)
    order = None  # the permutations of the elements still walking
    for level in range(slots):
        if level:
            walking = (filled == _EMPTY).any(axis=1)[owner]
            if not walking.any():
                break
            if order is None or not walking.all():
                owner, element = owner[walking], element[walking]
                order = _start(len(walking), slots, pick) if order is None else order
                order = order[walking]
        draw = words.mix(element, 1000 + level)
        rank = draw >> np.uint64(32)
        pick = level + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(slots - level)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            row = np.arange(len(pick))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, level]
            order[:, level] = slot
        value = rank | np.uint64(level << 32)
        np.minimum.at(filled.reshape(-1), owner * slots + slot, value)
    return filled


def _start(n: int, slots: int, first: np.ndarray) -> np.ndarray:
    """The permutations after the first swap of each."""
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots < 256 else np.uint16), (n, 1))
    order[np.arange(n), first] = 0
    order[:, 0] = first
    return order


def band_keys(filled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = words.mix(np.arange(rows, dtype=np.uint64), 11) | np.uint64(1)
    keys = (words.mix(filled).reshape(len(filled), bands, rows) * weights).sum(axis=2, dtype=np.uint64)
    return words.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 12)


def _fingerprint(members: np.ndarray) -> tuple[int, int]:
    sums = (words.mix(members, s).sum(dtype=np.uint64) for s in (21, 22))
    return tuple(int(np.int64(np.uint64(s).view(np.int64))) for s in sums)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in words.pieces(whole, "text"):
            yield batch, list(words.shingle_sets(*words.words_of(batch["text"]), k))


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, k):
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, bands * rows), bands, rows).view(np.int64)) if full else iter(())
            marks = [_fingerprint(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["row_hash"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "row_hash", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _with_sets(k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, k):
            same = [len(s) > 0 and _fingerprint(s) == (f1, f2) for s, f1, f2 in zip(sets, batch["f1"].to_pylist(), batch["f2"].to_pylist(), strict=True)]
            rows = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [batch[n].take(pa.array(rows)) for n in names]
                + [pa.array([sets[i].tobytes() for i in rows], pa.binary())],
                names=[*names, "members"],
            )

    return run


def _linked(numerator: int, denominator: int):
    """Compares the candidates of the groups in one task; returns one link per joined class."""

    def similar(common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return denominator * common >= numerator * (a + b - common)

    def compare(ids, blocks, keys, sets) -> Iterator[tuple[int, int]]:
        n = len(ids)
        sizes = np.array([len(s) for s in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        local, at = local.reshape(-1), np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(int(local.max()) + 1, np.int64)
        label = np.arange(n)
        for i in range(n - 1):
            near = (keys[i + 1 :] == keys[i]).any(axis=1) & (label[i + 1 :] != label[i])
            least, most = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
            near &= denominator * least >= numerator * most
            if blocks[0] != blocks[-1]:
                near &= blocks[i + 1 :] != blocks[i]
            others = i + 1 + np.flatnonzero(near)
            if not len(others):
                continue
            own = local[at[i] : at[i + 1]]
            mark[own] = 1
            if len(others) < 16:
                common = np.array([mark[local[at[j] : at[j + 1]]].sum() for j in others])
            else:
                common = np.add.reduceat(mark[local], at[:-1])[others]
            mark[own] = 0
            for j in others[similar(common, sizes[i], sizes[others])]:
                label[label == label[j]] = label[i]
        for root in np.unique(label):
            inside = ids[label == root]
            least = inside.min()
            yield from ((int(x), int(least)) for x in inside if x != least)

    def run(group: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        group = group.sort_by([(n, "ascending") for n in ("root", "block", "doc_id", "f1", "f2")])
        roots = group["root"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(roots)) + 1, [len(roots)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = group.slice(lo, hi - lo)
            # Repeats of one id and set are one; other sets of an id are candidates of their own.
            nodes = np.stack([part[n].to_numpy() for n in ("doc_id", "f1", "f2")], axis=1)
            first = np.sort(np.unique(nodes, axis=0, return_index=True)[1])
            ids = part["doc_id"].to_numpy()[first]
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(part["members"][int(i)].as_py(), np.uint64) for i in first]
            keys = part["bands"].combine_chunks().flatten().to_numpy().reshape(len(part), -1)[first]
            links += compare(ids, part["block"].to_numpy()[first], keys, sets)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirmed_links(docs: DataFrame, classes: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b): links between classes that hold on the full sets, at most one per class and task.

    ``classes``: ``doc_id`` (the smallest of the class), ``n_shingles, f1, f2, bands``.
    """
    buckets = classes.select("doc_id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("n > 1").select("key", "first"), "buckets")
    links = buckets.join(shared, "key").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    groups = connected_components(links)

    members = written(groups.join(classes, groups["node"] == classes["doc_id"]).drop("node"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("total") / BLOCK_SHINGLES)).cast("long")
    sizes = written(sizes.select("root", blocks.alias("blocks"), "total"), "group-sizes")
    small = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("total")))).first()[0] or 0
    bins = 1 + small // BLOCK_SHINGLES  # groups of one block share tasks

    placed = members.join(sizes, "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("f1", F.lit(5)), "blocks")).select(
        F.col("doc_id"), "root", "blocks", "block", "f1", "f2", "bands"
    )
    placed = written(placed, "placed")
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("text"))
    joined = texts.join(placed, texts["_id"] == placed["doc_id"]).drop("_id")
    names = ["doc_id", "root", "blocks", "block", "f1", "f2", "bands"]
    schema = StructType([*(placed.schema[n] for n in names)]).add("members", "binary")
    sets = joined.mapInArrow(_with_sets(k, names), schema)
    # A block of a group meets itself and every other block of the group, each pair in one task.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = sets.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(
        F.xxhash64("root", low, high)
    )
    dealt = paired.select(task.alias("task"), (F.col("blocks") == 1).alias("whole"), "root", "block", "doc_id", "f1", "f2", "bands", "members")
    return dealt.groupBy("whole", "task").applyInArrow(_linked(numerator, denominator), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    numerator: int = 80,
    denominator: int = 100,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, row_hash, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if ``denominator`` times their common shingles are at least
    ``numerator`` times their united ones.
    """
    schema = "doc_id long, row_hash long, n_shingles long, f1 long, f2 long, bands array<long>"
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("row_hash"), docs["text"].alias("text"))
    rows_ = written(texts.mapInArrow(_sketch(shingle_words, bands, rows), schema), "sketches")
    full = rows_.where("doc_id IS NOT NULL AND f1 IS NOT NULL")
    first = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"))
    first = written(first, "classes")
    same = ["f1", "f2", "doc_id"]
    classes = full.join(first, same, "left_semi").dropDuplicates(same).drop("row_hash")
    classes = written(classes, "class-sketches")
    links = confirmed_links(texts, classes, shingle_words, numerator, denominator)
    # Rows of one doc_id with different sets are one node: each class links to all ids it holds only
    # through its smallest, so ids with several sets add their own links.
    several = full.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi")
    shared = full.join(several.select("doc_id"), "doc_id", "left_semi").join(
        first.withColumnRenamed("doc_id", "first"), ["f1", "f2"]
    )
    links = links.union(shared.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    roots = connected_components(links)
    labelled = first.join(roots, first["doc_id"] == roots["node"], "left").select(
        F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("root", "doc_id").alias("component_id")
    )
    labelled = written(labelled, "labels")
    joined = rows_.join(labelled, (rows_["f1"] == labelled["_f1"]) & (rows_["f2"] == labelled["_f2"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id",
        "row_hash",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, one per group of near-duplicates, unchanged.

    Rows that share a ``doc_id`` are one document, of which the row with the smallest hash of
    its text stays; rows with a null ``doc_id`` all stay.
    """
    found = written(near_duplicates(docs, **settings), "near-duplicates")
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    several = found.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    several = several.where("_n > 1").select("_id")
    if several.isEmpty():
        return kept
    single = kept.join(several, kept["doc_id"] == several["_id"], "left_anti")
    whole = kept.join(several, kept["doc_id"] == several["_id"], "left_semi")
    order = Window.partitionBy(whole["doc_id"]).orderBy(F.xxhash64(whole["text"]))
    rows = whole.select(F.struct(*(whole[c] for c in docs.columns)).alias("row"), F.row_number().over(order).alias("place"))
    return single.union(rows.where("place = 1").select("row.*"))
