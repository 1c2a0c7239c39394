"""Packing of token sequences by cutting-stock column generation.

Each document becomes token ids and an end id. Whole multiples of the sequence length fill
sequences of their own; what is left of each document is a remainder. Remainders fall into
``CLASSES`` length classes, and the histogram of the classes (its size does not depend on the
data) goes to a linear program: its columns are patterns, multisets of classes that fit one
sequence, and a knapsack dynamic program prices the next column until none improves. Rounded
down, a pattern's number says how many sequences use it; the documents of each class, ranked
across the cluster, take the places of the patterns in order.

A remainder is up to a class width shorter than its place. So some documents of each class
are left out of the program; laid end to end, they are cut to fill the gaps exactly, and
what is still left fills sequences of its own. The last tokens, fewer than a sequence, go into
sequences of powers of two. Only these fillers are cut.

Defined cases: a null or empty text is its end id alone. Repeated rows are packed one by one.
A null ``doc_id`` stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import subwords, words
from tidemark.llm.common import written

CLASSES = 64


# --- the linear program, on the driver: CLASSES rows whatever the data ---------------------


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: sizes 1..len(prices), the counts with the highest total price."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        sizes = np.arange(1, min(room, len(prices)) + 1)
        values = prices[sizes - 1] + best[room - sizes]
        top = int(values.argmax())
        if values[top] > best[room - 1] + 1e-12:
            best[room], choice[room] = values[top], sizes[top]
        else:
            best[room], choice[room] = best[room - 1], 0
    counts, room = np.zeros(len(prices), int), capacity
    while room:
        if choice[room]:
            counts[choice[room] - 1] += 1
        room -= max(1, choice[room])
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, rounds: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, numbers): the optimal basis of the linear program, numbers rounded down.

    Minimises the number of sequences whose patterns hold ``demand`` pieces of the sizes
    1..len(demand); the capacity is len(demand). Column generation with the revised simplex.
    """
    n = len(demand)
    basis = np.diag([n // size for size in range(1, n + 1)]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, column = best_pattern(np.maximum(prices, 0), n)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        ratios = np.where(rising, np.maximum(amount, 0) / np.where(rising, direction, 1), np.inf)
        basis[:, int(ratios.argmin())] = column
    amount = np.maximum(np.linalg.solve(basis, demand), 0)
    return basis.T.round().astype(int), np.floor(amount + 1e-9).astype(int)


# --- token ids ---------------------------------------------------------------------------


def _encoder(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = subwords.load(path)
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in words.pieces(whole, "text"):
                rows = [np.append(ids, end_id).astype("<u4") for ids in encoder.encode(subwords.texts_of(batch))]
                sizes = np.array([len(r) for r in rows], np.int64)
                narrow = all(r.max() < 1 << 16 for r in rows)
                kind = "<u2" if narrow else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(len(rows))),
                        batch["doc_id"],
                        pa.array(sizes),
                        pa.array([2 if narrow else 4] * len(rows), pa.int32()),
                        pa.array([r.astype(kind).tobytes() for r in rows], pa.binary()),
                    ],
                    names=["uid", "doc_id", "n", "width", "ids"],
                )
                uid += len(rows)

    return run


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """(uid, doc_id, n, width, ids): ids as little-endian numbers of ``width`` bytes."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    schema = "uid long, doc_id long, n long, width int, ids binary"
    return written(texts.mapInArrow(_encoder(tokenizer, end_id, length), schema), "tokens")


# --- numbering and running totals --------------------------------------------------------


def running_total(df: DataFrame, order: list[str], value: str) -> tuple[DataFrame, int]:
    """(``df`` with ``before``, the total): sums of ``value`` over the rows earlier in ``order``.

    Rows are dealt by range; one sum per partition meets on the driver.
    """
    columns = df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = so_far + np.cumsum(batch[value].to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[so_far], ends[:-1]]) if len(ends) else ends
            so_far = int(ends[-1]) if len(ends) else so_far
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(before, pa.int64()), pa.array(ends, pa.int64())],
                names=[*columns, "_part", "_before", "_end"],
            )

    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields)).add("_part", "integer").add("_before", "long").add("_end", "long")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = written(sorted_.mapInArrow(local, schema), "running")
    ends = sorted((r[0], r[1]) for r in summed.groupBy("_part").agg(F.max("_end")).collect())
    starts, total = [], 0
    for part, end in ends:
        starts.append((part, total))
        total += end
    offsets = summed.sparkSession.createDataFrame(starts, "_part int, _start long")
    joined = summed.join(F.broadcast(offsets), "_part")  # one row per partition
    return joined.select(*columns, (F.col("_start") + F.col("_before")).alias("before")), total


def _ranked(rests: DataFrame) -> DataFrame:
    """``rests`` with ``rank``, from 0 within each class; no class meets in one task."""
    blocks = rests.groupBy("block", "class").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.withColumn("first", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size"), "ranks")
    inside = F.row_number().over(Window.partitionBy("block", "class").orderBy("uid")) - 1
    return rests.withColumn("inside", inside).join(blocks, ["block", "class"]).withColumn("rank", F.col("first") + F.col("inside"))


# --- the layout --------------------------------------------------------------------------


def _places(patterns: np.ndarray, numbers: np.ndarray) -> tuple[list[tuple], int]:
    """Rows (class, lo, hi, sequences, first): ranks lo..hi of a class take these sequences."""
    rows, taken, first = [], np.zeros(patterns.shape[1], int), 0
    for pattern, number in zip(patterns, numbers, strict=True):
        if number:
            for size in np.flatnonzero(pattern):
                lo = int(taken[size])
                taken[size] += pattern[size] * number
                rows.append((int(size) + 1, lo, int(taken[size]), int(number), first))
            first += int(number)
    return rows, first


def layout(lengths: DataFrame, length: int = 4096) -> DataFrame:
    """(uid, start, length, sequence_id, offset): every token of every document, once.

    ``lengths`` is a written table with ``uid`` and ``n``.
    """
    spark = lengths.sparkSession
    unit = length // CLASSES
    # Documents of a sequence or more fill sequences of their own first.
    long_docs, n_full = running_total(
        lengths.where(F.col("n") >= length).select("uid", F.floor(F.col("n") / length).alias("full")), ["uid"], "full"
    )
    heads = long_docs.select("uid", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i")).select(
        "uid", (F.col("i") * length).alias("start"), F.lit(length).cast("long").alias("length"),
        (F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rest = F.col("n") % length
    rests = lengths.where(rest > 0).select(
        "uid", (F.col("n") - rest).alias("skip"), rest.alias("rest"), F.ceil(rest / unit).cast("int").alias("class"),
        F.shiftright("uid", 33).alias("block"),
    )
    sums = {r[0]: (r[1], r[2]) for r in rests.groupBy("class").agg(F.count(F.lit(1)), F.sum("rest")).collect()}
    demand = np.array([sums.get(c, (0, 0))[0] for c in range(1, CLASSES + 1)], float)
    tokens = np.array([sums.get(c, (0, 0))[1] for c in range(1, CLASSES + 1)], float)
    # The share of documents that the gaps of the others need, and a little more.
    missing = float((demand * np.arange(1, CLASSES + 1) * unit - tokens).sum())
    share = missing / max(1.0, missing + float(tokens.sum()))
    planned = np.floor(demand * max(0.0, 1 - 1.25 * share - 0.01))
    patterns, numbers = cutting_stock(planned)
    numbers = np.maximum(numbers - 1, 0)  # leaves some tokens in reserve
    rows, n_packed = _places(patterns, numbers)

    ranked = written(_ranked(rests), "ranked")
    places = spark.createDataFrame(rows, "class int, lo long, hi long, sequences long, first long")
    places = places.groupBy("class").agg(F.collect_list(F.struct("lo", "hi", "sequences", "first")).alias("all"))
    placed = ranked.join(F.broadcast(places), "class", "left")  # CLASSES rows
    mine = F.element_at(F.filter("all", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)
    has = F.exists(F.coalesce("all", F.expr("CAST(array() AS array<struct<lo: bigint, hi: bigint, sequences: bigint, first: bigint>>)")), lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))
    placed = written(
        placed.withColumn("mine", F.when(has, mine)).select(
            "uid", "skip", "rest",
            (n_full + F.col("mine.first") + (F.col("rank") - F.col("mine.lo")) % F.col("mine.sequences")).alias("sequence_id"),
        ),
        "placed",
    )
    inside = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.where("sequence_id IS NOT NULL").select(
        "uid", F.col("skip").alias("start"), F.col("rest").alias("length"), "sequence_id",
        F.coalesce(F.sum("rest").over(inside), F.lit(0)).alias("offset"),
    )
    gaps = placed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg((length - F.sum("rest")).alias("gap"))
    gaps, n_gaps = running_total(gaps.where("gap > 0"), ["sequence_id"], "gap")
    fillers, n_fill = running_total(placed.where("sequence_id IS NULL").select("uid", "skip", "rest"), ["uid"], "rest")
    filled = min(n_gaps, n_fill)

    # Gaps and fillers lie on one axis of tokens; cells of it bring together what overlaps.
    def cells(begin, size):
        last = F.floor((begin + size - 1) / length)
        return F.explode(F.sequence(F.floor(begin / length), last))

    stop = F.col("before") + F.col("rest")
    gap_cells = gaps.select("sequence_id", F.col("before").alias("g"), "gap", cells(F.col("before"), F.col("gap")).alias("cell"))
    fill_cells = fillers.select("uid", "skip", F.col("before").alias("f"), stop.alias("f_end"), cells(F.col("before"), F.col("rest")).alias("cell"))
    begin = F.greatest("g", "f")
    over = F.least(F.col("g") + F.col("gap"), F.col("f_end")) - begin
    in_gaps = gap_cells.join(fill_cells, "cell").where((over > 0) & (F.floor(begin / length) == F.col("cell"))).select(
        "uid", (F.col("skip") + begin - F.col("f")).alias("start"), over.alias("length"), "sequence_id",
        (length - F.col("gap") + begin - F.col("g")).alias("offset"),
    )
    # What is left after the gaps: whole sequences, then powers of two.
    left, first = n_fill - filled, n_full + n_packed
    tail, at, bounds = left % length, left - left % length, []
    for i, size in enumerate(1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1):
        bounds.append((at, at + size, first + left // length + i))
        at += size
    ends = F.array(*(F.struct(F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi"), F.lit(s).cast("long").alias("id")) for a, b, s in bounds))
    a, b = F.greatest(F.col("before") - filled, F.lit(0)), stop - filled
    later = fillers.where(stop > filled).select("uid", "skip", (F.col("before") - filled).alias("f"), a.alias("a"), b.alias("b"))
    cut = F.lit(left - tail)
    whole = later.where(F.col("a") < cut).withColumn("to", F.least("b", cut)).select(
        "uid", "skip", "f", "a", "to", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("to") - 1) / length))).alias("k")
    ).select("uid", "skip", "f", F.greatest("a", F.col("k") * length).alias("x"), F.least("to", (F.col("k") + 1) * length).alias("y"), (first + F.col("k")).alias("sequence_id"), (F.col("k") * length).alias("base"))
    pieces = [heads, packed, in_gaps]
    own = whole
    if bounds:
        tails = later.where(F.col("b") > cut).select("uid", "skip", "f", "a", "b", F.explode(ends).alias("e"))
        tails = tails.select("uid", "skip", "f", F.greatest("a", "e.lo").alias("x"), F.least("b", "e.hi").alias("y"), F.col("e.id").alias("sequence_id"), F.col("e.lo").alias("base"))
        own = whole.union(tails.where("x < y"))
    pieces.append(own.select("uid", (F.col("skip") + F.col("x") - F.col("f")).alias("start"), (F.col("y") - F.col("x")).alias("length"), "sequence_id", (F.col("x") - F.col("base")).alias("offset")))
    out = pieces[0]
    for more in pieces[1:]:
        out = out.union(more.select(*out.columns))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, lengths, widths = (batch[c].to_pylist() for c in ("start", "length", "width"))
        ids = []
        for i, (start, n, width) in enumerate(zip(starts, lengths, widths, strict=True)):
            stored = np.frombuffer(batch["ids"][i].as_buffer(), f"<u{width}", count=n, offset=start * width)
            ids.append(stored.astype("<u4").tobytes())
        kept = [c for c in batch.schema.names if c not in ("ids", "width")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for every piece.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers.
    """
    if length % CLASSES:
        raise ValueError(f"the sequence length must be a multiple of {CLASSES}")
    tokens = token_ids(docs, tokenizer, end_id, length)
    pieces = written(layout(tokens.select("uid", "n"), length), "pieces")
    joined = pieces.join(tokens, "uid").select(
        "doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", "width", "ids"
    )
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return joined.mapInArrow(_slices, schema)
