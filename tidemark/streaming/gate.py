"""Admission gate: records of mis-keyed or out-of-order keys stay out of the tables.

The gate knows of every primary key how many records it has seen, under which keys and on which
partitions they came, the last and the highest event id, and how often arrival order broke.
Each micro-batch meets that high-water row as one more row before the batch's own rows of the
key, in blocks along arrival order, so that no join copies it and a hot key is spread over
tasks. A key with a mismatched record key or an event id that does not rise is rejected: its
records of this batch and of all later ones are kept apart as a whole.

State is written per batch for the keys of the batch. Every FULL_EVERY batches it is written
for all keys, sorted by key, so a batch reads one full state and a bounded number of parts,
pruned to the range of its keys. What a batch reads is committed before it starts, so a
retried batch decides as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import floor_div
from tidemark.operators.decode import valid_records
from tidemark.operators.state import latest_per_key
from tidemark.schemas import DELETE, GATE, UPDATE_BEFORE
from tidemark.sources.tables import TableSet

FULL_EVERY = 16
BLOCK_MS = 60_000


def gate_rows(decoded: DataFrame) -> DataFrame:
    """One row per decodable record: the key it came under, and the row's key and event.

    An update counts by its new row. A delete repeats the event id of the row it removes, so its
    event is null and takes no part in the order.
    """
    kind = F.col("image.cdc_row_kind")
    return valid_records(decoded).where(kind != UPDATE_BEFORE).select(
        F.col("key").cast("string").try_cast("bigint").alias("key_order_id"),
        F.col("image.row.order_id").alias("order_id"),
        F.when(kind != DELETE, F.col("image.row.event_id")).alias("event_id"),
        "partition",
        "offset",
        "timestamp_ms",
    )


def high_water(tables: TableSet, before_batch: int | None = None, keys: tuple[int, int] | None = None) -> DataFrame:
    """The newest committed gate row of every key, of the keys in a range if given."""
    last = tables.last_batch() if before_batch is None else before_batch - 1
    first = max(last, 0) // FULL_EVERY * FULL_EVERY
    rows = tables.committed("gate", last).where(F.col("batch") >= F.lit(first))
    if keys is not None:
        rows = rows.where(F.col("order_id").between(*keys))
    return latest_per_key(rows, ["order_id"], ["batch"]).select(*GATE.fieldNames())


def advance(rows: DataFrame, before: DataFrame, batch_id: int, block_ms: int = BLOCK_MS) -> DataFrame:
    """Gate rows after a batch, for the keys of its ``rows``; ``before`` has their old ones."""
    touched = before.join(rows.select("order_id").distinct(), "order_id", "left_semi")
    carried = touched.select(
        "order_id",
        F.col("last_event_id").alias("event_id"),
        F.lit(None).cast("bigint").alias("timestamp_ms"),  # nulls come first: before every record
        F.col("last_offset").alias("offset"),
        F.struct(*[c for c in GATE.fieldNames() if c != "order_id"]).alias("old"),
    )
    both = rows.unionByName(carried, allowMissingColumns=True)
    order = ["timestamp_ms", "partition", "offset"]
    ordered = blocked.running(
        both.where(F.col("event_id").isNotNull()),
        ["order_id"],
        order,
        F.coalesce(floor_div(F.col("timestamp_ms"), block_ms), F.lit(-1)),
        [blocked.Running("prev_event", "lag", "event_id"), blocked.Running("prev_offset", "lag", "offset")],
    )
    stepped = ordered.unionByName(both.where(F.col("event_id").isNull()), allowMissingColumns=True)
    real = F.col("old").isNull()
    arrival = F.struct(*order)

    def add(name: str, here: Column) -> Column:
        return (F.count_if(real & here) + F.coalesce(F.max(F.col(f"old.{name}")), F.lit(0))).alias(name)

    counted = stepped.groupBy("order_id").agg(
        add("records", F.lit(True)),
        add("mismatched_keys", ~F.coalesce(F.col("key_order_id") == F.col("order_id"), F.lit(False))),
        F.least(F.min("partition"), F.min("old.low_partition")).alias("low_partition"),
        F.greatest(F.max("partition"), F.max("old.high_partition")).alias("high_partition"),
        add("order_violations", F.coalesce(F.col("event_id") <= F.col("prev_event"), F.lit(False))),
        add("offset_violations", F.coalesce(F.col("offset") <= F.col("prev_offset"), F.lit(False))),
        F.max_by("event_id", F.when(F.col("event_id").isNotNull(), arrival)).alias("last_event_id"),
        F.max_by("offset", F.when(F.col("event_id").isNotNull(), arrival)).alias("last_offset"),
        F.greatest(F.max("event_id"), F.max("old.highest_event_id")).alias("highest_event_id"),
        F.max("old.rejected_in").alias("rejected_in"),
    )
    bad = (F.col("mismatched_keys") > 0) | (F.col("order_violations") > 0)
    rejected = F.coalesce("rejected_in", F.when(bad, F.lit(batch_id)))
    return counted.withColumn("rejected_in", rejected).select(*[F.col(f.name).cast(f.dataType) for f in GATE.fields])


def next_state(tables: TableSet, rows: DataFrame, batch_id: int) -> DataFrame:
    """The gate rows that batch ``batch_id`` has to write."""
    ends = rows.agg(F.min("order_id").alias("lo"), F.max("order_id").alias("hi")).first()
    known = high_water(tables, batch_id, None if ends.lo is None else (ends.lo, ends.hi))
    moved = advance(rows, known, batch_id)
    if batch_id % FULL_EVERY:
        return moved
    others = high_water(tables, batch_id).join(moved.select("order_id"), "order_id", "left_anti")
    return moved.unionByName(others).repartitionByRange("order_id").sortWithinPartitions("order_id")


def split(decoded: DataFrame, state: DataFrame) -> DataFrame:
    """Decoded rows with ``admitted``: false for every record of a rejected key, true for all others."""
    rejected = state.where("rejected_in IS NOT NULL").select("order_id", F.lit(True).alias("rejected"))
    keyed = decoded.withColumn("order_id", F.col("image.row.order_id"))
    block = F.struct("partition", floor_div(F.col("offset"), 65_536))
    marked = keyed.withColumn("__block", block)
    # a hot key meets its verdict once per block of its records
    spread = marked.select("order_id", "__block").distinct().join(rejected, "order_id")
    joined = marked.join(spread, ["order_id", "__block"], "left")
    return joined.withColumn("admitted", F.col("rejected").isNull()).drop("__block", "rejected")


def gate_audit(state: DataFrame) -> DataFrame:
    """The gate's knowledge in the columns of ``audits.miskey_audit``."""
    return state.select(
        "order_id",
        "records",
        "mismatched_keys",
        (F.col("low_partition") != F.col("high_partition")).alias("spans_partitions"),
        "order_violations",
        "offset_violations",
        F.col("last_event_id").alias("arrival_final_event_id"),
        F.col("highest_event_id").alias("canonical_final_event_id"),
        (F.col("last_event_id") != F.col("highest_event_id")).alias("would_corrupt"),
        F.when(F.col("rejected_in").isNotNull(), "reject").otherwise("admit").alias("disposition"),
    )


def admitted_current(tables: TableSet) -> DataFrame:
    """Live rows without the keys that are rejected by now, whatever of them came in before."""
    rejected = high_water(tables).where("rejected_in IS NOT NULL").select("order_id")
    return tables.current().join(rejected, "order_id", "left_anti")
