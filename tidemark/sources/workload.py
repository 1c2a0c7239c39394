"""Deterministic order workloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import floor_div
from tidemark.schemas import ORDER_COLUMNS

# ---------------------------------------------------------------- fixed values
STATUSES = ["created", "paid", "packed", "shipped", "delivered"]
BASE_TS = "2026-01-01 00:00:00"
CUSTOMER_SPAN = 10_000
AMOUNT_LOW, AMOUNT_SPAN = 100, 250_000
# multiplier and increment of the 31-bit linear congruential mix below
MIX_A, MIX_C, MIX_M = 1_103_515_245, 12_345, 2_147_483_648
SPIKE_PROFILES = {
    # name: (business key prefix, first customer, first amount, seed)
    "load": ("load-order-", 23_000, 30_000, 223),
    "compaction": ("compaction-order-", 10_000, 25_000, 222),
}
# ------------------------------------------------------------------------------


def _mix(id_: Column, seed: int, draw: int) -> Column:
    """A pseudo random number in 0..2^31-1 per (id, seed, draw), without shared state."""
    x = F.pmod(id_ * 31 + (seed * 17 + draw * 101), F.lit(MIX_M))
    for _ in range(3):
        x = F.pmod(x * MIX_A + MIX_C, F.lit(MIX_M))
        x = x.bitwiseXOR(F.shiftright(x, 13))
    return x


def order_rows(ids: DataFrame, events: int, seed: int) -> DataFrame:
    """Order rows for the ``id`` column of ``ids``; ids run from 1 to ``events``."""
    if events < 1:
        raise ValueError("events must be positive")
    id_ = F.col("id")
    span = min(events, CUSTOMER_SPAN)
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    base = F.lit(BASE_TS).cast("timestamp_ntz")
    values = {
        "order_id": id_,
        "business_key": F.concat(F.lit("order-"), F.lpad(id_.cast("string"), 12, "0")),
        "event_id": id_,
        "customer_id": _mix(id_, seed, 1) % span + 1,
        "status": statuses[(_mix(id_, seed, 2) % len(STATUSES)).cast("int")],
        "amount_cents": _mix(id_, seed, 3) % AMOUNT_SPAN + AMOUNT_LOW,
        "updated_at": F.timestamp_add("SECOND", id_, base),
        "seed": F.lit(seed),
    }
    return ids.select(*[values[c].alias(c) for c in ORDER_COLUMNS])


def generate_orders(spark: SparkSession, events: int, seed: int) -> DataFrame:
    if events < 1:
        raise ValueError("events must be positive")
    return order_rows(spark.range(1, events + 1), events, seed)


def spike_rows(ids: DataFrame, base_id: int, profile: str) -> DataFrame:
    """Sequential rows for the ``id`` column; the sequence is ``id - base_id``."""
    prefix, customer, amount, seed = SPIKE_PROFILES[profile]
    id_, seq = F.col("id"), F.col("id") - base_id
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    values = {
        "order_id": id_,
        "business_key": F.concat(F.lit(prefix), F.lpad(id_.cast("string"), 12, "0")),
        "event_id": id_,
        "customer_id": seq % 1000 + customer,
        "status": statuses[(seq % len(STATUSES)).cast("int")],
        "amount_cents": seq + amount,
        "updated_at": F.timestamp_add("SECOND", seq, F.lit(BASE_TS).cast("timestamp_ntz")),
        "seed": F.lit(seed),
    }
    return ids.select(*[values[c].alias(c) for c in ORDER_COLUMNS])


def generate_spike(spark: SparkSession, base_id: int, events: int, profile: str) -> DataFrame:
    return spike_rows(spark.range(base_id + 1, base_id + events + 1), base_id, profile)


def commit_batches(
    events: DataFrame, size: int, event_id: str, requested_ms: str, acked_ms: str, first_id: int = 0
) -> DataFrame:
    """Fixed-size batches in id order; the last may be short."""
    return (
        events.groupBy(floor_div(F.col(event_id) - first_id, size).alias("batch_id"))
        .agg(
            F.min(event_id).alias("first_event_id"),
            F.max(event_id).alias("last_event_id"),
            F.count(F.lit(1)).alias("event_count"),
            F.min(requested_ms).alias("request_started_epoch_ms"),
            F.max(acked_ms).alias("commit_ack_epoch_ms"),
        )
        .withColumn(
            "client_round_trip_ms",
            F.col("commit_ack_epoch_ms") - F.col("request_started_epoch_ms"),
        )
    )
