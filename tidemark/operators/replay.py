"""Repair of quarantined records and rebuilds from a log position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.decode import changes, dead_letters, decode, drop_update_before
from tidemark.operators.encode import envelope, null_row, wire_row
from tidemark.operators.state import current_state
from tidemark.schemas import REPAIR_FORMAT
from tidemark.sources.cdc_log import from_starts, offsets_for_timestamp

_REPAIR_DDL = (
    "repair_format STRING, intended_operation STRING, intended_after STRUCT<"
    "order_id BIGINT, business_key STRING, event_id BIGINT, customer_id BIGINT, "
    "status STRING, amount_cents BIGINT, updated_at VARIANT, seed INT>"
)


def open_dead_letters(letters: DataFrame) -> DataFrame:
    """Original bytes of each dead letter and, where they hold a repair document, its parts."""
    original = F.unbase64("original_value_base64")
    return (
        letters.dropDuplicates(["original_topic", "original_partition", "original_offset"])
        .withColumn("original_value", original)
        .withColumn("repair", F.from_json(F.col("original_value").cast("string"), _REPAIR_DDL))
        .withColumn(
            "repairable",
            F.coalesce(
                (F.col("repair.repair_format") == REPAIR_FORMAT)
                & F.col("repair.intended_after").isNotNull(),
                F.lit(False),
            ),
        )
    )


def repaired_records(letters: DataFrame) -> DataFrame:
    """Repair documents as well-formed records at their original log position.

    At the tail of the log they would overtake later changes of their key.
    """
    opened = open_dead_letters(letters).where(F.col("repairable"))
    return opened.select(
        F.col("original_topic").alias("topic"),
        F.col("original_partition").alias("partition"),
        F.col("original_offset").alias("offset"),
        F.col("original_timestamp_ms").alias("timestamp_ms"),
        F.col("repair.intended_after.order_id").cast("string").cast("binary").alias("key"),
        envelope(
            F.col("repair.intended_operation"),
            null_row(),
            wire_row("repair.intended_after.", F.col("repair.intended_after.updated_at")),
            F.col("original_timestamp_ms"),
        ).alias("value"),
    )


def repair_and_replay(images: DataFrame, letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the images decoded so far plus those of the repaired records, letters of repairs that failed).

    A repair that cannot be decoded either is a dead letter again, at the same log position.
    """
    again = decode(repaired_records(letters))
    return images.unionByName(changes(again)), dead_letters(again)


def rebuild(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Current state from the log alone, from offset 0 or from the given starts."""
    records = log if starts is None else from_starts(log, starts)
    return current_state(changes(decode(records)))


def rebuild_from_timestamp(log: DataFrame, timestamp_ms: int) -> DataFrame:
    return rebuild(log, offsets_for_timestamp(log, timestamp_ms))


def timestamp_coverage(current: DataFrame, images: DataFrame, timestamp_ms: int) -> DataFrame:
    """Live keys without an image at or after the timestamp.

    A rebuild from the timestamp is complete exactly if there are none.
    """
    touched = drop_update_before(images).where(F.col("timestamp_ms") >= F.lit(timestamp_ms))
    # distinct before the join: a key touched a billion times crosses the shuffle once per task
    keys = touched.select("order_id").distinct()
    return current.select("order_id").join(keys, "order_id", "left_anti")
