"""Offset vectors: lag, completeness and the link to checkpoints and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("log_end_offset"))


def group_lag(ends: DataFrame, group: DataFrame) -> DataFrame:
    """Lag per partition of ``ends``.

    A partition the group did not report is at lag 0 if it is empty, otherwise
    the report is incomplete. A reported end that differs from the log's makes
    it incomplete as well.
    """
    reported = group.select(
        "partition", "current_offset", F.col("log_end_offset").alias("__end")
    )
    missing = F.col("current_offset").isNull()
    empty = F.col("log_end_offset") == 0
    return ends.join(reported, "partition", "left").select(
        "partition",
        F.when(missing & empty, F.lit(0)).otherwise(F.col("current_offset")).cast("bigint").alias("current_offset"),
        "log_end_offset",
        # unknown stays null: greatest would skip the null and read it as no lag
        F.when(missing & empty, F.lit(0))
        .when(~missing, F.greatest(F.col("log_end_offset") - F.col("current_offset"), F.lit(0)))
        .cast("bigint")
        .alias("lag"),
        ((missing & empty) | (~missing & F.coalesce(F.col("__end") == F.col("log_end_offset"), F.lit(True)))).alias(
            "complete"
        ),
    )


def lag_summary(lags: DataFrame) -> DataFrame:
    return lags.agg(
        F.coalesce(F.sum("lag"), F.lit(0)).alias("lag_sum"),
        F.coalesce(F.max("lag"), F.lit(0)).alias("lag_max"),
        F.coalesce(F.sum("log_end_offset"), F.lit(0)).alias("source_total"),
        F.coalesce(F.every("complete"), F.lit(False)).alias("complete"),
    )


def linkage(lags: DataFrame, checkpoints: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per run tying offsets, the completed checkpoint and both snapshot ids.

    ``lags`` has (run_id, partition, lag), ``checkpoints`` (run_id, checkpoint_id),
    ``snapshots`` (run_id, table_name, snapshot_id).
    """
    offsets = lags.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.every(F.col("lag") == 0), F.lit(False)).alias("lag_zero"),
    )
    newest = checkpoints.groupBy("run_id").agg(F.max("checkpoint_id").alias("checkpoint_id"))
    tables = snapshots.groupBy("run_id").agg(
        F.max(F.when(F.col("table_name") == "orders_current", F.col("snapshot_id"))).alias(
            "current_snapshot_id"
        ),
        F.max(F.when(F.col("table_name") == "orders_changelog", F.col("snapshot_id"))).alias(
            "changelog_snapshot_id"
        ),
    )
    return (
        offsets.join(newest, "run_id", "left")
        .join(tables, "run_id", "left")
        .withColumn(
            "complete",
            F.col("lag_zero")
            & F.col("checkpoint_id").isNotNull()
            & F.col("current_snapshot_id").isNotNull()
            & F.col("changelog_snapshot_id").isNotNull(),
        )
    )
