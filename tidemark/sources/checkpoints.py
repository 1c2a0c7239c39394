"""The checkpoint log of a streaming query as a table, and its link to the commit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.offsets import linkage, log_end_offsets
from tidemark.sources.tables import TableSet

_META = "batchWatermarkMs BIGINT, batchTimestampMs BIGINT"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, lines) per file of a log folder; a file is named by its batch."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").try_cast("bigint").alias("batch_id"), F.split("value", "\n").alias("lines")
    ).where(F.col("batch_id").isNotNull())


def checkpoint_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per batch the query planned: time, watermark, source offsets, and if it completed."""
    planned = _entries(spark, f"{checkpoint}/offsets")
    meta = F.from_json(F.get("lines", F.lit(1)), _META)
    done = _entries(spark, f"{checkpoint}/commits").select("batch_id", F.lit(True).alias("done"))
    return planned.join(done, "batch_id", "left").select(
        "batch_id",
        meta["batchTimestampMs"].alias("started_at_ms"),
        meta["batchWatermarkMs"].alias("watermark_ms"),
        F.slice("lines", 3, F.size("lines")).alias("source_offsets"),
        F.coalesce("done", F.lit(False)).alias("completed"),
    )


def stream_linkage(tables: TableSet, checkpoint: str, log: DataFrame, run_id: str) -> DataFrame:
    """``offsets.linkage`` of a run: the ledger's offsets against the log's ends, the newest
    completed batch of the checkpoint, and the newest snapshot of either table."""
    spark, reached = tables.spark, tables.offsets()
    run = F.lit(run_id).alias("run_id")
    at = F.create_map(*[F.lit(x) for item in reached.items() for x in item]) if reached else F.create_map().cast("map<string,bigint>")
    place = F.concat_ws(":", "topic", "partition")
    lags = log_end_offsets(log).select(
        run, "partition", (F.col("log_end_offset") - F.coalesce(F.element_at(at, place), F.lit(0))).alias("lag")
    )
    checkpoints = checkpoint_batches(spark, checkpoint).where("completed").select(run, F.col("batch_id").alias("checkpoint_id"))
    snapshots = [
        tables.committed(dataset).agg(F.max("batch").alias("snapshot_id")).select(
            run, F.lit(f"orders_{dataset}").alias("table_name"), "snapshot_id"
        )
        for dataset in ("current", "changelog")
    ]
    linked = linkage(lags, checkpoints, snapshots[0].unionByName(snapshots[1]))
    return linked.withColumn("ledger_batch_id", F.lit(tables.last_batch()))
