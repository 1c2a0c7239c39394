"""Small-file maintenance: file statistics, compaction and its verification."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.functions.columns import floor_div
from tidemark.functions.ranks import median_interpolated
from tidemark.schemas import CHANGE
from tidemark.sources.tables import TableSet

TARGET_FILE_BYTES = 128 * 1024 * 1024


def file_stats(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count, bytes, median, min and max size and distinct manifests of a file listing.

    ``files`` has (path, size_bytes, manifest) and the key columns.
    """
    tagged = files.withColumn("__all", F.lit(0))
    group = [*keys, "__all"]
    totals = tagged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("data_file_count"),
        F.sum("size_bytes").alias("total_bytes"),
        F.min("size_bytes").alias("min_file_bytes"),
        F.max("size_bytes").alias("max_file_bytes"),
    )
    manifests = (
        tagged.groupBy(*group, "manifest")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("manifest_count"))
    )
    medians = median_interpolated(tagged, group, "size_bytes", "median_file_bytes")
    # one row per group from each side; without keys a join would be a nested loop
    measured = [c for side in (totals, medians, manifests) for c in side.columns if c not in group]
    both = totals.unionByName(medians, allowMissingColumns=True).unionByName(manifests, allowMissingColumns=True)
    return both.groupBy(*group).agg(*[F.max(c).alias(c) for c in measured]).drop("__all")


def planned_scan_tasks(df: DataFrame) -> int:
    """Tasks that a scan of a stored DataFrame starts with."""
    return df.rdd.getNumPartitions()


def table_files(tables: TableSet, datasets: Sequence[str]) -> DataFrame:
    """``file_stats`` of the stored files of each dataset, by listing."""
    listed = None
    for name in datasets:
        part = tables.files(name).select(F.lit(name).alias("dataset"), "path", "size_bytes", "manifest")
        listed = part if listed is None else listed.unionAll(part)
    return file_stats(listed, ["dataset"])


def compaction_plan(
    files: DataFrame,
    keys: Sequence[str],
    order: str,
    block: Column,
    target_bytes: int = TARGET_FILE_BYTES,
) -> DataFrame:
    """Bin number per small file: files in order, a new bin at each target-size step.

    Files at or above the target stay as they are (bin null).
    """
    small = files.where(F.col("size_bytes") < target_bytes)
    packed = blocked.running(
        small, keys, [order], block, [blocked.Running("__upto", "sum", "size_bytes")]
    )
    return packed.withColumn(
        "bin", floor_div(F.col("__upto") - F.col("size_bytes"), target_bytes)
    ).drop("__upto")


def plan_summary(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    return plan.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


def compact_current(tables: TableSet, target_bytes: int = TARGET_FILE_BYTES) -> dict[str, int]:
    """Write the last image per key as a new base, in files near the target size.

    Deletes stay in the base as markers: without them a redelivered older image
    would bring the key back. Readers use the newest base at or below their
    snapshot, so older snapshots stay readable.
    """
    upto = tables.last_batch()
    if upto < 0:
        raise ValueError("nothing committed to compact")
    before = tables.files("current").where(F.col("number") <= upto)
    stats = before.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    ).first()
    files = max(1, math.ceil(stats.bytes / target_bytes))
    path = f"{tables.root}/base/epoch={tables.epoch}/upto={upto}"
    images = tables.latest_images(upto).repartitionByRange(files, "order_id").sortWithinPartitions("order_id")
    tables.write_rows(images.select(*CHANGE.fieldNames()), path)
    base = tables.spark.read.schema(CHANGE).parquet(path)
    added = tables.files("base").where(F.col("number") == upto).count()
    tables.commit_base(upto, base.count())
    return {
        "rewritten_files": stats.n,
        "added_files": added,
        "rewritten_bytes": stats.bytes,
    }


def compare_metrics(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Directional checks and deltas between two file-metric rows per key."""
    b, a = before.alias("b"), after.alias("a")

    def delta(name: str) -> Column:
        return (F.col(f"a.{name}") - F.col(f"b.{name}")).cast("double")

    return b.join(a, key).select(
        key,
        (delta("data_file_count") < 0).alias("data_file_count_decreased"),
        (delta("manifest_count") < 0).alias("manifest_count_decreased"),
        (delta("median_file_bytes") > 0).alias("median_file_size_increased"),
        (delta("planning_latency_ms") < 0).alias("planning_latency_decreased"),
        delta("data_file_count").alias("data_file_count_delta"),
        delta("manifest_count").alias("manifest_count_delta"),
        delta("median_file_bytes").alias("median_file_bytes_delta"),
        delta("planning_latency_ms").alias("planning_latency_ms_delta"),
    )
