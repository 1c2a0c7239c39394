"""Two lineages of a table set against each other, and where they differ.

Rows are hashed into buckets by key; per bucket a count and sums of row hashes are the leaves of
a digest tree. Equal leaves need no second look: only rows of buckets that differ are shuffled
and compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import row_hash
from tidemark.functions.digests import digest_aggregates, digest_of_aggregates
from tidemark.operators.diff import row_diff_by_key
from tidemark.sources.tables import TableSet

BUCKETS = 4096


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, key: str, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, digest) for every bucket that has rows."""
    hashed = rows.select(_bucket(key, buckets).alias("bucket"), row_hash(*[F.col(c) for c in columns]).alias("h"))
    leaves = hashed.groupBy("bucket").agg(*digest_aggregates("h", "d", F.lit(1)))
    return leaves.select("bucket", F.col("d0").cast("bigint").alias("rows"), digest_of_aggregates("d").alias("digest"))


def differing_buckets(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Numbers of the buckets whose leaves differ, at most ``buckets``."""
    sides = [bucket_digests(df, key, columns, buckets) for df in (expected, actual)]
    both = sides[0].unionAll(sides[1]).groupBy("bucket", "rows", "digest").agg(F.count(F.lit(1)).alias("sides"))
    return sorted(r.bucket for r in both.where("sides < 2").select("bucket").distinct().collect())


def located_diff(
    expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """``diff.row_diff_by_key`` over the rows of the differing buckets, with their ``bucket``."""
    wanted = differing_buckets(expected, actual, key, columns, buckets)
    inside = _bucket(key, buckets).isin(wanted) if wanted else F.lit(False)
    return row_diff_by_key(expected.where(inside), actual.where(inside), key, columns).withColumn(
        "bucket", _bucket(key, buckets)
    )


def rebuild_audit(
    before: TableSet, after: TableSet, key: str, columns: Sequence[str], starts: DataFrame | None = None
) -> DataFrame:
    """One row on a rebuild in a fresh lineage.

    ``starts`` are the offsets the rebuild began at (``cdc_log.offsets_for_timestamp``); a rebuild
    from a timestamp has to begin after offset 0 on every partition that has records.
    """
    spark = before.spark
    diff = located_diff(before.current(), after.current(), key, columns).groupBy("bucket", "state").agg(
        F.count(F.lit(1)).alias("n")
    )

    def keys(state: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("state") == state, F.col("n"))), F.lit(0)).alias(f"{state}_keys")

    found = diff.agg(F.count_distinct("bucket").alias("differing_buckets"), *[keys(s) for s in ("missing", "unexpected", "changed")])
    lineages = before.scan("commits").where(F.col("epoch").isin(before.epoch, after.epoch))
    made = lineages.agg(F.count_distinct("epoch").alias("lineages"), F.count(F.lit(1)).alias("snapshots"))
    begun = (
        spark.range(1).select(F.lit(None).cast("boolean").alias("resolved_after_zero"))
        if starts is None
        else starts.where("log_end_offset > 0").agg(F.every(F.col("resolved_start_offset") > 0).alias("resolved_after_zero"))
    )
    row = found.unionByName(made, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    row = row.agg(*[F.max(c).alias(c) for c in [*found.columns, *made.columns, *begun.columns]])
    matches = (F.col("differing_buckets") == 0) & (F.col("lineages") == 2)
    return row.withColumn("matches", matches & F.coalesce("resolved_after_zero", F.lit(starts is None)))
