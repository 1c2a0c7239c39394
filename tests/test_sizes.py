"""What follows the size of the tables and what must not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import fixtures as fx
from tidemark.plans import queries, stream_queries
from tidemark.sources import cdc_log


def test_number_of_batches_does_not_grow_with_the_log():
    for records in (330_000, 20_000_000, 120_000_000):
        files = queries._log_files(records, 4 * queries.FILES_PER_BATCH)
        assert -(-files // queries._per_batch(files)) <= queries.MOST_BATCHES
    assert queries._per_batch(32) == queries.FILES_PER_BATCH  # short logs keep their batches


def test_number_of_limited_files_does_not_grow_with_the_log():
    assert stream_queries._row_limit(2_000_000) == 1000
    assert 120_000_000 // stream_queries._row_limit(120_000_000) == stream_queries.MOST_FILES


def test_rows_that_become_documents_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "SPREAD_ROWS", 100)
    spark.range(1000).select(
        F.col("id").alias("p_partkey"), F.col("id").alias("c_custkey"), F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"),
        F.lit(1.0).alias("o_totalprice"), F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"),
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("customer", "orders"):
        spark.read.parquet(f"{tmp_path}/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for build in (fx.schema_registry, fx.nested_registry, fx.kind_records, fx.ordering_probe):
        derived = build(spark, str(tmp_path)).select(F.spark_partition_id().alias("task"))
        sizes = [r["count"] for r in derived.groupBy("task").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 1000, build.__name__


def test_slices_arrive_in_order_in_files_of_limited_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "RECORDS_PER_FILE", 10)
    log = spark.range(100).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(7).cast("bigint").alias("timestamp_ms"),
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"),
    )
    path = f"{tmp_path}/log"
    per_batch = stream_queries._in_slices((log.coalesce(1).where(F.col("offset") % 2 == i) for i in (0, 1)), path)
    assert per_batch == queries.FILES_PER_BATCH
    files = cdc_log.read_log(spark, path).select("offset", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    found = files.groupBy("f", "m").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("offset") % 2).alias("a"), F.max(F.col("offset") % 2).alias("b")).collect()
    assert {r.n for r in found} == {10} and all(r.a == r.b for r in found)  # records of one time are no longer one file
    assert max(r.m for r in found if r.a == 0) <= min(r.m for r in found if r.a == 1)
