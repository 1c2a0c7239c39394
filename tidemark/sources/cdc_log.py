"""The change log: batch and streaming readers, appends with assigned offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blocked
from tidemark.schemas import LOG_RECORD
from tidemark.session import literal_table

START_MODES = ("earliest", "committed", "timestamp")
MOST_LOG_PARTITIONS = 100_000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_RECORD).parquet(path)


def read_log_range(
    spark: SparkSession, path: str, low: int = 0, high: int | None = None, max_records: int | None = None
) -> DataFrame:
    """Records with ``low <= offset < high`` of all partitions.

    With ``max_records`` the first records by (partition, offset) come back, in
    that order; Spark plans it as a per-task top-n.
    """
    log = read_log(spark, path).where(F.col("offset") >= low)
    if high is not None:
        log = log.where(F.col("offset") < high)
    return log if max_records is None else first_records(log, max_records)


def first_records(log: DataFrame, max_records: int) -> DataFrame:
    return log.orderBy("partition", "offset").limit(max_records)


def offsets_for_timestamp(log: DataFrame, timestamp_ms: int) -> DataFrame:
    """Per partition: the first offset at or after the timestamp, or the log end."""
    hit = F.min(F.when(F.col("timestamp_ms") >= F.lit(timestamp_ms), F.col("offset")))
    end = F.max("offset") + 1
    return log.groupBy("topic", "partition").agg(
        F.coalesce(hit, F.lit(-1)).cast("bigint").alias("requested_offset"),
        F.coalesce(hit, end).cast("bigint").alias("resolved_start_offset"),
        end.cast("bigint").alias("log_end_offset"),
    )


def from_starts(log: DataFrame, starts: DataFrame) -> DataFrame:
    """Records at or after each partition's start; partitions new since then are read whole."""
    wanted = starts.select("topic", "partition", F.col("resolved_start_offset").alias("__start"))
    # a log partition may hold a third of the records: their payloads must not be shuffled by it
    wanted = literal_table(wanted, MOST_LOG_PARTITIONS, "log partition")
    return (
        log.join(wanted, ["topic", "partition"], "left")
        .where(F.col("offset") >= F.coalesce("__start", F.lit(0)))
        .drop("__start")
    )


def stream_log(
    spark: SparkSession,
    path: str,
    start: str = "earliest",
    starts_path: str | None = None,
    timestamp_ms: int | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """The log as a stream.

    ``earliest`` and ``committed`` read the whole directory; what a query has
    committed lives in its checkpoint, and without one it falls back to the
    earliest record. ``timestamp`` resolves start offsets once and keeps them in
    ``starts_path``, so that a restart does not move them.
    """
    if start not in START_MODES:
        raise ValueError(f"start must be one of {START_MODES}, got {start!r}")
    if start == "timestamp" and (timestamp_ms is None or timestamp_ms < 0):
        raise ValueError("start='timestamp' needs timestamp_ms >= 0")
    reader = spark.readStream.schema(LOG_RECORD)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(path)
    if start != "timestamp":
        return stream
    if starts_path is None:
        raise ValueError("start='timestamp' needs starts_path to keep the resolved offsets")
    # 'ignore' leaves the offsets of an earlier run in place
    offsets_for_timestamp(read_log(spark, path), timestamp_ms).write.mode("ignore").parquet(
        starts_path
    )
    return from_starts(stream, spark.read.parquet(starts_path))


def stream_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    start: str = "earliest",
    timestamp_ms: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> DataFrame:
    """The same record shape from a Kafka topic, where the connector is installed."""
    if start not in START_MODES:
        raise ValueError(f"start must be one of {START_MODES}, got {start!r}")
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    if start == "timestamp":
        if timestamp_ms is None or timestamp_ms < 0:
            raise ValueError("start='timestamp' needs timestamp_ms >= 0")
        reader = reader.option("startingTimestamp", timestamp_ms)
    else:
        reader = reader.option("startingOffsets", "earliest")
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(
        "topic",
        "partition",
        "offset",
        F.unix_millis("timestamp").alias("timestamp_ms"),
        "key",
        "value",
    )


def _ends(log: DataFrame) -> DataFrame:
    """(topic, partition, __end) as a literal table: one row per log partition."""
    ends = log.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("__end"))
    return literal_table(ends, MOST_LOG_PARTITIONS, "log partition")


def _placed(records: DataFrame, ends: DataFrame, order: Sequence[str], block: Column) -> DataFrame:
    numbered = blocked.row_number(records, ["topic", "partition"], order, block, "__n")
    return (
        numbered.join(ends, ["topic", "partition"], "left")
        .withColumn("offset", (F.coalesce("__end", F.lit(0)) + F.col("__n") - 1).cast("bigint"))
        .drop("__end", "__n")
    )


def assign_offsets(
    log: DataFrame, records: DataFrame, order: Sequence[str], block: Column
) -> DataFrame:
    """New records with the next free offsets of their partition, in ``order``.

    ``block`` cuts the new records of a partition into bounded runs, see
    ``functions.blocked``.
    """
    return _placed(records, _ends(log), order, block)


def append_log(
    spark: SparkSession, path: str, records: DataFrame, order: Sequence[str], block: Column
) -> DataFrame:
    """Append records to the log at ``path``; returns their topic, partition and offset.

    One writer at a time: the next offset is read from the log itself, once; what lies at or
    beyond the ends of before is new.
    """
    ends = _ends(read_log(spark, path))
    placed = _placed(records, ends, order, block)
    placed.select(*[F.col(f.name).cast(f.dataType) for f in LOG_RECORD.fields]).write.mode("append").parquet(path)
    grown = read_log(spark, path).select("topic", "partition", "offset").join(ends, ["topic", "partition"], "left")
    return grown.where(F.col("offset") >= F.coalesce("__end", F.lit(0))).drop("__end")
