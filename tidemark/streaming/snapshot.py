"""Initial snapshot beside a running stream, chunk by chunk.

The source table is read in key ranges while the log goes on. Around each chunk the ends of the
log are marked: what the log says about a key between the low and the high mark supersedes the
chunk's row, which is left out. The rows of a chunk are one patch; they sort before every logged
change, so whatever the stream has or will read of a key wins over its snapshot row, in whichever
order they are committed. A chunk counts once its patch is committed; another run of a failed
snapshot goes on with the chunks that are left, over the ranges of the first run.

The hand-over is complete when all chunks are committed and the stream has passed the highest
mark of every chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.operators.decode import changes, decode
from tidemark.operators.offsets import log_end_offsets
from tidemark.schemas import CHANGE, ORDER_COLUMNS
from tidemark.session import literal_table
from tidemark.sources.cdc_log import MOST_LOG_PARTITIONS, read_log
from tidemark.sources.tables import TableSet

KIND = "snapshot"
MOST_CHUNKS = 100_000
_PLAN = "chunk bigint, first_id bigint, last_id bigint"


def _ends(tables: TableSet, log_path: str) -> dict[str, int]:
    """The log's ends by ``topic:partition``; one row per log partition."""
    rows = log_end_offsets(read_log(tables.spark, log_path)).collect()
    return {f"{r.topic}:{r.partition}": r.log_end_offset for r in rows}


def plan_chunks(tables: TableSet, source: DataFrame, chunk_rows: int) -> DataFrame:
    """(chunk, first_id, last_id): key ranges of about ``chunk_rows`` rows, the same in every run."""
    path = f"{tables.root}/snapshot_plan/epoch={tables.epoch}"
    try:
        stored = tables.spark.read.schema(_PLAN).parquet(path)
        if not stored.isEmpty():  # empty: the first run ended before it had a plan
            return stored
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    n = source.count()
    chunks = max(1, -(-n // chunk_rows))
    if chunks > MOST_CHUNKS:
        raise ValueError(f"{chunks} chunks are too many; take more rows a chunk")
    shares = [i / chunks for i in range(1, chunks)]
    cuts = source.select(F.percentile_approx("order_id", shares, 10_000)).first()[0] if shares else []
    # Everything below the first cut and above the last belongs to a chunk too.
    bounds = [-(1 << 63), *sorted({c + 1 for c in cuts or []}), 1 << 63]
    rows = [(i, a, b - 1) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    tables.spark.createDataFrame(rows, _PLAN).coalesce(1).write.mode("overwrite").parquet(path)
    return tables.spark.read.schema(_PLAN).parquet(path)


def _superseded(tables: TableSet, log_path: str, low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """Keys with a change between the marks."""
    marks = [(*place.rsplit(":", 1), low.get(place, 0), end) for place, end in high.items() if end > low.get(place, 0)]
    rows = [(topic, int(partition), a, b) for topic, partition, a, b in marks]
    wanted = tables.spark.createDataFrame(rows, "topic string, partition int, `from` bigint, `to` bigint")
    wanted = literal_table(wanted, MOST_LOG_PARTITIONS, "log partition")
    least = min((r[2] for r in rows), default=0)
    log = read_log(tables.spark, log_path).where(F.col("offset") >= least)
    between = log.join(wanted, ["topic", "partition"]).where((F.col("offset") >= F.col("from")) & (F.col("offset") < F.col("to")))
    return changes(decode(between.select(*log.columns))).select("order_id").distinct()


def _images(rows: DataFrame, topic: str, taken_ms: int) -> DataFrame:
    """Snapshot rows as images in front of every logged change."""
    values = {
        "topic": F.lit(topic),
        "partition": F.lit(-1),
        "offset": F.lit(-1),
        "timestamp_ms": F.lit(taken_ms),
        "image_seq": F.lit(0),
        "cdc_row_kind": F.lit("+I"),
        "cdc_operation": F.lit("snapshot"),
        "source_ts_ms": F.lit(taken_ms),
        **{c: F.col(c) for c in ORDER_COLUMNS},
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in CHANGE.fields])


def committed_chunks(tables: TableSet) -> DataFrame:
    """(chunk, patch, rows, low, high) of the chunks that are done."""
    return tables.patch_commits().where(F.col("kind") == KIND).select(
        F.col("name").cast("bigint").alias("chunk"), F.col("batch").alias("patch"), "rows", "low", "high"
    )


def run_snapshot(
    tables: TableSet,
    read_source: Callable[[], DataFrame],
    log_path: str,
    topic: str,
    taken_ms: int,
    chunk_rows: int = 10_000_000,
    after_chunk: Callable[[int], None] | None = None,
) -> int:
    """Read what is left of the snapshot; returns the number of chunks committed by this run.

    ``read_source`` gives the source table as it is when called. ``after_chunk`` is called with
    the number of each chunk after its commit. One writer of patches at a time.
    """
    tables.ensure()
    plan = plan_chunks(tables, read_source(), chunk_rows).orderBy("chunk").collect()  # MOST_CHUNKS rows at most
    done = {r.chunk for r in committed_chunks(tables).select("chunk").collect()}
    for chunk, first, last in plan:
        if chunk in done:
            continue
        low = _ends(tables, log_path)
        rows = read_source().where(F.col("order_id").between(first, last)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows.count()  # read before the high mark is taken
            high = _ends(tables, log_path)
            if high != low:
                rows = rows.join(_superseded(tables, log_path, low, high), "order_id", "left_anti")
            patch = tables.last_patch() + 1
            tables.write_part("patches", patch, _images(rows, topic, taken_ms))
            written = tables.scan("patches").where((F.col("epoch") == tables.epoch) & (F.col("batch") == patch))
            tables.commit_patch(patch, KIND, str(chunk), written.count(), low, high)
        finally:
            rows.unpersist()
        if after_chunk is not None:
            after_chunk(chunk)
    return len(plan) - len(done)


def hand_over(tables: TableSet) -> DataFrame:
    """One row: chunks planned and committed, snapshot rows, and whether the stream is past all marks."""
    marks = committed_chunks(tables)
    planned = tables.spark.read.schema(_PLAN).parquet(f"{tables.root}/snapshot_plan/epoch={tables.epoch}")
    ends = marks.select(F.explode("high").alias("place", "end")).groupBy("place").agg(F.max("end").alias("end"))
    reached = tables.offsets()
    at = F.create_map(*[F.lit(x) for item in reached.items() for x in item]) if reached else F.create_map().cast("map<string,bigint>")
    passed = F.coalesce(F.element_at(at, F.col("place")), F.lit(0)) >= F.col("end")
    parts = [
        planned.agg(F.count(F.lit(1)).alias("planned_chunks")),
        marks.agg(F.count(F.lit(1)).alias("committed_chunks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("snapshot_rows")),
        ends.agg(F.coalesce(F.every(passed), F.lit(True)).alias("past_marks")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.unionByName(part, allowMissingColumns=True)
    names = ["planned_chunks", "committed_chunks", "snapshot_rows", "past_marks"]
    row = row.agg(*[F.max(c).alias(c) for c in names])
    complete = (F.col("planned_chunks") == F.col("committed_chunks")) & F.col("past_marks")
    return row.withColumn("complete", complete)
