"""Hold the newest change per key until the key has been quiet for a while.

A quiet period is the gap of a session window over arrival times: each change of a key extends
its session, and when the gap has passed the session closes with the newest change of the key.
Sessions live in the state store of the JVM, one row per pending key, and changes of a key and
map task are merged before the shuffle. A clock stream of one row a second lets time pass
while no change arrives; its rows have no gap, so they open no session and leave no state.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.state import ARRIVAL, latest_per_key
from tidemark.schemas import CHANGE

_FIELDS = CHANGE.fieldNames()
# Sessions of a hot key are merged where they arise, not only after the shuffle.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def coalesce_changes(images: DataFrame, quiet_ms: int) -> DataFrame:
    """Streaming images in, the newest image per key out after ``quiet_ms`` without a change.

    A key that speaks again after its quiet period comes out again, so the sink
    has to be a keyed upsert. Bounded inputs use ``latest_per_key`` instead. Rows without a key are left out.
    """
    if quiet_ms <= 0:
        raise ValueError("quiet_ms must be positive")
    spark = images.sparkSession
    spark.conf.set(LOCAL_MERGE, "true")
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    ticks = clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGE.fields])
    timed = images.select(*_FIELDS).unionByName(ticks).withColumn("arrived", F.current_timestamp())
    gap = F.when(F.col("order_id").isNull(), "0 seconds").otherwise(f"{quiet_ms} milliseconds")
    session = F.session_window("arrived", gap)
    newest = F.max_by(F.struct(*_FIELDS), F.struct(*ARRIVAL)).alias("newest")
    closed = timed.withWatermark("arrived", "0 seconds").groupBy("order_id", session).agg(newest)
    return closed.select("newest.*")


def start_coalesced(
    images: DataFrame, quiet_ms: int, path: str, checkpoint: str, interval: str = "1 second"
) -> StreamingQuery:
    """Write coalesced changes below ``path``, one replaceable folder per batch.

    Quiet periods end by the clock, so the query runs until it is stopped.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        coalesce_changes(images, quiet_ms)
        .writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def pending_keys(query: StreamingQuery) -> int | None:
    """Keys whose quiet period runs, after the newest batch; None before the first one."""
    progress = query.lastProgress
    if not progress or not progress["stateOperators"]:
        return None
    return progress["stateOperators"][0]["numRowsTotal"]


def all_quiet(query: StreamingQuery) -> bool:
    """True if the newest batch read no change and no key is pending: what has come in has come out.

    Looks at the progress report only.
    """
    progress = query.lastProgress
    if not progress or pending_keys(query) != 0:
        return False
    seen = [s for s in progress["sources"] if not s["description"].startswith("RateStream")]
    return progress["batchId"] > 0 and all(s["numInputRows"] == 0 for s in seen)


def stop_between_batches(query: StreamingQuery) -> None:
    """Stop a clock-driven query while it idles, so that no batch is cut off half way."""
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(0.02)
    query.stop()


def quiet_images(stored: DataFrame) -> DataFrame:
    """Stored coalesced changes without the ones a later emission of the key replaced."""
    return latest_per_key(stored.select(*_FIELDS))
