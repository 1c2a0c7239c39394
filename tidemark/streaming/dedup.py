"""Bounded redelivery: a record that comes again within some time is dropped in the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ["topic", "partition", "offset"]


def drop_redelivered(log: DataFrame, within: str) -> DataFrame:
    """The streaming log with each log position once.

    Positions are remembered until the watermark, ``within`` behind the newest record time, has
    passed them, so state follows the rate of records and not the length of the log. A record
    older than the watermark is dropped, a copy as well as a first delivery that late: choose
    ``within`` longer than deliveries may be late or repeated.
    """
    timed = log.withColumn("__at", F.timestamp_millis("timestamp_ms")).withWatermark("__at", within)
    return timed.dropDuplicatesWithinWatermark(POSITION).drop("__at")


def most_state_rows(progress: list) -> int:
    """The largest number of positions remembered in any of the progress reports."""
    return max((s["numRowsTotal"] for p in progress for s in p["stateOperators"]), default=0)
