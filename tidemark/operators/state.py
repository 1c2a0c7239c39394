"""Current state out of row images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.decode import drop_update_before
from tidemark.schemas import DELETE, ORDER_COLUMNS

ARRIVAL = ("partition", "offset", "image_seq")


def latest_per_key(
    images: DataFrame, keys: Sequence[str] = ("order_id",), order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """The last image of every key by log position.

    The rank filter lets each map task keep one row per key before the shuffle
    (WindowGroupLimit), so a hot key costs one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (
        images.withColumn("__rank", F.row_number().over(newest))
        .where(F.col("__rank") == 1)
        .drop("__rank")
    )


def current_state(images: DataFrame, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    """Live rows: last image per key, deleted keys removed."""
    latest = latest_per_key(drop_update_before(images), keys)
    return latest.where(F.col("cdc_row_kind") != DELETE).select(*ORDER_COLUMNS)


def current_state_as_of(images: DataFrame, commit_column: str, commit_id: int) -> DataFrame:
    """Live rows visible in one commit (time travel)."""
    return current_state(images.where(F.col(commit_column) <= F.lit(commit_id)))
