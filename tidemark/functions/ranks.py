"""Exact percentiles that never gather a group in one task.

Values are first counted per distinct value (pre-aggregated before the
shuffle), then a blocked running count finds the value at each wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocked import Running, running
from tidemark.functions.columns import floor_div


def _ranked(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """Distinct values with the rank range [first, last] their copies occupy, and group size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    )
    ranked = running(
        counts,
        keys,
        [value],
        floor_div(F.col(value), width),
        [Running("__last", "sum", "__n"), Running("__size", "total", "__n")],
    )
    return ranked.withColumn("__first", F.col("__last") - F.col("__n") + 1)


def _pick(value: str, rank: Column) -> Column:
    return F.max(F.when((F.col("__first") <= rank) & (F.col("__last") >= rank), F.col(value)))


def percentile_nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    width: int = 65_536,
) -> DataFrame:
    """The ``max(1, ceil(p/100*n))``-th smallest value of each group, per wanted percentile.

    ``wanted`` maps result names to percentiles in 0..100, ``value`` is an
    integer column and ``width`` the span of values one task ranks.
    Empty groups do not appear in the result.
    """
    for name, p in wanted.items():
        if not 0 <= p <= 100:
            raise ValueError(f"percentile {name}={p} is not between 0 and 100")
    picks = []
    for name, p in wanted.items():
        # p is scaled to an integer so that ceil sees no binary rounding error
        scaled = F.lit(int(round(p * 10_000))).cast("decimal(10,0)")
        rank = F.greatest(
            F.lit(1), F.ceil(scaled * F.col("__size") / F.lit(1_000_000).cast("decimal(10,0)"))
        )
        picks.append(_pick(value, rank).alias(name))
    return _ranked(df, keys, value, width).groupBy(*keys).agg(*picks)


def median_interpolated(
    df: DataFrame, keys: Sequence[str], value: str, name: str, width: int = 65_536
) -> DataFrame:
    """Middle value, or the mean of the two middle values, as a double."""
    low = F.floor((F.col("__size") + 1) / 2)
    high = F.floor((F.col("__size") + 2) / 2)
    return (
        _ranked(df, keys, value, width)
        .groupBy(*keys)
        .agg(_pick(value, low).alias("__low"), _pick(value, high).alias("__high"))
        .select(*keys, ((F.col("__low") + F.col("__high")) / 2).cast("double").alias(name))
    )
