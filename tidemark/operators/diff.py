"""Row-level comparison of relations.

Both sides go through one aggregate instead of two anti joins: rows are tagged,
counted per side with map-side combining, and one shuffle answers both
directions. A row repeated a billion times is one counter, not a hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import row_hash
from tidemark.functions.digests import digest_aggregates, digest_of_aggregates

MISSING, UNEXPECTED = "missing_from_actual", "unexpected_in_actual"


def _counted(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    tagged = expected.select(*columns, F.lit(1).alias("__e"), F.lit(0).alias("__a")).unionAll(
        actual.select(*columns, F.lit(0).alias("__e"), F.lit(1).alias("__a"))
    )
    return tagged.groupBy(*columns).agg(F.sum("__e").alias("__e"), F.sum("__a").alias("__a"))


def row_diff(expected: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Set difference both ways, with a ``side`` column. Copies of a row do not matter."""
    columns = list(columns or expected.columns)
    return (
        _counted(expected, actual, columns)
        .where((F.col("__e") == 0) | (F.col("__a") == 0))
        .select(
            *columns,
            F.when(F.col("__a") == 0, F.lit(MISSING)).otherwise(F.lit(UNEXPECTED)).alias("side"),
        )
    )


def row_diff_all(expected: DataFrame, actual: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Multiset difference both ways: ``copies`` says how often the row is short or over."""
    columns = list(columns or expected.columns)
    gap = F.col("__e") - F.col("__a")
    return (
        _counted(expected, actual, columns)
        .where(gap != 0)
        .select(
            *columns,
            F.when(gap > 0, F.lit(MISSING)).otherwise(F.lit(UNEXPECTED)).alias("side"),
            F.abs(gap).cast("bigint").alias("copies"),
        )
    )


def row_diff_by_key(
    expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Keyed difference: ``state`` and the comma separated names of changed columns.

    ``state`` is missing, unexpected, changed or duplicate_key (a key that one
    side holds more than once has no single counterpart to compare with).
    """
    packed = F.struct(*columns)
    tagged = expected.select(key, packed.alias("__r"), F.lit(1).alias("__s")).unionAll(
        actual.select(key, packed.alias("__r"), F.lit(2).alias("__s"))
    )
    sides = tagged.groupBy(key).agg(
        F.max(F.when(F.col("__s") == 1, F.col("__r"))).alias("__e"),
        F.max(F.when(F.col("__s") == 2, F.col("__r"))).alias("__a"),
        F.count_if(F.col("__s") == 1).alias("__ne"),
        F.count_if(F.col("__s") == 2).alias("__na"),
    )
    changed = F.concat_ws(
        ",",
        *[
            F.when(~F.col(f"__e.{c}").eqNullSafe(F.col(f"__a.{c}")), F.lit(c))
            for c in columns
        ],
    )
    state = (
        F.when((F.col("__ne") > 1) | (F.col("__na") > 1), F.lit("duplicate_key"))
        .when(F.col("__na") == 0, F.lit("missing"))
        .when(F.col("__ne") == 0, F.lit("unexpected"))
        .when(changed != "", F.lit("changed"))
    )
    return (
        sides.select(
            key, state.alias("state"), F.when(state == "changed", changed).alias("changed_columns")
        )
        .where(F.col("state").isNotNull())
    )


def reconcile(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: set differences, row counts and digests of both sides."""
    hashed = _counted(expected, actual, columns).withColumn(
        "__h", row_hash(*[F.col(c) for c in columns])
    )
    return hashed.agg(
        F.count_if(F.col("__a") == 0).alias("missing_rows"),
        F.count_if(F.col("__e") == 0).alias("unexpected_rows"),
        *digest_aggregates("__h", "__de", F.col("__e")),
        *digest_aggregates("__h", "__da", F.col("__a")),
    ).select(
        (F.col("missing_rows") + F.col("unexpected_rows")).alias("diff_count"),
        "missing_rows",
        "unexpected_rows",
        F.col("__de0").cast("bigint").alias("expected_rows"),
        F.col("__da0").cast("bigint").alias("actual_rows"),
        digest_of_aggregates("__de").alias("expected_digest"),
        digest_of_aggregates("__da").alias("actual_digest"),
    )
