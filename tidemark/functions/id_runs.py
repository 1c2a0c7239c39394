"""Sets of integer ids as runs of consecutive ids.

An expected set such as the ids of a workload is a few runs (first, last); it is compared with a
table's ids without writing it out. Runs are cut at multiples of BLOCK, so that ids and runs
meet by block and the size of an intersection adds up over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import floor_div

BLOCK = 65_536


def runs_of(ids: DataFrame, column: str) -> DataFrame:
    """(block, first, last) of the distinct non-null ids; at most BLOCK of them meet in one window."""
    distinct = ids.select(F.col(column).cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct()
    blocks = distinct.withColumn("block", floor_div(F.col("id"), BLOCK))
    # ids less their rank are equal inside a run and nowhere else
    run = F.col("id") - F.row_number().over(Window.partitionBy("block").orderBy("id"))
    return blocks.withColumn("run", run).groupBy("block", "run").agg(
        F.min("id").alias("first"), F.max("id").alias("last")
    ).drop("run")


def cut_runs(runs: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Given runs as disjoint (block, first, last), cut at block borders; overlapping ones are merged.

    Runs with an end before their start are empty.
    """
    given = runs.select(F.col(first).cast("bigint").alias("a"), F.col(last).cast("bigint").alias("b")).where("a <= b").distinct()
    block = F.explode(F.sequence(floor_div(F.col("a"), BLOCK), floor_div(F.col("b"), BLOCK)))
    cut = given.withColumn("block", block).select(
        "block",
        F.greatest("a", F.col("block") * BLOCK).alias("a"),
        F.least("b", (F.col("block") + 1) * BLOCK - 1).alias("b"),
    ).distinct()
    inside = Window.partitionBy("block").orderBy("a", "b")
    reach = F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int")
    marked = cut.withColumn("opens", opens).withColumn("run", F.sum("opens").over(inside))
    return marked.groupBy("block", "run").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("run")


def compare_runs(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ids on either side, common to both, missing and unexpected. Both are disjoint runs by block."""

    def total(runs: DataFrame, name: str) -> DataFrame:
        return runs.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias(name))

    other = expected.select("block", F.col("first").alias("f"), F.col("last").alias("l"))
    shared = actual.join(other, "block").select(
        (F.least("last", "l") - F.greatest("first", "f") + 1).alias("n")
    ).where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("common_ids"))
    row = total(actual, "actual_ids").unionByName(total(expected, "expected_ids"), allowMissingColumns=True)
    row = row.unionByName(shared, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("actual_ids", "expected_ids", "common_ids")])
    return row.select(
        "*",
        (F.col("expected_ids") - F.col("common_ids")).alias("missing_ids"),
        (F.col("actual_ids") - F.col("common_ids")).alias("unexpected_ids"),
    )


def within_runs(rows: DataFrame, column: str, runs: DataFrame) -> DataFrame:
    """Rows whose id lies in one of the disjoint runs by block."""
    keyed = rows.withColumn("__block", floor_div(F.col(column), BLOCK))
    wanted = runs.select(F.col("block").alias("__block"), F.col("first").alias("__first"), F.col("last").alias("__last"))
    hit = (F.col(column) >= F.col("__first")) & (F.col(column) <= F.col("__last"))
    return keyed.join(wanted, "__block").where(hit).select(*rows.columns)
