"""Constraints of the source table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import ORDER_COLUMNS

# ---------------------------------------------------------------- fixed values
UNIQUE = ("order_id", "business_key", "event_id")
LENGTHS = {"business_key": 64, "status": 32}
# ------------------------------------------------------------------------------


def key_constraints(orders: DataFrame) -> DataFrame:
    """(constraint, violations): repeated values, nulls and over-long texts."""
    rows = orders.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"not_null.{c}") for c in ORDER_COLUMNS],
        *[F.count_if(F.length(c) > n).alias(f"length.{c}") for c, n in LENGTHS.items()],
    )
    names = [*[f"not_null.{c}" for c in ORDER_COLUMNS], *[f"length.{c}" for c in LENGTHS]]
    out = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("constraint_name"), F.col(f"`{n}`").alias("violations"))
                    for n in names
                ]
            )
        )
    )
    for c in UNIQUE:
        repeated = (
            orders.where(F.col(c).isNotNull())
            .groupBy(c)
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count_if(F.col("n") > 1).alias("violations"))
            .select(F.lit(f"unique.{c}").alias("constraint_name"), "violations")
        )
        out = out.unionByName(repeated)
    return out
