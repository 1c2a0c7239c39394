"""Running values over groups of any size.

A plain window sorts a whole group in one task, so one key with a third of all
rows would stop the job. Here every group is cut into blocks along its order
(for example ``offset div 65536``). A first aggregate reduces each block to one
row, a window over those few rows carries values from block to block, and the
row-level window runs per (group, block). The result equals the plain window.

``block`` has to be non-decreasing in the order columns, and unequal order
values may share a block but no order value may span two.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, max, min (over the rows up to and including this one), lag
    (the value one row before) or total (the sum over the whole group);
    ``kind='count'`` ignores ``value``."""

    name: str
    kind: str
    value: str | None = None


def _combine(kind: str, before: Column, within: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before + within, within, before)
    if kind == "max":
        return F.greatest(before, within)
    if kind == "min":
        return F.least(before, within)
    raise ValueError(f"unknown running kind {kind!r}")


def _aggregate(kind: str, value: str | None) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    return {"sum": F.sum, "max": F.max, "min": F.min, "total": F.sum}[kind](F.col(value))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    specs: Sequence[Running],
) -> DataFrame:
    """Add one column per spec, as a window over ``keys`` ordered by ``order`` would."""
    rows = df.withColumn(_BLOCK, block)
    group = [*keys, _BLOCK]
    position = F.struct(*[F.col(c) for c in order])

    per_block, carried = [], []
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    for s in specs:
        tail = f"__tail_{s.name}"
        if s.kind == "lag":
            # wrapped in a struct so that a null value still counts as a value
            per_block.append(F.max_by(F.struct(F.col(s.value).alias("v")), position).alias(tail))
            carried.append(F.lag(tail).over(across).alias(f"__carry_{s.name}"))
        else:
            per_block.append(_aggregate(s.kind, s.value).alias(tail))
            fold = "sum" if s.kind == "count" else s.kind
            frame = Window.partitionBy(*keys) if s.kind == "total" else earlier
            carried.append(_aggregate(fold, tail).over(frame).alias(f"__carry_{s.name}"))
    carry = rows.groupBy(*group).agg(*per_block).select(*group, *carried)

    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for s in specs:
        within = f"__within_{s.name}"
        if s.kind == "total":
            continue
        if s.kind == "lag":
            rows = rows.withColumn(
                within, F.lag(F.struct(F.col(s.value).alias("v"))).over(inside)
            )
        elif s.kind == "count":
            rows = rows.withColumn(within, F.row_number().over(inside).cast("bigint"))
        else:
            rows = rows.withColumn(within, _aggregate(s.kind, s.value).over(upto))

    joined = rows.join(carry, group, "left")
    out = [F.col(c) for c in df.columns]
    for s in specs:
        within, before = F.col(f"__within_{s.name}"), F.col(f"__carry_{s.name}")
        if s.kind == "total":
            out.append(before.alias(s.name))
        elif s.kind == "lag":
            out.append(F.coalesce(within, before).getField("v").alias(s.name))
        else:
            out.append(_combine(s.kind, before, within).alias(s.name))
    return joined.select(*out)


def row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """1-based dense position in the group."""
    return running(df, keys, order, block, [Running(name, "count")])


def lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str
) -> DataFrame:
    """Value of the row before, null on the first row of the group."""
    return running(df, keys, order, block, [Running(name, "lag", value)])


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Inner join of one row per key onto the rows of that key, however many those are.

    The key's row is copied once per block of the key, and rows meet it per
    (key, block), so a hot key spreads over as many tasks as it has blocks.
    """
    marked = rows.withColumn(_BLOCK, block)
    spread = marked.select(*keys, _BLOCK).distinct().join(per_key, list(keys))
    return marked.join(spread, [*keys, _BLOCK]).drop(_BLOCK)
