"""Connected components of a link table, as Spark jobs.

Each round, every node points to its smallest neighbour if that is smaller than itself;
pointers are followed to their ends by doubling, and the links are rewritten to those ends.
At least every second node with a link left loses its own label in a round, so the rounds
are few. Nothing is collected: minima combine on the map side, and every join reads two
written tables, so that Spark can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _follow(pointers: DataFrame) -> DataFrame:
    """(node, root) where every root points to itself."""
    while True:
        ends = pointers.select(F.col("node").alias("_end"), F.col("root").alias("_next"))
        jumped = pointers.join(ends, pointers["root"] == ends["_end"], "left")
        further = F.coalesce("_next", "root")
        jumped = written(
            jumped.select("node", further.alias("root"), (further != F.col("root")).alias("moved")), "jump"
        )
        pointers = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return pointers


def _mapped(table: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``table`` with ``column`` replaced by its root, where it has one."""
    ends = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = table.join(ends, table[column] == ends["_node"], "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``a`` and ``b``, longs).

    ``root`` is the smallest node reachable. Links with a null end and loops are ignored;
    the direction and repetition of links do not matter.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = written(
        ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        pointers = nearest.select("node", F.least("node", "least").alias("root"))
        roots = _follow(written(pointers, "pointers"))
        if found is None:
            found = roots
        else:  # nodes of this round are roots of the rounds before
            found = written(_mapped(found, "root", roots), "roots")
        moved = written(_mapped(left, "a", roots), "links")
        moved = _mapped(moved, "b", roots).where("a <> b")
        left = written(
            moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
        )
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
