"""Shards by a hierarchical weighted hash tree: region, rack, shard.

A document descends the tree from the root. At each node every child draws an exponential
time from the hash of the document's id and the child's path, with the child's weight as its
rate, and the earliest child wins, so children win in proportion to their weights. The weight
of an inner node is the sum of its shards. A draw depends on nothing but id, path and weight:
if a weight changes, rows move only into the subtrees that gained and out of those that lost;
below a node whose own subtree did not change, nothing moves.

A shard that ``grown`` adds stands in a region of its own. No other weight changes then, so
the rows which that region wins are the only ones that move, and they all go to the new shard.

Slots number the rows of a shard from 0 without gaps. Rows are ordered by a hash cell, then by
id and content; rows are counted per cell first, and only these counts meet per shard. Equal
rows are counted on the map side and apart for each input partition, so that an id or text
with a third of all rows reaches a cell as few rows. The text itself is never shuffled.

Defined cases: a null ``doc_id`` is hashed as the text ''. A null text has no bytes and the
checksum of the empty text. Rows with one id share a shard, whatever their texts; equal rows
get slots of their own. An empty table gives an empty result. ``place`` keeps all other
columns; its own columns replace those of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written
from tidemark.llm.crc32_sql import CRC_TABLE, crc32_of

#: Fixed values of the query contract: bytes that each row adds, and the law that holds.
ROW_BYTES = 8
LAW = "key"
#: Hexadecimal digits of the cell that rows of a shard are ordered by: 4096 cells a shard.
CELL_DIGITS = 3
#: Of a SHA-256 value these hexadecimal digits make a draw: 52 bits, exact in a double.
_DRAW_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    number: int
    region: str
    rack: str
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        return (self.region, f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.number}")


def even_tree(regions: int, racks: int, shards: int) -> list[Shard]:
    """``regions`` with ``racks`` each with ``shards`` each, numbered in that order."""
    return [
        Shard((r * racks + k) * shards + s, f"r{r}", f"k{k}") for r in range(regions) for k in range(racks) for s in range(shards)
    ]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` with one more shard, in a region of its own: rows move only into it."""
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(number, f"added{number}", "k0", weight)]


def children(tree: list[Shard]) -> dict[str, dict[str, float]]:
    """path -> the weights of its children by their paths; the root's path is ''."""
    below: dict[str, dict[str, float]] = {}
    for shard in tree:
        if shard.weight > 0:
            for parent, path in zip(("", *shard.path[:-1]), shard.path, strict=True):
                weights = below.setdefault(parent, {})
                weights[path] = weights.get(path, 0.0) + shard.weight
    if not below:
        raise ValueError("a tree needs a shard with a weight over 0")
    return below


def _time(key: Column, path: Column, weight: Column) -> Column:
    digits = F.substring(F.sha2(F.concat_ws(":", key, path), 256), 1, _DRAW_DIGITS)
    return -F.log((F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16**_DRAW_DIGITS))) / weight


def leaf_of(doc_id: Column, tree: list[Shard]) -> Column:
    """The path of the shard that the id descends to."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    below = F.create_map(
        *(
            x
            for parent, weights in children(tree).items()
            for x in (F.lit(parent), F.array(*(F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in weights.items())))
        )
    )
    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(below, node), lambda c: F.struct(_time(key, c["path"], c["weight"]).alias("time"), c["path"].alias("path"))
        )
        node = F.array_min(draws)["path"]
    return node


def shard_of(doc_id: Column, tree: list[Shard]) -> Column:
    """The number of the shard that the id descends to."""
    numbers = F.create_map(*(x for s in tree for x in (F.lit(s.path[-1]), F.lit(s.number))))
    return F.element_at(numbers, leaf_of(doc_id, tree))


def text_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def place(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """``docs`` with ``shard``, ``size`` and ``text_crc32``; no row moves between tasks."""
    new = ("shard", "size", "text_crc32")
    raw = text_bytes(docs["text"])
    return docs.select(
        *(docs[c] for c in docs.columns if c not in new),
        shard_of(docs["doc_id"], tree).alias("shard"),
        (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def slots(placed: DataFrame, columns: tuple[str, ...] = ("doc_id", "size", "text_crc32")) -> DataFrame:
    """(columns..., shard, slot): the rows of ``placed`` numbered within their shards.

    The order is that of a hash cell of ``columns``, then of ``columns``; nothing else of a
    row takes part, so equal rows differ by their slots only.
    """
    columns = list(columns)
    content = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    cell = F.substring(F.sha2(content, 256), 1, CELL_DIGITS)
    rows = placed.select(*columns, "shard", cell.alias("cell"), F.spark_partition_id().alias("part"))
    counted = written(rows.groupBy("shard", "cell", *columns, "part").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    cells = counted.groupBy("shard", "cell").agg(F.sum("copies").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "cell", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy(*columns, "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*columns, "shard", "cell", "copies", F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("before"))
    first = F.col("start") + F.col("before")
    return before.join(starts, ["shard", "cell"]).select(
        *columns, "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot")
    )


def subtree_changes(docs: DataFrame, before: list[Shard], after: list[Shard]) -> DataFrame:
    """(left, entered, n_rows) for the leaves that rows move between when the tree changes."""
    moves = docs.select(leaf_of(docs["doc_id"], before).alias("left"), leaf_of(docs["doc_id"], after).alias("entered"))
    return moves.where("left <> entered").groupBy("left", "entered").agg(F.count(F.lit(1)).alias("n_rows"))


#: The production tree: 24 shards of one weight.
TREE = even_tree(regions=2, racks=3, shards=4)


def _oracle() -> str:
    def descent(name: str, tree: list[Shard]) -> str:
        edges = ", ".join(f"('{p}', '{c}', {w})" for p, below in children(tree).items() for c, w in below.items())
        leaves = ", ".join(f"('{s.path[-1]}', {s.number})" for s in tree)
        levels = [f"{name}_edges(parent, child, weight) AS (VALUES {edges})", f"{name}_0 AS (SELECT doc_id, '' AS node FROM ids)"]
        for level in (1, 2, 3):
            levels.append(
                f"{name}_{level} AS (SELECT p.doc_id, arg_min(e.child, -ln((CAST('0x' || substr(sha256("
                f"CAST(p.doc_id AS VARCHAR) || ':' || e.child), 1, {_DRAW_DIGITS}) AS BIGINT) + 0.5) / {float(16**_DRAW_DIGITS)}) / e.weight) AS node "
                f"FROM {name}_{level - 1} p JOIN {name}_edges e ON e.parent = p.node GROUP BY p.doc_id)"
            )
        levels.append(
            f"{name} AS (SELECT d.doc_id, l.number FROM {name}_3 d JOIN (VALUES {leaves}) l(leaf, number) ON l.leaf = d.node)"
        )
        return ",\n".join(levels)

    return f"""
WITH {CRC_TABLE},
ids AS (SELECT DISTINCT doc_id FROM documents),
{descent("now", TREE)},
{descent("later", grown(TREE))},
rows AS (
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS BIGINT) AS size,
           {crc32_of("coalesce(text, '')")} AS text_crc32
    FROM documents, crc
), placed AS (
    SELECT r.*, now.number AS shard, later.number AS grown_shard,
           substr(sha256(r.doc_id || ':' || r.size || ':' || r.text_crc32), 1, {CELL_DIGITS}) AS cell
    FROM rows r JOIN now ON now.doc_id = r.doc_id JOIN later ON later.doc_id = r.doc_id
)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM placed
"""


#: Twin of ``op11_hash_tree``.
ORACLE = _oracle()
