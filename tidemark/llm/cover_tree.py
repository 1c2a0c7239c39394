"""All pairs of vectors with a cosine of at least a threshold, by cover trees.

On unit vectors a cosine bound is a bound on the chord distance, and that is a metric. Equal
vectors are one class with a weight. Classes are dealt to blocks around centres (a bounded
hash sample, ``MOST_CENTRES``), and each block gets a cover tree: nested nets whose radii halve
from level to level. A block with its tree is one row of a table. Pairs of blocks are dropped by
their covering radii; every pair left is met by a nested-loop join that reads that table on both
sides, so that no block is shuffled once per partner: what is written grows with the vectors,
what is compared with their square where the radii prune nothing. One task walks both trees
together. A pair of nodes is pruned if the distance of its
centres exceeds both radii and the threshold, taken whole if even the farthest members must
be linked, and split into the next level otherwise. Points on their own are first pruned by a
bound on their cosine from a part of their components (``_head``). Nothing else is skipped: the
result is exact. A task returns one row per class with links (their number and one link of a
spanning forest), never the pairs.

Defined cases: a vector that is null, empty, all zero or has null or non-finite components
links with nothing and is its own component, as is one of another dimension for the others.
Rows that share a ``vec_id`` count as vectors each and are one node of the components. A null
``vec_id`` links with nothing, has a null component and is kept. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_rows, written
from tidemark.llm.components import connected_components
from tidemark.session import scratch_dir

#: Vectors per block at most, and their components; two blocks meet at a time.
BLOCK = 10_000
BLOCK_VALUES = 2_500_000
#: Centres on the driver and in every task, at most.
MOST_CENTRES = 512
#: Levels of nested nets: radii of the threshold's distance and its halves. Wider nets prune
#: nothing in many dimensions, where most vectors are about as far from each other.
LEVELS = 4
#: Nodes of fewer members are taken apart at once.
WIDE = 16
_SLACK = 1e-7
_TILE = 512
_PAIR_VALUES = 1_000_000
#: Trees a task keeps while it reads its pairs of blocks.
_KEPT_TREES = 4
_ROWS = "vec_id long, dim int, key binary, vector binary"
_BLOCKS = "block long, cell long, dim int, key binary, rep binary, weight binary, vector binary, path binary"


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the same row gives the same bits in any company."""
    points = vectors.astype(np.float64)
    points /= np.abs(points).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    return points


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, key, vector): the digest of the unit vector, the components as given (floats
    or else doubles); dim 0 marks unusable vectors."""
    for batch in batches:
        lists = batch["embedding"]
        kind = np.float32 if lists.type.value_type == pa.float32() else np.float64
        values = lists.flatten().cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        dims = np.zeros(len(batch), np.int32)
        keys: list[bytes | None] = [None] * len(batch)
        vectors: list[bytes | None] = [None] * len(batch)
        for length in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == length)
            found = values[starts[rows][:, None] + np.arange(length)]
            usable = np.isfinite(found).all(axis=1) & found.any(axis=1)
            rows, found = rows[usable], found[usable]
            dims[rows] = length
            if len(rows):
                for row, unit, vector in zip(rows.tolist(), _scaled(found), found, strict=True):
                    keys[row] = hashlib.sha256(unit.tobytes()).digest()[:16]
                    vectors[row] = vector.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], pa.array(dims), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
            names=["vec_id", "dim", "key", "vector"],
        )


def _points(vectors: bytes | pa.Buffer, dim: int, n: int) -> np.ndarray:
    """Unit vectors of ``n`` rows of components, one after the other."""
    return _scaled(np.frombuffer(vectors, f"f{memoryview(vectors).nbytes // (n * dim)}").reshape(n, dim))


@functools.cache
def _axes(dim: int, cosine: float) -> np.ndarray:
    """(dim, some): orthonormal axes in random directions, so many that vectors far apart rarely seem close on them."""
    some = int(dim * (1 - cosine) + 2.2 * dim**0.5) + 1
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(dim, some))))[0]


def _head(points: np.ndarray, cosine: float) -> np.ndarray:
    """Components on the axes and the length of the rest: their products are at least the cosines."""
    some = points @ _axes(points.shape[1], cosine)
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", some, some), 0))
    return np.column_stack([some, rest]).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _rounding(heads: np.ndarray) -> float:
    """More than single precision can lose in a product of two heads."""
    return 2e-7 * (heads.shape[1] + 8)


def _tiles(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """(rows of ``a``, rows of ``b``, their products, where these are at least that), flat; they last until the next tile."""
    most = min(len(a), _TILE) * min(len(b), 4 * _TILE)
    products, hit = np.empty(most, a.dtype), np.empty(most, bool)
    for lo in range(0, len(a), _TILE):
        rows = a[lo : lo + _TILE]
        for at in range(0, len(b), 4 * _TILE):
            columns = b[at : at + 4 * _TILE]
            n = len(rows) * len(columns)
            np.matmul(rows, columns.T, out=products[:n].reshape(len(rows), len(columns)))
            np.greater_equal(products[:n], a.dtype.type(least), out=hit[:n])
            yield slice(lo, lo + len(rows)), slice(at, at + len(columns)), products[:n], hit[:n]


def _places(hit: np.ndarray) -> np.ndarray:
    """Where ``hit`` is true; that is rare, so eight at a time are looked at."""
    whole = len(hit) // 8 * 8
    eights = hit[:whole].reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64) != 0)
    which, place = np.nonzero(eights[some])
    return np.append(some[which] * 8 + place, whole + np.flatnonzero(hit[whole:]))


def _hits(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and of ``b`` whose product is at least that, and it."""
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, a.dtype))]
    for rows, columns, products, hit in _tiles(a, b, least):
        flat = _places(hit)
        i, j = np.divmod(flat, columns.stop - columns.start)
        found.append((rows.start + i, columns.start + j, products[flat]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cosines(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of row i of ``a`` and row j of ``b`` for many i and j, some at a time."""
    step = max(1, _PAIR_VALUES // a.shape[1])
    parts = [np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]]) for at in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def net(points: np.ndarray, heads: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of its centre: centres are farther than ``radius`` apart."""
    least = 1 - radius * radius / 2
    centre = np.full(len(points), -1)
    open_ = np.arange(len(points))
    while len(open_):
        tried, picked = open_[:128], []
        near = points[tried] @ points[tried].T >= least
        for i in range(len(tried)):
            if not near[i, picked].any():
                picked.append(i)
        picked = tried[picked]
        i, j, _ = _hits(heads[open_], heads[picked], least - _rounding(heads))
        i, j = open_[i], picked[j]
        dot = _cosines(points, i, points, j)
        order = np.argsort(dot, kind="stable")[np.count_nonzero(dot < least) :]  # the nearest is written last
        centre[i[order]] = j[order]
        centre[picked] = picked
        open_ = open_[centre[open_] < 0]
    return centre


def nested_nets(points: np.ndarray, heads: np.ndarray, reach: float) -> np.ndarray:
    """(levels, points): each point's centre at each radius; nets are nested."""
    levels: list[np.ndarray] = []
    alone: list[np.ndarray] = []  # a point alone in its node stays so
    groups = [np.arange(len(points))]
    for radius in (reach / 2**i for i in range(LEVELS)):
        centre = np.empty(len(points), int)
        finer = []
        for group in groups:
            own = net(points[group], heads[group], radius)
            centre[group] = group[own]
            order = np.argsort(own, kind="stable")
            parts = np.split(group[order], np.flatnonzero(np.diff(own[order])) + 1)
            centre_only = [p for p in parts if len(p) == 1]
            alone += centre_only
            finer += [p for p in parts if len(p) > 1]
        if alone:
            centre[np.concatenate(alone)] = np.concatenate(alone)
        levels.append(centre)
        groups = finer
    return np.array(levels)


def _build(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """The block as one row: its classes by smallest id, with ``path``, the place of their centre at each level."""
        block, cell, dim = (table[name][0].as_py() for name in ("block", "cell", "dim"))
        merged = table.append_column("at", pa.array(np.arange(len(table)))).group_by("key", use_threads=False)
        merged = merged.aggregate([("rep", "min"), ("weight", "sum"), ("at", "min")]).sort_by([("rep_min", "ascending"), ("key", "ascending")])
        vectors = b"".join(table["vector"].take(merged["at_min"]).to_pylist())
        points = _points(vectors, dim, len(merged))
        path = nested_nets(points, _head(points, cosine), float(np.sqrt(2 - 2 * cosine))).T.astype(np.int32)
        packed = {
            "block": block,
            "cell": cell,
            "dim": dim,
            "key": b"".join(merged["key"].to_pylist()),
            "rep": merged["rep_min"].to_numpy().tobytes(),
            "weight": merged["weight_sum"].to_numpy().tobytes(),
            "vector": vectors,
            "path": path.tobytes(),
        }
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table({name: pa.array([value], kind) for (name, value), kind in zip(packed.items(), types, strict=True)})

    return run


class _Tree:
    def __init__(self, block: dict, cosine: float):
        self.rep = np.frombuffer(block["rep"], np.int64)
        self.weight = np.frombuffer(block["weight"], np.int64)
        self.key = block["key"]
        self.points = _points(block["vector"], block["dim"], len(self.rep))
        self.path = np.frombuffer(block["path"], np.int32).reshape(len(self.rep), LEVELS)
        self.head = _head(self.points, cosine)
        self.links = np.zeros(len(self.rep), np.int64)
        self.root = self.children(np.arange(len(self.rep)), 0)

    def children(self, members: np.ndarray, level: int) -> tuple[tuple, np.ndarray]:
        """The next level's wide nodes (centres, covering radii, bounds, members; node i has those from bound i to the next), and all other members."""
        own = self.path[members, level]
        order = np.argsort(own, kind="stable")
        members, own = members[order], own[order]
        wide = np.isin(own, np.flatnonzero(np.bincount(own) >= WIDE))
        alone, members, own = members[~wide], members[wide], own[wide]
        far = np.sqrt(np.maximum(2 - 2 * _cosines(self.points, members, self.points, own), 0))
        centres, first = np.unique(own, return_index=True)
        return (centres, np.maximum.reduceat(far, first) if len(first) else far, np.append(first, len(members)), members), alone


def _alone(points: np.ndarray) -> tuple:
    """Points as nodes of themselves."""
    return points, np.zeros(len(points)), np.arange(len(points) + 1), points


def _walk(a: _Tree, b: _Tree, cosine: float, label: np.ndarray, base: int) -> None:
    """Counts the links of ``a``'s points into ``b`` and joins labels; rows of b start at ``base``."""
    reach = float(np.sqrt(2 - 2 * cosine))
    same = a is b

    def joined(rows: np.ndarray | int, columns: np.ndarray) -> None:
        labels = np.append(label[base + columns], label[rows])
        if (labels != labels[0]).any():
            label[np.isin(label, labels)] = labels.min()

    def linked(rows: np.ndarray, columns: np.ndarray, hit: np.ndarray) -> None:
        if same:
            hit = hit & (rows[:, None] != columns[None, :])
        a.links[rows] += hit @ b.weight[columns]
        if not same:
            b.links[columns] += a.weight[rows] @ hit
        labels = np.append(label[base + columns], label[rows])
        if (labels != labels[0]).any():
            for i in np.flatnonzero(hit.any(axis=1)):
                joined(rows[i], columns[hit[i]])

    def each(rows: np.ndarray, columns: np.ndarray) -> None:
        """Every point with every point."""
        for lo in range(0, len(rows), _TILE):
            part = rows[lo : lo + _TILE]
            for at in range(0, len(columns), 4 * _TILE):
                other = columns[at : at + 4 * _TILE]
                linked(part, other, a.points[part] @ b.points[other].T >= cosine)

    def whole(rows: np.ndarray, columns: np.ndarray) -> None:
        """All of two nodes are linked; in one tree they are the same node or have no member in common."""
        a.links[rows] += b.weight[columns].sum()
        if not same:
            b.links[columns] += a.weight[rows].sum()
        elif rows[0] == columns[0]:
            a.links[rows] -= a.weight[rows]
        joined(rows, columns)

    def points(rows: np.ndarray, columns: np.ndarray) -> None:
        """Points on their own: the bound by their heads, then the cosines of what is left."""
        if not len(rows) or not len(columns):
            return
        heads = b.head[columns]
        for rows_at, columns_at, _, near in _tiles(a.head[rows], heads, cosine - _rounding(heads)):
            part, other = rows[rows_at], columns[columns_at]
            if np.count_nonzero(near) * 64 > len(near):
                each(part, other)
                continue
            i, j = np.divmod(_places(near), len(other))
            i, j = part[i], other[j]
            hit = _cosines(a.points, i, b.points, j) >= cosine
            if same:
                hit &= i != j
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            np.add.at(a.links, i, b.weight[j])
            if not same:
                np.add.at(b.links, j, a.weight[i])
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            for row, others in zip(i[first].tolist(), np.split(j, first[1:]), strict=True):
                joined(row, others)

    def nodes(some: tuple, others: tuple, level: int) -> None:
        """Pairs of nodes, wide ones or points; each side: centres, covering radii, bounds, members."""
        centre_a, radius_a, bound_a, inside_a = some
        centre_b, radius_b, bound_b, inside_b = others
        ends = b.points[centre_b]
        for lo in range(0, len(centre_a) if len(centre_b) else 0, _TILE):
            part = slice(lo, lo + _TILE)
            # A bound for all pairs of the tile first, then each pair's own.
            most = radius_a[part].max() + radius_b.max() + reach + _SLACK
            i, j, dot = _hits(a.points[centre_a[part]], ends, 1 - most * most / 2 - _SLACK)
            i += lo
            gap = np.sqrt(np.maximum(2 - 2 * dot, 0))
            spread = radius_a[i] + radius_b[j]
            near = gap <= spread + reach + _SLACK
            inside = gap[near] + spread[near] < reach - _SLACK
            ends_a = bound_a[lo : lo + _TILE + 1]
            if np.count_nonzero(~inside) * 16 > (len(ends_a) - 1) * len(centre_b) and len(centre_b) * len(ends_a) > 64:
                each(inside_a[ends_a[0] : ends_a[-1]], inside_b)  # bounds that prune little cost more than they save
                continue
            for x, y, every in zip(i[near].tolist(), j[near].tolist(), inside.tolist(), strict=True):
                x, y = inside_a[bound_a[x] : bound_a[x + 1]], inside_b[bound_b[y] : bound_b[y + 1]]
                if every:
                    whole(x, y)
                else:
                    meet(x, y, level + 1)

    def meet(rows: np.ndarray, columns: np.ndarray, level: int) -> None:
        if level == LEVELS or len(rows) * len(columns) <= 1024:
            each(rows, columns)
            return
        wide_a, own_a = a.children(rows, level) if level else a.root
        wide_b, own_b = b.children(columns, level) if level else b.root
        points(own_a, own_b)
        # Wide nodes apart from points on their own, whose bound is much tighter.
        nodes(wide_a, wide_b, level)
        nodes(wide_a, _alone(own_b), level)
        nodes(_alone(own_a), wide_b, level)

    meet(np.arange(len(a.rep)), np.arange(len(b.rep)), 0)


def _pairs(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, a, b, links) of pairs of blocks, one batch a pair."""
        kept: dict[int, _Tree] = {}

        def tree(batch: pa.RecordBatch, i: int, side: str) -> _Tree:
            at = batch[f"{side}block"][i].as_py()
            found = kept.pop(at, None)
            if found is None:
                found = _Tree({n: batch[f"{side}{n}"][i].as_py() for n in ("dim", "key", "rep", "weight", "vector", "path")}, cosine)
            kept[at] = found  # the last one used is the last to go
            if len(kept) > _KEPT_TREES:
                del kept[next(iter(kept))]
            found.links[:] = 0
            return found

        for batch in batches:
            for i in range(len(batch)):
                a, b = tree(batch, i, ""), tree(batch, i, "other_")
                trees = [a] if a is b else [a, b]
                ids = np.concatenate([t.rep for t in trees])
                label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # small label, small id
                back = np.sort(ids)
                _walk(a, b, cosine, label, 0 if a is b else len(a.rep))
                links = np.concatenate([t.links for t in trees])
                some = np.flatnonzero(links)
                keys = [t.key[16 * k : 16 * k + 16] for t in trees for k in np.flatnonzero(t.links).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(ids[some]), pa.array(back[label[some]]), pa.array(links[some])],
                    names=["key", "a", "b", "links"],
                )

    return run


def _nearest(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rep, weight, dim, vector, centre, far): equal vectors of a batch once, with their nearest centre."""
        for batch in batches:
            table = pa.table({"key": batch["key"], "id": batch["vec_id"], "at": np.arange(len(batch))})
            once = table.group_by("key", use_threads=False).aggregate([("id", "min"), ("id", "count"), ("at", "min")]).combine_chunks()
            batch = batch.take(once["at_min"].combine_chunks())
            dims = batch["dim"].to_numpy()
            centre, far = np.full(len(batch), -1, np.int32), np.full(len(batch), 2.0)
            for lo in range(0, len(batch), _TILE):
                rows = lo + np.flatnonzero(dims[lo : lo + _TILE] == centres.shape[1])
                if len(rows):
                    vectors = b"".join(batch["vector"].take(pa.array(rows)).to_pylist())
                    points = _points(vectors, centres.shape[1], len(rows))
                    gap = _distances(points, centres)
                    centre[rows], far[rows] = gap.argmin(axis=1), gap.min(axis=1)
                    # Ties by sums of the row alone: a vector has the same centre in every batch.
                    for i in np.flatnonzero((gap <= far[rows][:, None] + _SLACK).sum(axis=1) > 1).tolist():
                        centre[rows[i]] = (points[i] * centres).sum(axis=1).argmax()
            yield pa.RecordBatch.from_arrays(
                [*(x.combine_chunks() for x in (once["key"], once["id_min"], once["id_count"])), batch["dim"], batch["vector"], pa.array(centre), pa.array(far)],
                names=["key", "rep", "weight", "dim", "vector", "centre", "far"],
            )

    return run


def _links(rows: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(key, a, b, links), written; ``rows``: vec_id, dim, key, vector; ``classes``: key, rep, weight."""
    spark = rows.sparkSession
    k = max(1, min(MOST_CENTRES, classes.count() // BLOCK))
    sample = classes.orderBy(F.xxhash64("key")).limit(k).select("key")
    sample = rows.join(F.broadcast(sample), "key").groupBy("key").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector")).collect()
    sample = sorted(sample, key=lambda r: bytes(r["key"]))
    common = max((r["dim"] for r in sample), key=[r["dim"] for r in sample].count, default=1)
    centres = np.concatenate([_points(bytes(r["vector"]), common, 1) for r in sample if r["dim"] == common] or [np.zeros((1, common))])
    schema = "key binary, rep long, weight long, dim int, vector binary, centre int, far double"
    near = rows.mapInArrow(_nearest(centres), schema)
    # One row per centre and dimension; vectors of rarer dimensions have no centre and radius 2.
    cells = [tuple(r) for r in near.groupBy("centre", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()]
    reach = float(np.sqrt(2 - 2 * cosine))
    meets: list[list[int]] = [[] for _ in cells]
    for i, (c, d, _, r) in enumerate(cells):
        for j, (c2, d2, _, r2) in enumerate(cells[: i + 1]):
            gap = np.sqrt(max(0.0, 2 - 2 * float(centres[c] @ centres[c2]))) if c >= 0 and c2 >= 0 else 0.0
            if d == d2 and gap <= r + r2 + reach + _SLACK:
                meets[i].append(j)
                if i != j:
                    meets[j].append(i)
    # Both tables are bounded by the number of centres.
    parts = [-(-n // max(1, min(BLOCK, BLOCK_VALUES // d))) for _, d, n, _ in cells]
    dealt = spark.createDataFrame(
        [(c, d, i, parts[i]) for i, (c, d, _, _) in enumerate(cells)], "centre int, dim int, cell long, parts long"
    )
    met = spark.createDataFrame(list(enumerate(meets)), "cell long, meets array<long>")
    placed = near.join(F.broadcast(dealt), ["centre", "dim"])
    block = F.shiftleft("cell", 32) + F.pmod(F.xxhash64("key", F.lit(3)), "parts")
    placed = placed.select("cell", "dim", "key", "rep", "weight", "vector", block.alias("block"))
    path = scratch_dir(spark, "trees")
    packed = placed.groupBy("block").applyInArrow(_build(cosine), _BLOCKS)
    packed.write.option("maxRecordsPerFile", 1).parquet(path)  # a block is the unit that tasks read
    trees = spark.read.schema(packed.schema).parquet(path)
    other = trees.select([F.col(c).alias(f"other_{c}") for c in trees.columns])
    # Each two blocks meet once, in either order, so that the tasks of both orders have work.
    first = F.xxhash64(F.least("block", "other_block"), F.greatest("block", "other_block")) % 2 == 0
    once = (F.col("block") == F.col("other_block")) | ((F.col("block") < F.col("other_block")) == first)
    pairs = trees.join(F.broadcast(met), "cell").join(
        other.hint("shuffle_replicate_nl"), F.array_contains("meets", F.col("other_cell")) & once
    )
    pairs = pairs.drop("cell", "other_cell", "meets")
    with batch_rows(spark, 1):
        return written(pairs.mapInArrow(_pairs(cosine), "key binary, a long, b long, links long"), "vector-links")


def cosine_links(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    raw = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    rows = written(raw.mapInArrow(unit_vectors, _ROWS), "vectors")
    usable = rows.where("vec_id IS NOT NULL AND dim > 0")
    ids = usable.select("vec_id", "key")
    classes = written(ids.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    found = _links(usable, classes, cosine)
    links = found.select("a", "b")
    several = ids.groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    shared = ids.join(several, "vec_id", "left_semi").join(classes.select("key", "rep"), "key")
    roots = connected_components(links.union(shared.select("vec_id", "rep")))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "key", "left").join(roots, classes["rep"] == roots["node"], "left")
    known = written(
        known.select(
            F.col("key").alias("_key"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "rep").alias("root"),
        ),
        "vector-labels",
    )
    joined = rows.select("vec_id", "key").join(known, (rows["key"] == known["_key"]) & rows["vec_id"].isNotNull(), "left")
    component = F.coalesce("root", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
