"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to M dimensions by Gaussian (2-stable) directions, which no data shape. Every row is
indexed: a coarse kd-tree over a sample of projections (SAMPLE rows at most, drawn by hash, are all that is
fitted) deals rows into cells of about SHARD rows, hashed further apart where a cell holds more, and each
shard has a kd-tree of its own. Squared projected over squared true distance is chi-square with M degrees of
freedom, so a point whose squared projected distance is at least the TAU quantile times the squared distance
of the k-th best so far is nearer with probability under 1 - TAU: it isn't verified, and neither is a leaf, or a
cell, whose box is that far. Leaves are visited in order of projected distance, so the first too far ends a shard.

1. Equal vectors are one point with its k + 1 smallest ids, reduced before they are shuffled.
2. A query is searched in its own cell; its k-th distance there bounds the rest.
3. It goes on to the cells whose boxes the bound doesn't exclude, and the results are merged.

At scale vectors are shuffled a fixed number of times. A task holds one shard and streams the queries that
visit it; a shard visited by more than BLOCK queries is copied for each further BLOCK. At most CELLS boxes
reach the driver, and per query and shard at most k rows leave a task.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; a repeated
row (same id and vector) counts once; neighbours share the query's dimension; ties go to the smaller id; with
fewer candidates than k, all come; an empty table gives no rows. A query id whose rows differ queries by the
shortest, then smallest vector. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .quality import chi2_quantile

M, TAU, LEAF, SHARD, BLOCK, CELLS, SAMPLE = 24, 0.92, 64, 8192, 1 << 17, 4096, 1 << 15
LIMIT = chi2_quantile(TAU, M)


def usable(v: Column) -> Column:
    """Not null, all components finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def directions(dim: int, m: int = M, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, m))


class Tree:
    """A kd-tree over points (n, m), split at the median of the widest side down to LEAF points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        lo, hi = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = points[self.order[a:b]]
            node = len(self.span)
            self.span.append((a, b))
            self.child.append(None)
            lo.append(part.min(axis=0))
            hi.append(part.max(axis=0))
            if parent >= 0:
                pair = self.child[parent] or (-1, -1)
                self.child[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            axis = int((hi[-1] - lo[-1]).argmax())
            if b - a > leaf and hi[-1][axis] > lo[-1][axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def leaves(self, q: np.ndarray):
        """(squared distance to q, positions) of leaves, nearest first."""
        gap = np.maximum(np.maximum(self.lo - q, q - self.hi), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        heap = [(float(far[0]), 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if self.child[node] is None:
                a, b = self.span[node]
                yield d, self.order[a:b]
            else:
                for c in self.child[node]:
                    heapq.heappush(heap, (float(far[c]), c))


class Shard:
    """One shard's rows: equal vectors once, each with its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, group = np.unique(raw, return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")  # ids stay in order within a group
        ends = np.cumsum(np.bincount(group))
        self.ids = [ids[by[s : min(e, s + k + 1)]].tolist() for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        self.x, self.k, self.verified = vectors[first], k, 0
        self.w = directions(self.x.shape[1])
        self.p = self.x @ self.w
        self.tree = Tree(self.p)

    def search(self, own: int, q: np.ndarray, bound: float = np.inf) -> list[tuple[float, int]]:
        """The k nearest found as (distance, id); bound: as far as the k-th nearest known so far."""
        best: list[tuple[float, int]] = []  # the k nearest so far, sorted
        far, z = bound, q @ self.w
        for near, at in self.tree.leaves(z):
            if near >= LIMIT * far * far and near > 0:
                break
            if far < np.inf:  # of the leaf's points those that the test doesn't exclude
                d = self.p[at] - z
                d = np.einsum("ij,ij->i", d, d)
                at = at[(d < LIMIT * far * far) | (d == 0)]
            if not len(at):
                continue
            self.verified += len(at)
            d = self.x[at] - q
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            keep = d <= far
            best += [(v, i) for p, v in zip(at[keep].tolist(), d[keep].tolist(), strict=True) for i in self.ids[p] if i != own]
            best = sorted(best)[: self.k]
            if len(best) == self.k:
                far = min(far, best[-1][0])
        return best


class Cells:
    """The coarse tree of one dimension: splits fitted on sampled projections, and from them a cell for any point."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.child, self.n = [], [], [], 0
        least = max(2, len(sample) // max(1, cells))

        def grow(points: np.ndarray, cells: int) -> int:
            """The node's number, or of a cell its number less than zero."""
            spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
            if cells < 2 or len(points) < 2 * least or not spread.max():
                self.n += 1
                return -self.n
            node, a = len(self.axis), int(spread.argmax())
            cut = float(np.median(points[:, a]))
            low = points[:, a] < cut
            if low.all() or not low.any():
                cut = float(points[:, a].max())
                low = points[:, a] < cut
            self.axis.append(a)
            self.cut.append(cut)
            self.child.append((0, 0))
            self.child[node] = (grow(points[low], cells // 2), grow(points[~low], cells - cells // 2))
            return node

        self.root = grow(sample, cells)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        axis, cut, child = np.array(self.axis, int), np.array(self.cut), np.array(self.child, int).reshape(-1, 2)
        while (live := np.flatnonzero(node >= 0)).size:
            n = node[live]
            node[live] = child[n, (points[live, axis[n]] >= cut[n]).astype(int)]
        return -node - 1


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dim) of a list column whose lists are of one length."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch):
    """The batch's rows dimension by dimension: (dim, row numbers)."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _searched(placed: DataFrame, asked: DataFrame, salts: dict, k: int) -> DataFrame:
    """(query_id, vec_id, score): up to k rows for each shard that asked (dim, cell, vec_id, v, bound) visits."""
    visits = {(r["dim"], r["cell"]): r["n"] for r in asked.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = [(d, c, salts[d, c], -(-n // BLOCK)) for (d, c), n in visits.items() if (d, c) in salts]
    spark = placed.sparkSession
    plan = F.broadcast(spark.createDataFrame(table or [(-1, 0, 1, 1)], "dim int, cell int, salts int, blocks int"))  # a row a cell: CELLS at most for each dimension
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(c)).cast("int")
    left = placed.join(plan, ["dim", "cell"]).select("dim", "cell", dealt("salts", 1).alias("salt"), every("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("bound"))
    right = asked.join(plan, ["dim", "cell"]).select("dim", "cell", every("salts").alias("salt"), dealt("blocks", 2).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "bound")
    keys = ["dim", "cell", "salt", "block"]
    both = left.unionAll(right).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches):
        now, index, ids, parts = None, None, [], []
        for batch in common.slices(batches, 4096):
            head = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((head[1:] != head[:-1]).any(axis=1)) + 1, [len(head)]])
            out: list[tuple] = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if e == s:
                    continue
                key, own = tuple(head[s, :4].tolist()), batch.column(5).slice(s, e - s).to_numpy()
                x = _vectors(batch.column(6).slice(s, e - s))
                if key != now:
                    now, index, ids, parts = key, None, [], []
                if head[s, 4] == 0:
                    ids.append(own)
                    parts.append(x)
                elif parts or index:
                    if index is None:
                        index, ids, parts = Shard(np.concatenate(ids), np.concatenate(parts), k), [], []
                    bound = batch.column(7).slice(s, e - s).to_numpy()
                    for q, v, b in zip(own.tolist(), x, bound.tolist(), strict=True):
                        out += [(q, i, d) for d, i in index.search(q, v, b)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of (vec_id, embedding) to each query row."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.size("embedding").alias("dim"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).collect()}
    trees: dict[int, Cells] = {}
    for dim, n in counts.items():
        drawn = rows.where((F.col("dim") == dim) & (common.unit_hash("vec_id", "v") < SAMPLE / n)).select("vec_id", "v").distinct()

        def project(batches, w=directions(dim)):
            for batch in common.slices(batches, 4096):
                points = (_vectors(batch.column(1)) @ w).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(points[:, i]) for i in range(M)], [f"p{i}" for i in range(M)])

        found = drawn.mapInArrow(project, ", ".join(f"p{i} float" for i in range(M))).toArrow()
        sample = np.stack([c.to_numpy() for c in found.columns], axis=1).astype(np.float64)
        trees[dim] = Cells(sample[np.lexsort(sample.T)], min(CELLS, -(-n // shard)))

    def place(batches):
        for batch in common.slices(batches, 4096):
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at in _by_dim(batch):
                if dim in trees:
                    cell[at] = trees[dim].of(_vectors(batch.column(2).take(pa.array(at))) @ directions(dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), *batch.columns[1:]], ["dim", "cell", "vec_id", "v", "q"])

    every = common.durable(rows.distinct().mapInArrow(place, "dim int, cell int, vec_id long, v array<double>, q boolean"))
    # Of equal vectors the k + 1 smallest ids: no other can be among the k nearest of any query.
    same = Window.partitionBy("dim", "cell", "h", "v").orderBy("vec_id")
    placed = every.select("dim", "cell", "vec_id", "v", F.xxhash64("v").alias("h")).withColumn("n_", F.row_number().over(same)).where(F.col("n_") <= k + 1)
    placed = common.durable(placed.select("dim", "cell", "vec_id", "v"))

    def boxes(batches):
        seen: dict[tuple, list] = {}
        for batch in common.slices(batches, 4096):
            cells = batch.column(1).to_numpy()
            for dim, at in _by_dim(batch):
                points = _vectors(batch.column(3).take(pa.array(at))) @ directions(dim)
                for c in np.unique(cells[at]).tolist():
                    mine = points[cells[at] == c]
                    n, lo, hi = seen.get((dim, c), (0, np.inf, -np.inf))
                    seen[dim, c] = [n + len(mine), np.minimum(lo, mine.min(axis=0)), np.maximum(hi, mine.max(axis=0))]
        names = ["dim", "cell", "n", *(f"l{i}" for i in range(M)), *(f"h{i}" for i in range(M))]
        flat = [[d, c, n, *lo, *hi] for (d, c), (n, lo, hi) in seen.items()]
        cols = list(zip(*flat, strict=True)) or [[]] * len(names)
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * (2 * M)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "dim int, cell int, n long, " + ", ".join(f"{c}{i} double" for c in "lh" for i in range(M))
    aggs = [F.sum("n").alias("n"), *(F.min(f"l{i}").alias(f"l{i}") for i in range(M)), *(F.max(f"h{i}").alias(f"h{i}") for i in range(M))]
    found = placed.mapInArrow(boxes, schema).groupBy("dim", "cell").agg(*aggs).collect()
    salts = {(r["dim"], r["cell"]): -(-r["n"] // shard) for r in found}
    box = {d: (np.array([r["cell"] for r in found if r["dim"] == d]), *(np.array([[r[f"{c}{i}"] for i in range(M)] for r in found if r["dim"] == d]) for c in "lh")) for d in trees}

    asked = every.where("q").groupBy("vec_id").agg(F.min(F.struct("dim", "v", "cell")).alias("a"))
    asked = common.durable(asked.select("a.dim", "a.cell", "vec_id", "a.v").withColumn("bound", F.lit(float("inf"))))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    home = common.durable(best(_searched(placed, asked, salts, k)))
    if not trees:
        return home.select("query_id", "rank", "vec_id", "score")
    bounds = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("b"))
    more = asked.drop("bound").join(bounds, "vec_id", "left").select("dim", "cell", "vec_id", "v", F.coalesce("b", F.lit(float("inf"))).alias("bound"))

    def visit(batches):
        for batch in common.slices(batches, 512):
            row, cell = [np.zeros(0, int)], [np.zeros(0, np.int32)]
            own, bound = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for dim, at in _by_dim(batch):
                if dim not in box:
                    continue
                cells, lo, hi = box[dim]
                points = _vectors(batch.column(3).take(pa.array(at))) @ directions(dim)
                for i, z in zip(at.tolist(), points, strict=True):
                    gap = np.maximum(np.maximum(lo - z, z - hi), 0)
                    near = np.einsum("ij,ij->i", gap, gap)
                    to = cells[((near < LIMIT * bound[i] ** 2) | (near == 0)) & (cells != own[i])]
                    row.append(np.full(len(to), i))
                    cell.append(to.astype(np.int32))
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(cell), pa.int32()), *(batch.column(i).take(at) for i in (2, 3, 4))], batch.schema.names)

    visits = common.durable(more.mapInArrow(visit, "dim int, cell int, vec_id long, v array<double>, bound double"))
    found = home.select("query_id", "vec_id", "score").unionAll(_searched(placed, visits, salts, k))
    return best(found).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
