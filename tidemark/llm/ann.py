"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stopping test.

Vectors are projected by a Gaussian (2-stable) matrix to `dims` dimensions. The squared projected distance over the squared
distance follows a chi-square law with `dims` degrees of freedom, so once all projections within `quantile` times the squared
distance of the k-th best have been verified on the original vectors, a nearer vector has been missed with a probability of
at most 1 - `confidence`: there the search stops.

The test works at two levels. A kd-tree over the projections of a bounded sample cuts the space into cells; every vector lies in one,
and a cell knows the box around its own projections. A query first searches its own cell. With the distance of the k-th best
found there, the test tells which other cells can't hold anything that would be verified; only the others are visited, with
that distance as the bound to beat. Within a cell, blocks of bounded size have kd-trees of their own with small leaves, built once for
all queries that stream through. So a base vector moves once a pass, and a query to the cells that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import drop_scratch, materialize, table


@dataclass(frozen=True)
class AnnConfig:
    k: int = 10
    dims: int = 24  # even, for the closed form of the chi-square law
    confidence: float = 0.93  # chosen by the recall on random and clustered vectors, see tests
    leaf: int = 32
    cell_rows: int = 4_096  # vectors a cell should hold ...
    max_cells: int = 4_096  # ... as far as this bound of their number allows; more vectors make more blocks a cell
    sample_rows: int = 32_768  # bound of the sample that the cells are cut by
    block_rows: int = 16_384
    query_rows: int = 262_144  # queries that share one copy of a block
    seed: int = 11


def projection(width: int, c: AnnConfig) -> np.ndarray:
    return np.random.default_rng(c.seed).standard_normal((width, c.dims))


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of degrees lies with probability p, by bisection."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class KdTree:
    """Median splits on the widest dimension. Leaves hold up to `leaf` points, their positions are runs of `order`."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        spans, stack = [], [(0, len(points), 0)] if len(points) else []
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, node below it, node above; ~i is leaf i
        parents: list[tuple[int, int]] = []
        while stack:
            at, end, parent = stack.pop()
            own = points[self.order[at:end]]
            extent = own.max(axis=0) - own.min(axis=0)
            axis, mid = int(np.argmax(extent)), (end - at) // 2
            if end - at <= leaf or extent[axis] <= 0:
                self._hang(parents, parent, ~len(spans))
                spans.append((at, end))
                continue
            turned = np.argpartition(own[:, axis], mid)
            self.order[at:end] = self.order[at:end][turned]
            node = len(self.splits)
            self._hang(parents, parent, node)
            self.splits.append((axis, float(own[turned[mid], axis]), 0, 0))
            stack += [(at + mid, end, 2 * node + 2), (at, at + mid, 2 * node + 1)]
        self.at = np.array([x for x, _ in spans], np.int64)
        self.end = np.array([x for _, x in spans], np.int64)
        self.sorted = points[self.order]
        if len(spans):
            self.low, self.high = np.minimum.reduceat(self.sorted, self.at), np.maximum.reduceat(self.sorted, self.at)

    def _hang(self, parents: list, parent: int, child: int) -> None:
        if parent:
            node, right = (parent - 1) // 2, parent % 2 == 0
            axis, value, below, above = self.splits[node]
            self.splits[node] = (axis, value, below, child) if right else (axis, value, child, above)


def leaves(splits: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """The leaf that each point falls into, by the splits of a tree."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))] if splits else []
    while stack:
        node, rows = stack.pop()
        if node < 0 or not len(rows):
            out[rows] = ~node
            continue
        axis, value, below, above = splits[node]
        right = points[rows, axis] >= value
        stack += [(below, rows[~right]), (above, rows[right])]
    return out


def box_gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    gaps = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", gaps, gaps)


def best_of(near: np.ndarray, at_id: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of both, ties to the smaller id; of rows with the same id the nearest counts."""
    d, i = np.concatenate([near, d]), np.concatenate([at_id, ids])
    order = np.lexsort((d, i))
    d, i = d[order], i[order]
    first = np.concatenate([[True], i[1:] != i[:-1]]) | np.isinf(d)
    d, i = d[first], i[first]
    order = np.lexsort((i, d))[:k]
    return d[order], i[order]


def search_block(tree: KdTree, ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, projected: np.ndarray, quantile: float, k: int, bound: float = np.inf) -> tuple[list[tuple[float, int]], int]:
    """The k nearest found in a block as (distance, id), verified in double precision, and how many were verified.

    ids and vectors are in the order of the tree. Leaves come in ascending order of their distance, projections of a few leaves in
    ascending order of theirs. bound is a distance that k other vectors are known to keep; farther ones aren't looked for.
    """
    near, at_id = np.full(k, np.inf), np.full(k, np.iinfo(np.int64).max)
    if not len(tree.at):
        return [], 0
    gaps = box_gaps(tree.low, tree.high, projected)
    order = np.argsort(gaps, kind="stable")
    verified, turn, step = 0, 0, 1
    while turn < len(order):
        kth = min(bound, float(near[-1]))
        leaves = order[turn : turn + step]
        leaves = leaves[gaps[leaves] <= quantile * kth * kth] if np.isfinite(kth) else leaves
        if not len(leaves):
            break
        turn, step = turn + step, min(2 * step, 32)
        at = np.concatenate([np.arange(tree.at[x], tree.end[x]) for x in leaves])
        p = tree.sorted[at] - projected
        p = np.einsum("ij,ij->i", p, p)
        rank = np.argsort(p, kind="stable")
        for part in range(0, len(rank), 128):
            own = rank[part : part + 128]
            kth = min(bound, float(near[-1]))
            if np.isfinite(kth):
                own = own[p[own] <= quantile * kth * kth]
            if not len(own):
                break
            own = at[own]
            own = own[ids[own] != query_id]
            d = vectors[own] - query
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            verified += len(own)
            closer = d <= min(bound, float(near[-1]))
            if closer.any():
                near, at_id = best_of(near, at_id, d[closer], ids[own[closer]], k)
    return [(d, i) for d, i in zip(near.tolist(), at_id.tolist()) if np.isfinite(d)], verified


FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat = flat.astype(np.float64, copy=False)
    return [flat[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


class _Block:
    """The trees of a block, one per width of the vectors."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], c: AnnConfig):
        self.own = {}
        widths = np.array([len(v) for v in vectors])
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            raw, matrix = np.stack([vectors[i] for i in at]), projection(width, c)
            tree = KdTree(raw @ matrix, c.leaf)
            self.own[width] = (tree, np.array([ids[i] for i in at], np.int64)[tree.order], raw[tree.order], matrix)

    def search(self, query_id: int, v: np.ndarray, bound: float, quantile: float, k: int) -> list[tuple[float, int]]:
        if len(v) not in self.own:
            return []
        tree, ids, raw, matrix = self.own[len(v)]
        return search_block(tree, ids, raw, query_id, v, v @ matrix, quantile, k, bound)[0]


def _search(base: DataFrame, asked: DataFrame, c: AnnConfig) -> DataFrame:
    """What queries (block, turn, id, v, bound) find among the vectors (block, turn, id, v) of the same block and turn.

    Rows are sorted so that a block's vectors come first; its trees are built when they end, and its queries stream through.
    """
    rows = base.select("block", "turn", F.lit(0).alias("role"), "id", "v", F.lit(None).cast("double").alias("bound")).unionByName(asked.select("block", "turn", F.lit(1).alias("role"), "id", "v", "bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantile, key, block = chi_square_quantile(c.confidence, c.dims), None, None
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            vs = _matrix(batch.column(4))
            for i, (cell, turn, role, own_id, bound) in enumerate(zip(*(batch.column(x).to_pylist() for x in (0, 1, 2, 3, 5)), strict=True)):
                if (cell, turn) != key:
                    key, block, ids, vectors = (cell, turn), None, [], []
                if role == 0:
                    ids.append(own_id)
                    vectors.append(vs[i].copy())
                    continue
                if block is None:
                    block, ids, vectors = _Block(ids, vectors, c), [], []
                for d, found in block.search(own_id, vs[i], np.inf if bound is None else bound, quantile, c.k):
                    out[0].append(own_id)
                    out[1].append(found)
                    out[2].append(d)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _FOUND.types, strict=True)], schema=_FOUND)

    return rows.repartition("block", "turn").sortWithinPartitions("block", "turn", "role").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _placed(df: DataFrame, splits: list, c: AnnConfig) -> DataFrame:
    """df (id, v) with the cell and the projection of each vector."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vs = _matrix(batch.column(1))
            p, widths = np.empty((len(vs), c.dims)), np.array([len(v) for v in vs])
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                p[at] = np.stack([vs[i] for i in at]) @ projection(width, c)
            offsets = pa.array(np.arange(len(vs) + 1, dtype=np.int32) * c.dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves(splits, p)), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=["id", "v", "cell", "p"])

    return df.mapInArrow(place, "id long, v array<double>, cell long, p array<double>")


def _visits(bounded: DataFrame, cells: np.ndarray, low: np.ndarray, high: np.ndarray, c: AnnConfig) -> DataFrame:
    """(id, v, bound, cell) for every cell, but the query's own, that the stopping test doesn't rule out; of (id, v, p, home, bound)."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantile = chi_square_quantile(c.confidence, c.dims)
        for batch in batches:
            rows, goals = [], []
            bounds = batch.column(4).to_pylist()
            for i, (p, home) in enumerate(zip(_matrix(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                open_ = cells != home
                if bounds[i] is not None:
                    open_ &= box_gaps(low, high, p) <= quantile * bounds[i] ** 2
                own = cells[open_]
                rows.append(np.full(len(own), i))
                goals.append(own)
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
            for k in range(0, len(at), 4096):  # a query's copies are given in small batches
                own = at.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(own) for x in (0, 1, 4)), pa.array(np.concatenate(goals)[k : k + 4096], pa.int64())], names=["id", "v", "bound", "cell"])

    return bounded.select("id", "v", "p", "home", "bound").mapInArrow(visit, "id long, v array<double>, bound double, cell long")


def nearest(vectors: DataFrame, queries: DataFrame, config: AnnConfig = AnnConfig(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance, ties to the smaller id.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part, on either side;
    of vectors of several widths only those of the query's width are compared. Rows that share an id are candidates one
    by one, but an id is never a candidate of itself and is listed once, with its smallest distance; of queries that share an id
    the one with the smallest components, in order, is asked. Without candidates a query gives no row. Other columns are not looked at. The result lies in the shared folder.
    """
    c = config

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))

    most = vectors.count()  # reads no column
    drawn = _placed(valid(vectors).sample(min(1.0, c.sample_rows / max(1, most)), seed=c.seed), [], c).select("p").limit(2 * c.sample_rows).collect()
    points = np.array([r.p for r in drawn]).reshape(-1, c.dims)
    cut = max(1, min(c.max_cells, -(-most // c.cell_rows)))
    splits = KdTree(points, max(1, -(-len(points) // cut))).splits

    base = materialize(_placed(valid(vectors), splits, c).select("*", F.monotonically_increasing_id().alias("row")), "ann-base")
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(c.dims)]
    boxes = base.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()  # at most twice max_cells rows
    cells, low, high = (np.array([[r[f"{x}{i}"] for i in range(c.dims)] for r in boxes]) if x else np.array([r.cell for r in boxes], np.int64) for x in ("", "low", "high"))
    parts = base.sparkSession.createDataFrame([(int(r.cell), -(-r.n // c.block_rows)) for r in boxes], "cell long, parts int")
    asked = materialize(_placed(valid(queries).groupBy("id").agg(F.min("v").alias("v")), splits, c).select("id", "v", "p", F.col("cell").alias("home")), "ann-queries")

    def passed(goals: DataFrame) -> DataFrame:
        """The result of sending queries (id, v, bound, cell) to all blocks of their cells."""
        turns = goals.groupBy("cell").agg(F.ceil(F.count("*") / c.query_rows).cast("int").alias("turns"))
        about = F.broadcast(materialize(parts.join(turns, "cell"), "ann-cells"))  # at most twice max_cells rows
        name = F.concat_ws("-", "cell", "part").alias("block")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = base.join(about, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).select(name, "id", "v", F.explode(every("turns")).alias("turn"))
        right = goals.join(about, "cell").select("id", "v", "bound", "cell", F.pmod(F.xxhash64("id"), F.col("turns")).cast("int").alias("turn"), F.explode(every("parts")).alias("part")).select(name, "turn", "id", "v", "bound")
        return materialize(_search(left, right, c), "ann-found")

    home = passed(asked.select("id", "v", F.lit(None).cast("double").alias("bound"), F.col("home").alias("cell")))
    kth = _ranked(home, c.k).where(F.col("rank") == c.k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    goals = materialize(_visits(asked.join(kth, "id", "left"), cells, low, high, c), "ann-visits")
    out = materialize(_ranked(home.union(passed(goals)), c.k), "ann-result")
    for used in (base, asked, home, goals):
        drop_scratch(used)
    return out


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
