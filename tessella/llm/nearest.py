"""Nearest neighbours by inner product over low-dimensional stable projections and kd-trees.

Vectors are lifted by one coordinate so that the nearest in Euclidean distance is the one of the largest inner
product, and projected by a Gaussian (2-stable) matrix. One kd-tree indexes all projections: its upper levels, built on
a bounded sample of SAMPLE_ROWS, deal every row to a cell; each cell's own tree goes down to leaves of LEAF rows.

A query visits leaves in the order of their projected distance and verifies their rows on the original vectors, but for
rows beyond the reach of a chi-square test: rows as near as the k-th found so far are, with probability STOP, projected
within a reach that shrinks as better rows are found. It stops when the next leaf is beyond that reach. It starts in
its own cell; what it has found there goes with it to those other cells that are within reach, and to no others. So a
row moves twice whatever the number of queries, and a query once for each cell within its reach.

Edge cases: vectors that are null, zero, or hold a null or non-finite number take no part, nor do those whose length
isn't the most frequent one; equal vectors are one point that stands for its k + 1 smallest ids, so they neither cost
more nor push out others; repeated rows count once, and of an id with several vectors the best score counts, whether it
is the neighbour or the query; an id is never its own neighbour; ids that are null take no part; without queries or
candidates the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import staging

NEIGHBOURS = 20
PROJECTIONS = 8
STOP = 0.95
LEAF = 64
CELL_ROWS = 4_096
#: Queries that are searched in a cell by one task; a cell that more visit is searched by several.
QUERY_ROWS = 16_384
MOST_PARTITIONS = 4_096
SAMPLE_ROWS = 200_000
#: A cell needs that many sampled rows.
SAMPLED = 12


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x) / 2
    return 1 - np.exp(-half) * sum(half**k / factorial(k) for k in range(freedom // 2))


def quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < p else (low, mid)
    return high


class KdTree:
    """Rows in leaf order, leaf borders, and each leaf's bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        borders, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                borders.append((a, b))
                continue
            part = points[self.order[a:b]]
            axis = int((part.max(0) - part.min(0)).argmax())
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        borders.sort()
        self.borders = np.array(borders)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.borders[:, 0])
        self.high = np.maximum.reduceat(sorted_points, self.borders[:, 0])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.borders)))
        for k in range(queries.shape[1]):
            q = queries[:, k : k + 1]
            gap = np.maximum(np.maximum(self.low[:, k] - q, q - self.high[:, k]), 0)
            out += gap * gap
        return out


class Cells:
    """Upper levels of the kd-tree: halves of a sample by the widest axis, and the region of each."""

    def __init__(self, points: np.ndarray, leaf: float):
        m = points.shape[1]
        self.axis, self.value, self.child = [], [], []
        self.low, self.high = [], []
        todo = [(points, np.full(m, -np.inf), np.full(m, np.inf), None)]
        while todo:
            part, low, high, parent = todo.pop()
            wide = part.max(0) - part.min(0) if len(part) else np.zeros(m)
            axis = int(wide.argmax())
            cut = float(np.median(part[:, axis])) if len(part) else 0.0
            right = part[:, axis] >= cut if len(part) else np.zeros(0, bool)
            ends = len(part) < 2 * leaf or right.all()
            node = ~len(self.low) if ends else len(self.axis)
            if parent is not None:
                self.child[parent[0]][parent[1]] = node
            else:
                self.root = node
            if ends:
                self.low.append(low)
                self.high.append(high)
                continue
            self.axis.append(axis)
            self.value.append(cut)
            self.child.append([0, 0])
            for side in (0, 1):
                own_low, own_high = low.copy(), high.copy()
                (own_low if side else own_high)[axis] = cut
                todo.append((part[right] if side else part[~right], own_low, own_high, (node, side)))
        self.axis, self.value, self.child = np.array(self.axis, int), np.array(self.value), np.array(self.child, int).reshape(-1, 2)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def __len__(self) -> int:
        return len(self.low)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.full(len(points), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            node[inner] = self.child[at, (points[inner, self.axis[at]] >= self.value[at]).astype(int)]
        return ~node

    def within(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose regions are within this squared distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(1) <= reach)


def matrix(dimensions: int, m: int = PROJECTIONS) -> np.ndarray:
    """The projection of lifted vectors: the last row is for the coordinate added."""
    return np.random.default_rng(11).standard_normal((dimensions + 1, m))


def projections(x: np.ndarray, a: np.ndarray, most_norm2: float) -> np.ndarray:
    return x @ a[:-1] + np.sqrt(np.maximum(most_norm2 - (x * x).sum(1), 0))[:, None] * a[-1]


def best_ids(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids, ties to the smaller."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


class Searcher:
    """The rows of one cell: (point, id), equal vectors together."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, most_norm2: float):
        plain = np.ascontiguousarray(vectors + 0.0)
        _, at, group = np.unique(plain.view(np.dtype((np.void, plain.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        self.members, self.begin = ids[order], np.searchsorted(group[order], np.arange(len(at) + 1))
        self.a = matrix(plain.shape[1])
        points = projections(plain[at], self.a, most_norm2)
        self.tree = KdTree(points)
        self.x, self.points, self.which = plain[at][self.tree.order], points[self.tree.order], self.tree.order
        self.size = self.tree.borders[:, 1] - self.tree.borders[:, 0]
        self.most_norm2 = most_norm2
        self.twice = len(np.unique(ids)) < len(ids)  # some id has several vectors here

    def ids_of(self, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        point = self.which[rows]
        n = self.begin[point + 1] - self.begin[point]
        return self.members[np.repeat(self.begin[point] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(scores, n)

    def kth(self, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> float:
        """The k-th best score found among other ids; -inf for fewer. Points stand for one id at least, but may share it."""
        if not self.twice:
            return float(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]) if len(scores) > k else -np.inf
        ids, each = self.ids_of(rows, scores)
        ids, each = ids[ids != own], each[ids != own]
        best = best_ids(ids, each, k)
        return float(each[best[-1]]) if len(best) == k else -np.inf

    def search(self, q: np.ndarray, own: int, near: np.ndarray, known: float, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best found of one query, which already knows k scores of ``known`` or more elsewhere."""
        norm2 = float(q @ q)
        reach_of = lambda score: bound * max(self.most_norm2 + norm2 - 2 * score, 0)
        projected = q @ self.a[:-1]
        leaves, done, step = near.argsort(), 0, max(2, -(-2 * k // LEAF))
        rows, scores, kth = np.zeros(0, np.int64), np.zeros(0), known
        reach = reach_of(kth) if kth > -np.inf else np.inf
        while done < len(leaves) and near[leaves[done]] <= reach:
            part = leaves[done : done + step]
            n = self.size[part]
            new = np.repeat(self.tree.borders[part, 0] - np.cumsum(n) + n, n) + np.arange(n.sum())
            if reach < np.inf:
                gap = self.points[new] - projected
                new = new[np.einsum("ij,ij->i", gap, gap) <= reach]
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q])
            done, step = done + step, step * 2
            if len(scores) > k:
                kth = max(kth, self.kth(rows, scores, own, k))
                if kth > -np.inf:
                    some = scores >= kth - 1e-9 * (1 + abs(kth))  # near ties are settled below, by one way of adding up
                    rows, scores = rows[some], scores[some]
                    reach = reach_of(kth)
        ids, exact = self.ids_of(rows, (self.x[rows] * q).sum(1))
        ids, exact = ids[ids != own], exact[ids != own]
        best = best_ids(ids, exact, k)
        return ids[best], exact[best]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = v if isinstance(v, pa.Array) else v.chunk(0)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _dealt(sent, most_norm2: float) -> Callable:
    """Arrow function: rows with the cell that their projection lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, a = sent.value
        for batch in batches:
            if batch.num_rows:
                cell = cells.of(projections(_vectors(batch.column(1)), a, most_norm2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return run


def _asked(sent, most_norm2: float, bound: float, others: bool) -> Callable:
    """Arrow function: queries (id, v, known) with their nearest cell, or with the others within reach of what they know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, a = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            points, norm2, known = x @ a[:-1], (x * x).sum(1), batch.column(2).to_numpy()
            own = cells.of(points)
            if others:
                reach = bound * np.maximum(most_norm2 + norm2 - 2 * known, 0)  # inf where fewer than k are known
                lists = [c[c != o] for c, o in zip((cells.within(p, r) for p, r in zip(points, reach, strict=True)), own, strict=True)]
            else:
                lists = [own[i : i + 1] for i in range(len(own))]
            which = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
            cell = np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(which)) for i in range(3)), pa.array(cell)], names=["id", "v", "known", "cell"])

    return run


def _searcher(most_norm2: float, k: int, bound: float) -> Callable:
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return _OUT.empty_table()
        cell = Searcher(_vectors(data.column("v")), data.column("id").to_numpy(), most_norm2)
        x, own, known = _vectors(queries.column("v")), queries.column("id").to_numpy(), queries.column("known").to_numpy()
        out: list[tuple] = []
        for first in range(0, len(x), 256):
            near = cell.tree.distances(x[first : first + 256] @ cell.a[:-1])
            for i, leaves in enumerate(near, first):
                ids, scores = cell.search(x[i], own[i], leaves, known[i], k, bound)
                out.append((np.full(len(ids), own[i]), ids, scores))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_OUT)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v double array, norm2): the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(good).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.where((F.col("norm2") > 0) & (F.col("norm2") < float("inf")))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return once.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = NEIGHBOURS, stop: float = STOP, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    staging.ship(spark)
    rows = usable(vectors, id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("norm2"))
    top = size.orderBy(F.desc("n"), "d").limit(1).collect()
    d, n, norm2 = tuple(top[0]) if top else (1, 0, 1.0)
    norm2, bound = float(norm2), quantile(stop, PROJECTIONS)
    rows = rows.where(F.size("v") == d).select("id", "v")
    # the index: upper levels on a sample, then every row's cell; equal vectors are thinned to the ids that can count
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE_ROWS).select("v").toArrow()
    a = matrix(d)
    points = projections(_vectors(sample["v"]), a, norm2) if sample.num_rows else np.zeros((0, PROJECTIONS))
    cells = Cells(points, max(SAMPLED if share < 1 else 1, cell_rows * share))
    sent = spark.sparkContext.broadcast((cells, a))
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    thin = rows.select("id", "v", F.dense_rank().over(alike).alias("place")).where(F.col("place") <= k + 1).select("id", "v")
    data = staging.stage(thin.distinct().mapInArrow(_dealt(sent, norm2), "id long, v array<double>, cell int"), "vectors")
    asked = data.where(F.col("id") % every == 0)
    asked = rows.where(F.col("id") % every == 0).distinct() if n else asked.select("id", "v")

    def searched(asked: DataFrame, others: bool, name: str) -> DataFrame:
        visits = staging.stage(asked.mapInArrow(_asked(sent, norm2, bound, others), "id long, v array<double>, known double, cell int"), name)
        parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # one row a cell at most
        left = data.join(parts, "cell").select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = visits.join(parts, "cell").select("id", "v", "known", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
        # searching costs far more than these rows weigh, so their number of partitions isn't left to their size
        left, right = (x.repartition(min(4 * len(cells), MOST_PARTITIONS), "cell", "part") for x in (left, right))
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(_searcher(norm2, k, bound), "query_id long, vec_id long, score double")

    nothing = F.lit(float("-inf"))
    first = staging.stage(_ranked(searched(asked.select("id", "v", nothing.alias("known")), False, "own-cell"), k), "near")
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    again = asked.join(known, "id", "left").select("id", "v", F.coalesce("known", nothing).alias("known"))
    found = first.select("query_id", "vec_id", "score").union(searched(again, True, "other-cells"))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
