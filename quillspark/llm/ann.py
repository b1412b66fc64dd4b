"""Nearest neighbours by inner product, through stable projections and kd-trees.

Vectors gain one component that makes their lengths equal, so that the largest
inner product is the least Euclidean distance. DIMS Gaussian projections follow
(2-stable: a projected squared distance over the true one is chi-square with DIMS
degrees of freedom). Every block of vectors has a kd-tree over its projections; a
query takes its projected neighbours leaf by leaf, the nearest leaf first, verifies
them on the original components, and after each leaf stops if the chi-square test
says that a vector nearer than its k-th so far is left with probability under
1 - CERTAIN.

All rows are indexed, in blocks of about BLOCK; queries meet every block (a stated
query set against all rows, in blocks), and the nearest of each block are merged.
A block's index is built once, by the task that holds the block; the queries then
come to it in a stream, so a task holds one block and one batch of queries.

Every vector whose components are all finite and not all zero takes part, whatever
its magnitude: the index works on vectors divided by the greatest component, scores
are taken from the originals. A product that overflows is infinite, as in double
precision; one that is not a number counts as the least. Queries meet the vectors
of their own length. Null vectors, empty ones, zero ones, those that hold null or
non-finite components, and rows with a null id take no part, as query or candidate.
Equal vectors tie and go by id. Rows of one id are candidates each, and are not the
query's own; an id with several vectors asks with the least of the shortest.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, stored, tidy

DIMS = 16
BLOCK = 8192
#: Tasks at most; beyond it, a task has several blocks, one after the other.
MOST_TASKS = 20_000
#: Queries that are worked on at once.
TOGETHER = 256
LEAF = 256
CERTAIN = 0.95
K = 20


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection on the regularised lower incomplete gamma function's series."""

    def cdf(x: float) -> float:
        a, x = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, 10.0 * dims + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


class KdTree:
    """Median splits of the widest side down to leaves: an order of the points in which every leaf is a run, and its box."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        leaves, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            p = points[self.order[a:b]]
            low, high = p.min(axis=0), p.max(axis=0)
            if b - a <= LEAF:
                leaves.append((a, b, low, high))
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, int((high - low).argmax())], mid)]
            todo += [(a + mid, b), (a, a + mid)]
        self.span = [(a, b) for a, b, _, _ in leaves]
        self.low, self.high = np.array([x[2] for x in leaves]), np.array([x[3] for x in leaves])

    def distances(self, at: np.ndarray) -> np.ndarray:
        """Squared distances of points to the leaves' boxes: (points, leaves)."""
        out = np.zeros((len(at), len(self.span)))
        for i in range(at.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, i] - at[:, i : i + 1], at[:, i : i + 1] - self.high[:, i]), 0)
            out += gap * gap
        return out


def score(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each added up from the first component on: equal vectors score alike. What is not a number is the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.cumsum(vectors * q, axis=1)[:, -1]
    return np.where(np.isnan(s), -np.inf, s)


class Block:
    """The index of a block of vectors; greatest: of all components of all vectors; length: the greatest norm in that unit."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float, length: float, dims: int = DIMS):
        d = vectors.shape[1]
        scaled = vectors / greatest
        self.length = length
        self.project = np.random.default_rng(5).normal(size=(d + 1, dims))
        rest = np.sqrt(np.maximum(length**2 - (scaled**2).sum(axis=1), 0))
        points = scaled @ self.project[:d] + rest[:, None] * self.project[d]
        self.tree = KdTree(points)
        self.ids, self.vectors, self.scaled, self.points = ids[self.tree.order], vectors[self.tree.order], scaled[self.tree.order], points[self.tree.order]
        self.size = (self.points**2).sum(axis=1)
        self.stop = chi_square_quantile(CERTAIN, dims)

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For queries together: ids and scores of the k nearest but their own, and how many vectors were verified.

        Each query goes through the leaves by the distance of their boxes. After every leaf, its k-th best
        gives the projected distance up to which the test asks for neighbours; where the next box lies
        beyond it, the query is done.
        """
        q = queries / np.abs(queries).max(axis=1, keepdims=True)
        norm = np.sqrt((q**2).sum(axis=1))
        at = (q * (self.length / norm)[:, None]) @ self.project[:-1]
        at_size = (at**2).sum(axis=1)
        box = self.tree.distances(at)
        order = np.argsort(box, axis=1, kind="stable")
        found = np.full((len(q), len(self.ids)), -np.inf)
        best = np.full((len(q), k), -np.inf)
        limit, tried = np.full(len(q), np.inf), 0
        active = np.arange(len(q))
        for step in range(box.shape[1]):
            leaf = order[active, step]
            going = box[active, leaf] <= limit[active]
            active, leaf = active[going], leaf[going]
            if not len(active):
                break
            for x in np.unique(leaf).tolist():
                a, b = self.tree.span[x]
                rows = active[leaf == x]
                near = (self.points[a:b] @ (-2 * at[rows].T) + self.size[a:b, None]).T + at_size[rows][:, None] <= limit[rows][:, None]
                near &= self.ids[a:b] != own[rows][:, None]
                tried += int(near.sum())
                s = np.where(near, q[rows] @ self.scaled[a:b].T, -np.inf)
                found[rows, a:b] = s
                best[rows] = np.partition(np.concatenate([best[rows], s], axis=1), -k, axis=1)[:, -k:]
            kth = best[active].min(axis=1)
            some = np.isfinite(kth)
            apart = np.maximum(2 * self.length**2 - 2 * np.where(some, kth, 0) * self.length / norm[active], 0) * (1 + 1e-9) + 1e-12
            limit[active] = np.where(some, self.stop * apart, np.inf)
        kth = best.min(axis=1)
        ids, scores = [], []
        for i in range(len(q)):
            # a sum in another order may differ in its last digits: all that come that near are scored exactly
            at_least = kth[i] - 1e-9 * max(1.0, abs(kth[i])) if np.isfinite(kth[i]) else -np.inf
            held = np.flatnonzero((found[i] >= at_least) & (found[i] > -np.inf))
            s = score(self.vectors[held], queries[i])
            by = np.lexsort((self.ids[held], -s))[:k]
            ids.append(self.ids[held][by])
            scores.append(s[by])
        return ids, scores, tried


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, d, m): the vectors that take part, in double precision, their length and greatest component."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    return df.select("id", "v", F.size("v").alias("d"), F.array_max(F.transform("v", F.abs)).alias("m"))


def search(df: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by every."""
    spark = df.sparkSession
    ship(spark)
    rows = usable(df, id_col, vec_col)
    is_query = F.col("id") % every == 0
    norm = F.log("m") + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m")))) / 2
    sizes = stored(rows.groupBy("d").agg(F.count("*").alias("n"), F.max("m").alias("most"), F.max(norm).alias("norm")), "lengths")
    r = sizes.agg(F.max("most").alias("m"), F.max("norm").alias("norm"), F.sum(F.ceil(F.col("n") / BLOCK)).alias("blocks")).first()
    greatest = r["m"] or 1.0
    length = math.exp((r["norm"] or 0.0) - math.log(greatest)) * (1 + 1e-9)
    # blocks of a length are numbered on from those of shorter ones; written, so that the planner knows its size
    first = F.sum(F.ceil(F.col("n") / BLOCK)).over(Window.orderBy("d")) - F.ceil(F.col("n") / BLOCK)
    blocks = stored(sizes.select("d", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"), first.cast("int").alias("first")), "blocks")
    rows = rows.join(blocks, "d")
    data = rows.select((F.col("first") + F.pmod(F.xxhash64("id", "v", F.lit("block")), F.col("n_blocks"))).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    asked = rows.where(is_query).groupBy("id").agg(F.min(F.struct("d", "v", "first", "n_blocks")).alias("q")).select("id", "q.*")
    asked = asked.select(F.explode(F.sequence("first", F.col("first") + F.col("n_blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v")
    n = max(1, min(int(r["blocks"] or 1), MOST_TASKS))
    placed = data.unionAll(asked).repartitionById(n, F.col("block") % n).sortWithinPartitions("block", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's vectors come first, then those that ask it."""
        at, held, index = None, [], None
        for batch in batches:
            block, asks, ids = (batch.column(i).to_numpy() for i in range(3))
            v, start = batch.column(3), 0
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for end in [*cuts.tolist(), len(ids)]:
                if start == end:
                    continue
                part = v.slice(start, end - start).flatten().to_numpy().reshape(end - start, -1)
                own = ids[start:end]
                if block[start] != at:
                    at, held, index = block[start], [], None
                if not asks[start]:
                    held.append((own.copy(), part.copy()))
                elif held or index:
                    if index is None:
                        index = Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), greatest, length)
                        held = []
                    for a in range(0, len(own), TOGETHER):
                        near, scores, _ = index.nearest(own[a : a + TOGETHER], part[a : a + TOGETHER], k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[a : a + TOGETHER], [len(x) for x in near]), pa.int64()), pa.array(np.concatenate(near), pa.int64()), pa.array(np.concatenate(scores), pa.float64())], names=["query_id", "vec_id", "score"])
                start = end

    found = placed.mapInArrow(tidy(meet), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(df: DataFrame, found: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true k nearest in found, by brute force in numpy: for tests and small tables."""
    rows = usable(df, id_col, vec_col).orderBy("id").collect()
    assert len({r["d"] for r in rows}) <= 1
    ids, v = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])
    got: dict[int, set[int]] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for i in np.flatnonzero(ids % every == 0):
        s = score(v, v[i])
        s[ids == ids[i]] = -np.inf
        best = {int(x) for x in ids[np.lexsort((ids, -s))[:k]] if x != ids[i]}
        hit += len(best & got.get(int(ids[i]), set()))
        total += len(best)
    return hit / max(1, total)
