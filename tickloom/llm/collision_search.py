"""Nearest neighbours by collision counting over single projections.

Every random direction keeps the rows of a shard in one sorted array. A query opens a window
around its own projection in each array; a row collides once for each window it lies in. The
windows are widened together (virtual rehashing: no table is built anew); rows that collide in
at least a set share of the arrays are verified with their original vectors, until a row as near as the
k-th best would have collided so often. Largest inner products are nearest distances once each row gets one more component that
makes all norms equal and the query has that norm, too. Rows of similar norms are searched together, the longest first, so that this component stays small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import prepare

SHARD_ROWS = 8192  # rows indexed together; sorted arrays are built for each shard
STRETCHES = 256  # parts of a sorted array by which windows grow
QUERY_ROWS = 2048  # queries that visit a shard together
ARRAYS = 2  # sorted arrays for each dimension
SHARE = 0.6  # of the arrays in which a row must collide to be verified
SURE = 3.0  # standard deviations of a row's collisions by which a row as near as the k-th best is expected to pass that share
BAND = 1.25  # most between the norms of rows that are searched together
FIRST, WIDER = 0.9, 1.12  # half of a first window in standard deviations; factor from one widening to the next


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(dim: int, arrays: int) -> np.ndarray:
    """Blocks of random orthogonal directions, the same in every task."""
    rng = np.random.default_rng(dim)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(arrays)])


class Band:
    """Sorted projections of some rows, and counting search over them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, arrays: int = ARRAYS):
        self.ids, self.rows, self.longest = ids, rows, longest
        fill = np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))
        self.axes = directions(rows.shape[1] + 1, arrays)
        projected = np.hstack([rows, fill[:, None]]) @ self.axes
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)
        self.first = max(FIRST * float(projected.std(0).mean()), 1e-12)  # half of a first window
        # Each row's stretch of each array. A window is a run of stretches.
        n, m = len(ids), projected.shape[1]
        self.width = max(1, math.ceil(n / STRETCHES))
        self.stretch = np.empty((m, n), np.uint8)
        np.put_along_axis(self.stretch, order.T, (np.arange(n) // self.width).astype(np.uint8)[None, :], 1)
        # Half of a window, for a distance of one, in which a row lies so often that its collisions pass the share surely.
        self.need = max(1, math.ceil(SHARE * m))
        a, z = self.need / m, SURE**2 / m
        often = (2 * a + z + math.sqrt((2 * a + z) ** 2 - 4 * (1 + z) * a**2)) / (2 * (1 + z))
        self.reach = min(1.0, NormalDist().inv_cdf(min((1 + often) / 2, 1 - 1e-12)) / math.sqrt(len(self.axes)))

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First stretch and number of stretches, less one, of each query's window in each array."""
        low, high = (np.stack([np.searchsorted(column, at[:, j] + x, side) for j, column in enumerate(self.sorted)], 1) for x, side in ((-half, "left"), (half, "right")))
        low = np.minimum(low, len(self.ids) - 1) // self.width
        high = np.maximum(high - 1, 0) // self.width
        return low.astype(np.uint8), np.maximum(high - low, 0).astype(np.uint8)

    def search(self, asked: np.ndarray, best: Best) -> None:
        """Offer rows for the queries with these numbers, until none that is better than their ``k``-th best is to be expected."""
        n, m = len(self.ids), len(self.stretch)
        lengths = np.linalg.norm(best.queries, axis=1)
        at = np.hstack([best.queries * (self.longest / lengths)[:, None], np.zeros((len(lengths), 1))]) @ self.axes
        waiting, half = asked, np.full(len(lengths), self.first)
        seen = np.zeros((len(lengths), n), bool)
        off, inside = np.empty((m, n), np.uint8), np.empty((m, n), bool)
        while len(waiting):
            low, wide = self.windows(at[waiting], half[waiting])
            whole = (low == 0).all(1) & (wide >= (n - 1) // self.width).all(1)
            still = []
            for q, first, reach, all_in in zip(waiting.tolist(), low, wide, whole.tolist()):
                # Stretches below a window's begin wrap around and lie beyond its end.
                np.subtract(self.stretch, first[:, None], out=off)
                np.less_equal(off, reach[:, None], out=inside)
                often = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if m < 256 else np.uint16) >= self.need
                found = np.flatnonzero(often & ~seen[q])
                seen[q, found] = True
                best.offer(q, self.ids[found], self.rows[found])
                least = best.least(q)
                # Distance of the k-th best once the query is as long as the rows.
                far = math.sqrt(max(0.0, 2 * self.longest * (self.longest - least / lengths[q]))) if least > -math.inf else math.inf
                if all_in or far * self.reach <= half[q]:
                    continue
                half[q] = max(half[q] * WIDER, far * self.reach) if far < math.inf else half[q] * WIDER
                still.append(q)
            waiting = np.array(still, int)


class Best:
    """The ``k`` best rows so far of some queries."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.ids = [np.zeros(0, np.int64) for _ in query_ids]
        self.scores = [np.zeros(0) for _ in query_ids]

    def offer(self, q: int, ids: np.ndarray, rows: np.ndarray) -> None:
        own = ids != self.query_ids[q]
        score = np.concatenate([self.scores[q], (rows @ self.queries[q])[own]])
        ids = np.concatenate([self.ids[q], ids[own]])
        if len(ids) > self.k:
            close = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[close], score[close]
        order = np.lexsort((ids, -score))[: self.k]
        self.ids[q], self.scores[q] = ids[order], score[order]

    def least(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) >= self.k else -math.inf


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, then ids and inner products of the ``k`` best rows found, best first.

    A band of norms that cannot hold a better row is left out; one of few rows is verified whole.
    """
    norms = np.linalg.norm(rows, axis=1)
    order = np.argsort(-norms, kind="stable")
    ids, rows, norms = ids[order], rows[order], norms[order]
    best, lengths = Best(query_ids, queries, k), np.linalg.norm(queries, axis=1)
    start = 0
    while start < len(ids):
        longest = float(norms[start])
        stop = max(start + 1, int(np.searchsorted(-norms, -longest / BAND, "right")))
        held = slice(start, stop)
        asked = np.array([q for q in range(len(query_ids)) if best.least(q) <= lengths[q] * longest * (1 + 1e-9)], int)
        if not len(asked):
            break
        if stop - start <= max(STRETCHES, k):
            for q in asked.tolist():
                best.offer(q, ids[held], rows[held])
        else:
            Band(ids[held], rows[held], longest).search(asked, best)
        start = stop
    for q, found, score in zip(query_ids.tolist(), best.ids, best.scores):
        yield int(q), found, score


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows in double precision."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def visit(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        asked = np.array(group["asked"].to_pylist(), bool)
        ids, rows = group["id"].to_numpy(), matrix(group["vector"])
        out: list[tuple] = []
        if asked.any() and not asked.all():
            for query_id, found, score in search(ids[~asked], rows[~asked], ids[asked], rows[asked], k):
                out += [(query_id, i, s) for i, s in zip(found.tolist(), score.tolist())]
        query_id, found, score = zip(*out) if out else [()] * 3
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query.

    Keys are whole numbers. Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows of another dimension than the query's or with the query's own key. Ties go to the smaller
    key; repeated rows are candidates each. No rows without queries or candidates.
    """
    prepare(base.sparkSession)
    rows = lambda df: df.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.size(vector).alias("dim"))
    base, queries = rows(base), rows(queries)
    n = int(base.count())
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(int(queries.count()) / QUERY_ROWS))
    spread = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = base.select("*", spread(1, shards).alias("shard"), each(blocks).alias("block"), F.lit(False).alias("asked"))
    asking = queries.select("*", each(shards).alias("shard"), spread(2, blocks).alias("block"), F.lit(True).alias("asked"))
    visits = held.unionByName(asking).groupBy("dim", "shard", "block")
    found = visits.applyInArrow(visit(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each shard at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
