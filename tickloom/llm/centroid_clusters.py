"""Clusters around centroids in whole numbers, found through a vantage-point tree.

Vectors become integers once. In each round a vantage-point tree is built over the centroids and
broadcast; every vector goes through it best first, by its own queue of subtrees ordered by the least distance that
the triangle inequality leaves. A subtree is left out only if that bound is greater than the best
distance found, so equally near centroids are all seen and the smaller number wins. Distances at the
nodes are exact integers; only the bounds are rounded, and always downwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import prepare, stored

DIM = 64
SCALE = 1024
CENTROIDS, ROUNDS, SEED = 8, 10, 3
MOST_CENTROIDS = 65_536  # their tree is broadcast
#: Components up to this keep every squared distance below 2**63.
LARGEST = 1 << 27
_SLACK = 1e-9  # far above the rounding of a square root


@dataclass
class VantageTree:
    """Node i stands for the centroid ``number[i]`` and has up to two subtrees.

    ``near`` and ``far`` are node indices or -1; ``reach`` holds the least and greatest distance from the
    node's centroid to those of each subtree.
    """

    centroids: np.ndarray
    number: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    far: list[int] = field(default_factory=list)
    reach: list[tuple[float, float, float, float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.centroids):
            self._build(np.arange(len(self.centroids)))

    def _build(self, members: np.ndarray) -> int:
        """The node over ``members``; the one farthest from the first is its vantage point."""
        squares = squared(self.centroids[members], self.centroids[members[0]])
        at = int(np.argmax(squares))
        vantage, rest = int(members[at]), np.delete(members, at)
        node = len(self.number)
        self.number.append(vantage)
        self.near.append(-1)
        self.far.append(-1)
        self.reach.append((0.0, 0.0, 0.0, 0.0))
        if len(rest):
            away = np.sqrt(squared(self.centroids[rest], self.centroids[vantage]).astype(float))
            order = np.argsort(away, kind="stable")
            half = (len(rest) + 1) // 2
            inner, outer = order[:half], order[half:]
            bounds = [away[inner].min(), away[inner].max(), 0.0, 0.0]
            self.near[node] = self._build(rest[inner])
            if len(outer):
                bounds[2:] = [away[outer].min(), away[outer].max()]
                self.far[node] = self._build(rest[outer])
            self.reach[node] = tuple(bounds)
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; ties go to the smaller number.

        All rows advance together, each through its own queue: a row of ``bound`` holds the least possible distance of
        every subtree that waits for it, and each step opens the one with the smallest.
        """
        rows = len(vectors)
        best = np.full(rows, np.iinfo(np.int64).max)
        number = np.full(rows, -1, np.int64)
        bound = np.full((rows, len(self.number)), np.inf)
        bound[:, 0] = 0.0
        active = np.arange(rows)
        while len(active):
            waiting = bound[active]
            node = np.argmin(waiting, axis=1)
            least = waiting[np.arange(len(active)), node]
            # Inclusive: a subtree as near as the best may hold a smaller number.
            goes_on = np.isfinite(least) & (least <= np.sqrt(best[active].astype(float)) * (1 + _SLACK))
            active, node, least = active[goes_on], node[goes_on], least[goes_on]
            for i in np.unique(node).tolist():
                own = active[node == i]
                exact = squared(vectors[own], self.centroids[self.number[i]])
                better = (exact < best[own]) | ((exact == best[own]) & (self.number[i] < number[own]))
                best[own[better]], number[own[better]] = exact[better], self.number[i]
                away, inherited = np.sqrt(exact.astype(float)), bound[own, i]
                bound[own, i] = np.inf
                for child, low, high in ((self.near[i], *self.reach[i][:2]), (self.far[i], *self.reach[i][2:])):
                    if child >= 0:
                        gap = np.maximum(low * (1 - _SLACK) - away * (1 + _SLACK), away * (1 - _SLACK) - high * (1 + _SLACK))
                        bound[own, child] = np.maximum(gap, inherited)
        return number, best


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances; components are integers of at most ``LARGEST``."""
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and those as floor(scale * x)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = sizes == dim
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    finite = np.isfinite(values).all(axis=1)
    kept = np.flatnonzero(right)[finite]
    scaled = np.floor(values[finite] * float(scale))
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: its squared distances do not fit 64 bits")
    return kept, scaled.astype(np.int64)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("vector")
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _means(rows: DataFrame, tree: VantageTree, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors nearest to each centroid."""
    names = [f"s{i}" for i in range(dim)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(tree.centroids), np.int64)
        total = np.zeros((len(tree.centroids), dim), np.int64)
        for batch in batches:
            vectors = _vectors(batch, dim)
            number, _ = tree.nearest(vectors)
            for c in np.unique(number).tolist():
                own = number == c
                count[c] += own.sum()
                total[c] += vectors[own].sum(axis=0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count[held]), *(pa.array(total[held, i]) for i in range(dim))], ["cluster", "n", *names])

    parts = rows.select("vector").mapInArrow(add_up, "cluster long, n long, " + ", ".join(f"{n} long" for n in names))
    # One row for each centroid, whatever the corpus. Sums of many tasks may pass 64 bits.
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names])
    return {int(r["cluster"]): (int(r["n"]), [int(r[n]) for n in names]) for r in sums.toPandas().to_dict("records")}


def starting_centroids(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest digest of seed and id, in that order; rows without id come last."""
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(k).select("vector").toPandas()["vector"]
    return np.array([np.frombuffer(bytes(v), "<i4") for v in first], np.int64).reshape(-1, dim)


def cluster(
    base: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; the others give no row. Of fewer than
    ``k`` vectors each starts a centroid. Equal centroids, as repeated rows start them, leave all vectors to the smallest number; an
    empty centroid stays where it is. A row without id is clustered like any other and starts a centroid only after all with
    id. Components beyond 131,072 are refused, since their distances do not fit a long. An empty table gives no rows.
    """
    if k > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids: their tree is broadcast")
    spark = prepare(base.sparkSession)
    kind = base.schema[key].dataType.simpleString()

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = whole_numbers(batch.column("vector"), dim, scale)
            blobs = pa.array([v.tobytes() for v in whole.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), blobs], ["id", "vector"])

    rows = base.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where(F.size("vector") == dim)
    rows = stored(rows.mapInArrow(quantise, f"id {kind}, vector binary"), "vectors")

    centroids = starting_centroids(rows, k, seed, dim)
    for _ in range(rounds if len(centroids) else 0):
        before = centroids.copy()
        for c, (n, total) in _means(rows, VantageTree(centroids), dim).items():
            centroids[c] = [s // n for s in total]  # exact, rounded down
        if (centroids == before).all():
            break  # further rounds would change nothing
    tree = VantageTree(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = tree.nearest(_vectors(batch, dim))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    found = stored(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    # One row for each centroid.
    inertias = found.groupBy("cluster").agg(F.sum("distance").alias("n")).toPandas()
    by_cluster = dict(zip(inertias["cluster"].tolist(), inertias["n"].tolist()))
    digests = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids.tolist()]
    facts = [(c, n, sum(by_cluster.values()), digests[c]) for c, n in by_cluster.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """The same for DuckDB, one pair of tables for each round."""
    steps = []
    nearest = """
  SELECT row_no, v, c AS cluster, d FROM (
    SELECT v.row_no, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM vectors v, centroids{r} c)
  QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, c) = 1"""
    for r in range(rounds):
        steps.append(f"""near{r} AS MATERIALIZED ({nearest.format(r=r)}
), sums{r} AS (
  SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {dim + 1})) AS p FROM near{r}) GROUP BY ALL
), centroids{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.m, c.m) AS m FROM centroids{r} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM sums{r} GROUP BY cluster) m ON m.cluster = c.c
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), vectors AS MATERIALIZED (SELECT *, row_number() OVER () AS row_no FROM kept
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id) - 1 AS c, v AS m FROM vectors
  ORDER BY sha256('{seed}:' || vec_id), vec_id LIMIT {k}
), {', '.join(steps)}, last AS MATERIALIZED ({nearest.format(r=rounds)}
)
SELECT vectors.vec_id, CAST(last.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY last.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM last JOIN vectors USING (row_no) JOIN centroids{rounds} ON c = last.cluster
"""


CLUSTERS_SQL = clusters_sql()
