"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of rotated principal
components lose little; started from several random rotations it gives several balanced codes. Every
code is cut into substrings, each the key of one Hamming table. Rows of one label that share a key
meet there and are reranked with their original vectors. A pair that meets more than
once counts in its first table only. Equal vectors are one row throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.collision_search import usable
from tickloom.llm.common import components, prepare, stored

SAMPLE_ROWS = 10_000  # rows on which rotations are learned, those with the smallest hashes
ROUNDS = 30
MISSED = 0.005  # chance that a pair just at the threshold shares no table
ROWS_PER_KEY = 32  # rows that a key has on average, before labels part them
BLOCK_ROWS = 512  # rows of one key compared in one piece


def learn_rotation(unit: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Directions whose signs are the bits: principal axes, rotated to lose least by quantisation."""
    dim = unit.shape[1]
    _, axes = np.linalg.eigh(np.cov(unit, rowvar=False).reshape(dim, dim) if len(unit) > 1 else np.eye(dim))
    projected = unit @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    return axes @ rotation


def table_plan(rows: int, dim: int, threshold: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for so many rows."""
    bits = min(dim, 30, max(6, round(math.log2(max(rows, 1) / ROWS_PER_KEY + 1))))
    same = 1 - math.acos(threshold) / math.pi  # chance that a bit agrees
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(same**bits)))


class Codes:
    """Keys of all Hamming tables for vectors of one dimension."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int):
        dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        per = max(1, dim // bits)
        self.bits, self.tables, self.per = min(bits, dim), tables, per
        self.rotations = [learn_rotation(unit, seed) for seed in range(math.ceil(tables / per))]
        self.middle = [np.median(unit @ r, axis=0) for r in self.rotations]  # balanced bits

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        out = []
        for rotation, middle in zip(self.rotations, self.middle):
            sign = unit @ rotation >= middle
            out += [sign[:, i * self.bits : (i + 1) * self.bits] @ weight for i in range(self.per)]
        return np.stack(out[: self.tables], 1)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place that the links ``a - b`` reach."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def compare(table_no: int, ids: np.ndarray, weight: np.ndarray, keys: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Links found first in this table: ``(id, linked weight, an id to join it with)`` for each row that has any."""
    cos = unit[left] @ unit[right].T
    at, to = np.nonzero(cos >= threshold)
    a, b = left[at], right[to]
    keep = (a < b) if left is right else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    if table_no and len(a):
        new = ~(keys[a, :table_no] == keys[b, :table_no]).any(1)
        a, b = a[new], b[new]
    if not len(a):
        return
    count = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    low = roots(len(ids), a, b)
    for i in np.flatnonzero(count):
        yield int(ids[i]), int(count[i]), int(ids[low[i]])


class Rows:
    """The columns of some rows as arrays; lists of equal length within a key."""

    def __init__(self, batch: pa.RecordBatch):
        plain = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        self.ids, self.side, self.weight = plain("rep"), plain("side"), plain("weight")
        self.no, self.block_a, self.block_b = plain("table_no"), plain("block_a"), plain("block_b")
        self.lists = {}
        for name in ("keys", "vector"):
            column = batch.column(name)
            self.lists[name] = (column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]))
        label = batch.column("label").dictionary_encode().indices.to_numpy()
        marks = np.stack([plain("dim"), label, self.no, plain("value"), self.block_a, self.block_b])
        #: places at which another key begins
        self.starts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1]) if len(self.ids) else np.zeros(0, int)

    def part(self, name: str, a: int, b: int) -> np.ndarray:
        flat, at = self.lists[name]
        return flat[at[a] : at[b]].reshape(b - a, -1)

    def links(self, a: int, b: int, threshold: float) -> list[tuple[int, int, int]]:
        vectors = self.part("vector", a, b).astype(np.float64)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        if self.block_a[a] == self.block_b[a]:
            left = right = np.arange(b - a)
        else:
            left, right = np.flatnonzero(self.side[a:b] == 0), np.flatnonzero(self.side[a:b] == 1)
        return list(compare(int(self.no[a]), self.ids[a:b], self.weight[a:b], self.part("keys", a, b), unit, left, right, threshold))


def rerank(threshold: float):
    """Compare the rows of each key; a key's rows follow one another in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in chain(batches, [None]):
            if batch is None and rest is None:
                return
            held = [b for b in (rest, batch) if b is not None]
            joined = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if not joined.num_rows:
                continue
            rows = Rows(joined)
            # The last key may go on in the next batch.
            stops = [*rows.starts[1:].tolist(), *([joined.num_rows] if batch is None else [])]
            found = [x for a, b in zip(rows.starts.tolist(), stops) if b - a > 1 for x in rows.links(a, b, threshold)]
            rest = None if batch is None else joined.slice(int(rows.starts[-1]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["rep", "links", "near"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, n_links, component_id, kept``: one row for each row of ``vectors``.

    Rows link when their labels are equal and not null, their dimensions equal and their
    cosine, in double precision, is at least ``threshold``. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without label, link with nothing. ``n_links`` counts the
    other rows a row is linked with, repeated rows each; ``component_id`` is the smallest key reachable.
    Keys are whole numbers; a null key is kept as it is and never a component's id unless alone.
    """
    spark = prepare(vectors.sparkSession)
    # Single precision is shuffled as it is; every comparison is in double.
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("rep", F.when(F.col("ok"), F.xxhash64("label", "vector")))
    reps = stored(
        rows.where("ok").groupBy("rep").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("id").alias("least"))
        .withColumn("dim", F.size("vector")),
        "vectors",
    )
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().toPandas().to_dict("records")}  # a row for each dimension
    codes: dict[int, Codes] = {}
    for dim, n in sizes.items():
        sample = reps.where(F.col("dim") == dim).orderBy("rep").limit(SAMPLE_ROWS).select("vector").toPandas()
        codes[dim] = Codes(np.array(sample["vector"].tolist(), np.float64), *table_plan(n, dim, threshold))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_pylist()
            keys: list = [None] * len(dims)
            vectors = batch.column("vector").to_pylist()
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                for i, k in zip(at, codes[dim].keys(np.array([vectors[i] for i in at], np.float64)).tolist()):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    fields = f"rep long, label string, vector {kind}, weight long, dim int, keys array<long>"
    coded = reps.select("rep", "label", "vector", "weight", "dim").mapInArrow(code, fields)
    placed = coded.select("*", F.posexplode("keys").alias("table_no", "value"))
    where = ["dim", "label", "table_no", "value"]
    crowded = placed.groupBy(*where).count().where(F.col("count") > block_rows)
    crowded = stored(crowded.select(*where, F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "crowded")
    placed = placed.join(crowded, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A crowded key is dealt out in blocks; every two blocks meet once.
    own = F.pmod(F.xxhash64("rep", "table_no"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select(
        *where, F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "weight", "keys", "vector",
    )
    keys = [*where, "block_a", "block_b"]
    met = met.repartition(*keys).sortWithinPartitions(*keys)
    found = stored(met.mapInArrow(rerank(threshold), "rep long, links long, near long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b")), "vector-components")
    least = reps.select("rep", "least").join(reached, reps["rep"] == reached["id"], "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = least.join(lowest, "component").join(links, "rep", "left").join(reps.select("rep", "weight"), "rep")
    facts = facts.select("rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    every = rows.select("id", "rep").join(facts, "rep", "left")
    return every.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


LINKS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
), unit AS (
  SELECT * FROM usable WHERE list_dot_product(v, v) > 0 AND isfinite(list_dot_product(v, v))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
