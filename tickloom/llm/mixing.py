"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is put into a fixed random order and cut into blocks of documents. Targets in words say how many whole
passes over a source the mix takes and where in its order the last, partial pass ends; that gives an
exact quota of blocks for each source. A tree of output shards splits the quotas: at each node the
left half of the shards draws its blocks without replacement from those of the node, so its share of each source
is multivariate hypergeometric, and the right half gets the others. Quotas are met exactly and every shard is a fair
sample. The blocks that a shard was given are disjoint stretches of a keyed permutation of the source's blocks; its documents are shuffled
inside the shard. Equal seeds give equal mixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import prepare, stored
from tickloom.llm.words import word_counts

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST_REPEATS = 3
BLOCK_WORDS = 1 << 16  # of a source's documents on average
SHARD_BLOCKS = 256
COARSE = 10  # bits: blocks that are summed together on the way to the end of a pass
MOST_SOURCES = 100_000  # their targets are made on the driver and broadcast
NODES = 256  # of the splitting tree, made before it is dealt out
_ORDER_BITS = 60


@dataclass(frozen=True)
class Target:
    """One source: what it has, what the mix wants of it."""

    number: int
    source: str | None
    size: int
    weight: int
    words: float

    @property
    def passes(self) -> int:
        return math.floor(self.words / self.size) if self.size else 0

    @property
    def rest(self) -> float:
        """Words of the last, partial pass."""
        return max(0.0, self.words - self.passes * self.size)


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> list[Target]:
    """Shares of all words by weight, no source above ``most_repeats`` times its size; what is cut off goes to the others by weight.

    Sources are numbered by code point, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set[str | None] = set()
    while True:
        left = sum(sizes.values()) - sum(most_repeats * sizes[s] for s in capped)
        parts = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] > most_repeats * sizes[s] * parts}
        if not over:
            break
        capped |= over
    return [Target(i, s, sizes[s], weight[s], float(most_repeats * sizes[s]) if s in capped else left * weight[s] / parts) for i, s in enumerate(order)]


def ordered(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns of ``docs`` (or those of ``keep``), then ``_size`` in words, ``_source`` and ``_order``, a place from 0 to 2**60 that seed, id and text decide."""
    prepare(docs.sparkSession)
    docs = docs.drop("_size", "_source", "_order")
    kept = [c for c in docs.columns if keep is None or c in keep]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), whole), 256)
    place = F.conv(F.substring(digest, 1, _ORDER_BITS // 4), 16, 10).cast("long")
    rows = docs.select(*kept, F.col(source).cast("string").alias("_source"), place.alias("_order"), whole.alias("_size"))
    names = rows.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(word_counts(batch.columns[-1]))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(measure, f"{fields}, _size long")


def _blocks(size: int, block_words: int) -> int:
    """Bits of the number of blocks of a source."""
    return min(_ORDER_BITS, max(0, math.ceil(math.log2(max(1, size) / block_words))))


def _facts(found: list[Target], block_words: int) -> list[tuple]:
    return [(t.number, t.source, t.size, t.words, t.passes, t.rest, _ORDER_BITS - _blocks(t.size, block_words)) for t in found]


def _ends(cells: DataFrame, at: str, facts: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """``_no, <at>, _before``: for each source the cell in which its partial pass ends, and the words before it."""
    window = Window.partitionBy("_no").orderBy(at)
    rows = cells.join(F.broadcast(facts.select("_no", "_rest")), "_no")
    start = F.lit(0)
    if bounds is not None:
        rows = rows.join(F.broadcast(bounds), ["_no", "_coarse"])
        start = F.col("_start")
    rows = rows.withColumn("_before", start + F.coalesce(F.sum("_words").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The first cell that reaches the end; sources of which no partial pass is taken have none.
    ends = rows.where((F.col("_rest") > 0) & (F.col("_before") + F.col("_words") >= F.col("_rest")) & (F.col("_before") < F.col("_rest")))
    return ends.select("_no", at, "_before")


def _permuted(position: np.ndarray, count: int, seed: Sequence[int]) -> np.ndarray:
    """A keyed permutation of 0..count-1 at the given positions: a Feistel network, walked until it lands inside."""
    half = max(1, (int(count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(list(seed)).integers(1, 2**63, 6, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            left, right = right, left ^ ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & mask
        return left << np.uint64(half) | right

    out = once(position.astype(np.uint64))
    while (outside := out >= np.uint64(count)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def split(low: int, high: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotas of the left and the right half of the shards ``low`` to ``high`` - 1."""
    blocks, shards = int(quotas.sum()), high - low
    draws = blocks * (shards // 2) // shards
    rng = np.random.default_rng([seed, low, high])
    left = np.zeros_like(quotas)
    # One source after the other: how many of the draws left fall on it.
    rest = blocks
    for i, held in enumerate(quotas.tolist()):
        rest -= held
        left[i] = rng.hypergeometric(held, rest, draws) if held and draws and max(held, rest) < 10**9 else _large(rng, held, rest, draws)
        draws -= int(left[i])
    return left, quotas - left


def _large(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw beyond the range of the library's: by its normal limit, kept inside its bounds."""
    if not good or not draws:
        return 0
    if not bad:
        return draws
    n = good + bad
    share = good / n
    spread = math.sqrt(draws * share * (1 - share) * (n - draws) / max(1, n - 1))
    return int(min(max(round(rng.normal(draws * share, spread)), draws - bad, 0), good, draws))


def _tree(nodes: list[tuple[int, int, np.ndarray, np.ndarray]], seed: int, most: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Leaves below the nodes ``(low, high, quotas, first block of each source)``, or a level of at least ``most`` nodes."""
    while nodes:
        if most is not None and len(nodes) >= most:
            break
        inner = [n for n in nodes if n[1] - n[0] > 1]
        yield from (n for n in nodes if n[1] - n[0] <= 1)
        nodes = []
        for low, high, quotas, first in inner:
            left, right = split(low, high, quotas, seed)
            middle = low + (high - low) // 2
            nodes += [(low, middle, left, first), (middle, high, right, first + left)]
    yield from nodes


@dataclass(frozen=True)
class Mix:
    """A mix of rows. ``sources`` has one row for each source, ``places`` one for each block drawn."""

    rows: DataFrame
    sources: DataFrame
    places: DataFrame
    shards: int
    seed: int

    def documents(self) -> DataFrame:
        """Every row with ``_source_size``, ``_target`` and ``_shards``: the shards that hold a copy of it, as often as the mix repeats it."""
        by_block = self.places.groupBy("_no", "_block").agg(F.collect_list(F.struct("_pass", "_shard")).alias("_places"))  # a row for each pass
        taken = F.transform(F.filter("_places", lambda p: p["_pass"] < F.col("_copies")), lambda p: p["_shard"])
        rows = self.rows.join(by_block, ["_no", "_block"], "left")
        return rows.withColumn("_shards", F.coalesce(taken, F.array().cast("array<long>"))).drop("_places", "_no", "_block", "_copies")

    def shuffled(self, key: str = "doc_id") -> DataFrame:
        """The mix itself: a row for each copy, with ``_shard`` and its ``_position`` there, one task for each shard."""
        order = F.xxhash64(F.lit(self.seed), "_shard", "_order", "_copy")
        copies = self.documents().select("*", F.posexplode("_shards").alias("_copy", "_shard")).withColumn("_turn", order)
        # A shard has a fixed number of blocks.
        inside = Window.partitionBy("_shard").orderBy("_turn", F.col(key), "_copy")
        return copies.withColumn("_position", F.row_number().over(inside) - 1).drop("_turn", "_shards", "_copy", "_order")


def mix(
    rows: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS, seed: int = 0, key: str = "doc_id",
) -> Mix:
    """Mix rows that ``ordered`` has prepared (and that were stored, since they are read several times).

    A document belongs to the partial pass if its middle word lies before the pass's end. A source's words therefore come
    within half a document of its target. Null texts and texts without words have size 0 and
    travel with their block. A null source is a source of its own. Rows with one id and text share a place, and
    are taken one by one. An empty table gives an empty mix.
    """
    spark = prepare(rows.sparkSession)
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("n"))
    sizes = stored(sizes, "source-sizes")
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    found = targets({r["_source"]: int(r["n"]) for r in sizes.toPandas().astype(object).where(lambda d: d.notna(), None).to_dict("records")}, weights, most_repeats)
    facts = spark.createDataFrame(_facts(found, block_words), "_no int, _named string, _source_size long, _target double, _passes int, _rest double, _shift int")

    same = F.col("_source").eqNullSafe(F.col("_named"))
    placed = rows.join(F.broadcast(facts), same).withColumn("_block", F.expr("shiftright(_order, _shift)"))

    # Where the partial pass of each source ends: among groups of blocks, then in one group, then in one block.
    blocks = stored(placed.groupBy("_no", "_block", F.shiftright("_block", COARSE).alias("_coarse")).agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_docs")), "blocks")
    coarse = _ends(blocks.groupBy("_no", "_coarse").agg(F.sum("_words").alias("_words")), "_coarse", facts, None)
    ends = _ends(blocks, "_block", facts, coarse.withColumnRenamed("_before", "_start"))
    ends = stored(ends, "pass-ends").select("_no", F.col("_block").alias("_end"), F.col("_before").alias("_start"))

    placed = placed.join(F.broadcast(ends), "_no", "left")
    inside = placed.where("_block = _end")
    along = Window.partitionBy("_no").orderBy("_order", key, "_size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_start") + F.sum("_size").over(along)
    inside = inside.withColumn("_copies", F.col("_passes") + (2 * upto - F.col("_size") < 2 * F.col("_rest")).cast("int"))
    others = placed.where("_end IS NULL OR _block <> _end").withColumn("_copies", F.col("_passes") + F.coalesce((F.col("_block") < F.col("_end")).cast("int"), F.lit(0)))
    every = others.unionByName(inside)

    # Blocks of the whole passes, then of the partial one: the quota of a source.
    bits = [_ORDER_BITS - f[6] for f in _facts(found, block_words)]
    last = {int(r["_no"]): int(r["_end"]) + 1 for r in ends.toPandas().to_dict("records")}  # a row for each source
    quotas = np.array([t.passes * (1 << b) + last.get(t.number, 0) for t, b in zip(found, bits)], np.int64)
    shards = max(1, math.ceil(int(quotas.sum()) / shard_blocks))
    top = list(_tree([(0, shards, quotas, np.zeros_like(quotas))], seed, NODES)) if quotas.sum() else []
    nodes = spark.createDataFrame([(low, high, q.tolist(), f.tolist()) for low, high, q, f in top], "low long, high long, quotas array<long>, first array<long>")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                node = (row["low"], row["high"], np.array(row["quotas"], np.int64), np.array(row["first"], np.int64))
                for shard, _, counts, first in _tree([node], seed, None):
                    for no in np.flatnonzero(counts).tolist():
                        unit = _permuted(np.arange(first[no], first[no] + counts[no]), int(quotas[no]), [seed, no])
                        which, block = np.divmod(unit, 1 << bits[no])
                        n = len(unit)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, no, np.int32)), pa.array(block), pa.array(which.astype(np.int32)), pa.array(np.full(n, shard))], ["_no", "_block", "_pass", "_shard"])

    places = stored(nodes.repartition(min(NODES, max(1, len(top)))).mapInArrow(place, "_no int, _block long, _pass int, _shard long"), "places")
    return Mix(every.drop("_named", "_passes", "_rest", "_shift", "_end", "_start"), facts, places, shards, seed)


def mix_sql(weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = 0) -> str:
    """Sizes, targets and words taken of every document, for DuckDB. A source is at its cap if those with less room for their weight leave it too much."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + str(len(weights)) + " " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights)) + " END"
    return f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {_ORDER_BITS // 4}) AS place
  FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (SELECT *, {weight} AS weight FROM sizes
), filled AS (
  SELECT *, (SELECT sum(source_size) FROM sizes) - coalesce(sum({most_repeats} * source_size) OVER before, 0) AS remains,
         sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS parts
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(remains AS BIGINT) AS remains, CAST(parts AS BIGINT) AS parts FROM filled
  WHERE remains * weight <= {most_repeats} * source_size * parts ORDER BY source_size / weight, source LIMIT 1
), wanted AS (
  SELECT source, source_size,
         CASE WHEN remains * weight > {most_repeats} * source_size * parts THEN CAST({most_repeats} * source_size AS DOUBLE)
              ELSE CAST(remains * weight AS DOUBLE) / CAST(parts AS DOUBLE) END AS target
  FROM weighed, level
), laid AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY docs.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN wanted ON docs.source IS NOT DISTINCT FROM wanted.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (passes + CASE WHEN target - passes * source_size > 0 AND 2 * upto - size < 2 * (target - passes * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM laid
"""


MIX_SQL = mix_sql()
