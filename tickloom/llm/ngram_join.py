"""Jaccard self-join of word n-gram sets with prefix trees.

Every text is a set of n-grams in one global order, rare ones first as far as a fixed-size count of
all n-grams tells. Two sets as similar as asked share an n-gram of their prefixes, so sets meet at the
smallest member (the centre) of every group that shares a prefix n-gram. There the whole ordered sets
are stored in a trie: a set walks down it once for all sets that begin alike, carrying
the overlap so far, and leaves a subtree whose remaining lengths cannot reach the
overlap needed. Equal sets are one set throughout. Only links that join something new are
kept, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, forget, prepare, stored
from tickloom.llm.grouped import batched, key_groups
from tickloom.llm.rolling import ODD, Prefix, mix, pieces
from tickloom.llm.shipping import shipped, unsqueezed

CELLS = 1 << 21  # counters of the n-gram statistics, whatever the corpus
STRIPE = 1 << 16  # counters summed together
HELD_GRAMS = 1 << 20  # n-grams whose cells are counted at once
BLOCK_SETS = 1024  # sets of one centre compared in one piece


def gram_hashes(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of some texts, and the text each is from.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer words is
    one gram as a whole.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.append(~((data == 32) | ((data >= 9) & (data <= 13))), False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = Prefix(data).of(starts, stops)
    texts = np.searchsorted(at, starts, "right") - 1
    counts = np.bincount(texts, minlength=len(at) - 1)
    begin = np.cumsum(counts) - counts
    runs = max(len(words) - n + 1, 0)
    total = np.zeros(runs, np.uint64)
    for j in range(n):
        total = mix(total + words[j : j + runs] * ODD + np.uint64(j + 1))
    whole = (texts[:runs] == texts[n - 1 :]) if runs else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    small = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        more = counts[short] > j
        small[more] = mix(small[more] + words[begin[short[more]] + j] * ODD + np.uint64(100 + j))
    return np.concatenate([total[whole], small]), np.concatenate([texts[:runs][whole], short])


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def gram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How often n-grams of each cell occur in all texts: ``CELLS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, held = np.zeros(CELLS, np.int64), []
        for batch in batches:
            for _, data, at in pieces(batch.column("text")):
                held.append(cells(gram_hashes(data, at, n)[0]))
                if sum(map(len, held)) >= HELD_GRAMS:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        parts = total.reshape(-1, STRIPE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([int(total.sum()) % 16] * len(parts), pa.int32()), pa.array([squeeze(p) for p in parts], pa.binary())],
            ["stripe", "salt", "counts"],
        )

    def squeeze(counts: np.ndarray) -> bytes:
        return pa.compress(counts.tobytes(), "zstd", asbytes=True)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(STRIPE, np.int64)
        for part in group["counts"].to_pylist():
            total += np.frombuffer(pa.decompress(part, 8 * STRIPE, "zstd"), np.int64)
        return pa.table({"stripe": group["stripe"][:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([squeeze(total)], pa.binary())})

    fields = "stripe int, salt int, counts binary"
    parts = texts.select("text").mapInArrow(count, fields).groupBy("stripe", "salt").applyInArrow(add, fields)
    parts = parts.groupBy("stripe").applyInArrow(add, fields).toPandas()  # CELLS numbers in all
    out = np.zeros((CELLS // STRIPE, STRIPE), np.int64)
    for stripe, got in zip(parts["stripe"], parts["counts"]):
        out[stripe] = np.frombuffer(pa.decompress(got, 8 * STRIPE, "zstd"), np.int64)
    return out.reshape(-1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """A class of 0 to 15 for each cell, frequent ones last."""
    usual = max(float(np.median(counts)), 1.0)
    return np.clip(np.log2(np.maximum(counts, 1) / usual + 0.5) * 4 + 2, 0, 15).astype(np.uint64)


def ordered_sets(data: np.ndarray, at: np.ndarray, n: int, classes: np.ndarray) -> list[np.ndarray]:
    """Each text's n-grams as increasing numbers of 60 bits: the class, then the hash."""
    hashes, texts = gram_hashes(data, at, n)
    tokens = (classes[cells(hashes)].astype(np.uint64) << np.uint64(56)) | (mix(hashes) >> np.uint64(8))
    order = np.argsort(texts, kind="stable")
    tokens, counts = tokens[order], np.bincount(texts, minlength=len(at) - 1)
    out = []
    for part in np.split(tokens, np.cumsum(counts)[:-1]) if len(counts) else []:
        part = np.sort(part)
        out.append(part[np.append(True, part[1:] != part[:-1])] if len(part) else part)
    return out


def node_of(tokens: np.ndarray) -> int:
    """A number for a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(a: int, b: int, percent: int) -> int:
    """Overlap that sets of these sizes need: percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Ordered sets that begin alike share their beginnings; every node has a run of leaves."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        common = [0]
        for a, b in pairwise(sets):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common.append(int(differ.argmax()) if differ.any() else m)
        # (from, to, low, high, children): tokens from..to of leaf low, above leaves low..high
        self.root = self._node(0, 0, len(sets), common)

    def _node(self, depth: int, low: int, high: int, common: list[int]) -> list:
        """Built with a stack: a long text's chain of branches must not exhaust recursion."""
        root: list = [depth, depth, low, high, []]
        todo = [root]
        while todo:
            node = todo.pop()
            _, start, low, high, children = node
            # Leaves that end here are children without tokens.
            begins = [low, *(i for i in range(low + 1, high) if common[i] <= start), high]
            for a, b in pairwise(begins):
                stop = len(self.sets[a]) if b - a == 1 else min(common[a + 1 : b])
                child = [start, stop, a, b, []]
                children.append(child)
                if b - a > 1:
                    todo.append(child)
        return root

    def partners(self, q: int, least: int, percent: int, component: np.ndarray) -> Iterator[int]:
        """Leaves from ``least`` on that are similar to leaf ``q`` and not in its component yet."""
        own, size = self.sets[q], len(self.sets[q])
        stack = [(child, 0) for child in self.root[4]]
        while stack:
            (start, stop, low, high, children), overlap = stack.pop()
            if high <= least or (component[max(low, least) : high] == component[q]).all():
                continue
            part = self.sets[low][start:stop]
            place = np.searchsorted(own, part)
            overlap += int((own[np.minimum(place, size - 1)] == part).sum())
            left = size - int(np.searchsorted(own, part[-1], "right")) if len(part) else size
            lengths = self.sizes[low:high]
            if overlap + min(left, int(lengths.max()) - stop) < needed(size, int(lengths.min()), percent):
                continue
            if not children:
                if overlap >= needed(size, len(self.sets[low]), percent):
                    yield low
                continue
            stack += [(c, overlap) for c in children]


def trie_links(sets: list[np.ndarray], asks: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the components of some sets; only sets that ``asks`` marks look for partners."""
    order = sorted(range(len(sets)), key=[t.astype(">u8").tobytes() for t in sets].__getitem__)
    arrays = [sets[i] for i in order]
    trie = Trie(arrays, np.array([len(a) for a in arrays]))
    component, asks, all_ask = component[order].copy(), asks[order], bool(asks.all())
    for q in np.flatnonzero(asks).tolist():
        for p in trie.partners(q, q + 1 if all_ask else 0, percent, component):
            if component[p] != component[q]:
                component[component == component[p]] = component[q]
                yield order[q], order[p]
        if (component == component[0]).all():
            return


def row_name(key: str, text: str) -> Column:
    """What rows of one key and text share; never null."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))


def similar_sets(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """``key, n_shingles, component_id`` for each row of ``docs``.

    Two texts link when ``100 * overlap >= percent * union`` of their n-gram sets. A null
    text or one without words has an empty set and links with nothing. Repeated rows and
    equal sets are one class. Keys are whole numbers; a row with a null key is compared like any other, and its
    ``component_id`` is null if its class has no key at all.
    """
    rows = set_classes(docs, n, percent, key, text, block_sets)
    return rows.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def set_classes(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """``id, name, size, component, component_id`` for each row of ``docs``: its ``row_name``, the size of its set, and its class.

    ``component`` is a number that the class alone has, null for an empty set; ``component_id`` is the smallest key in the class.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), row_name(key, text).alias("name"), F.col(text).cast("string").alias("text"))
    # 16 classes of rarity for a fixed number of cells: 2 MB, whatever the corpus.
    classes = spark.sparkContext.broadcast(rarity(gram_counts(rows, n)).astype(np.uint8))

    def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, at in pieces(batch.column("text")):
            yield from ordered_sets(data, at, n, classes.value)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, sizes, firsts = [], [], []
            for tokens in sets_of(batch):
                size = len(tokens)
                nodes.append(node_of(tokens) if size else None)
                sizes.append(size)
                firsts.append(tokens[: size - -(-percent * size // 100) + 1].view(np.int64) if size else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("name"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                ["id", "name", "node", "size", "prefix"],
            )

    known = stored(rows.mapInArrow(prefixes, "id long, name long, node long, size long, prefix array<long>"), "prefixes")
    nodes = known.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    grams = nodes.select("node", F.floor(F.log("size") / (1.0001 * math.log(100 / percent))).cast("int").alias("band"), F.explode("prefix").alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    active = stored(grams.join(shared, "gram"), "shared-grams")
    # Similar sets lie in the same or neighbouring bands of size: a gram whose other holders are all
    # much larger or smaller brings nothing together.
    bands = active.groupBy("gram", "band").count()
    near = bands.select("gram", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "count")
    near = near.groupBy("gram", "band").agg(F.sum("count").alias("n")).where("n > 1").select("gram", "band")
    active = active.join(near, ["gram", "band"]).select("gram", "node")
    centres = active.groupBy("gram").agg(F.min("node").alias("centre"))
    members = stored(active.join(centres, "gram").select("node", "centre").distinct(), "members")

    # The texts of those sets alone that meet another one, one text for each set. They are shipped
    # compressed and become sets again where they meet.
    least = known.where("size > 0").groupBy("node").agg(F.min("name").alias("id"))
    wanted = stored(least.join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    texts = shipped(rows.select(F.col("name").alias("id"), "text"), wanted.select("id"))

    def group_sets(group: pa.RecordBatch) -> dict[int, tuple[int, np.ndarray]]:
        """Row and set of each node of a group; what came by a repeated name is left out."""
        out: dict[int, tuple[int, np.ndarray]] = {}
        every = (tokens for _, data, at in pieces(unsqueezed(group)) for tokens in ordered_sets(data, at, n, classes.value))
        for row, (node, tokens) in enumerate(zip(group.column("node").to_pylist(), every)):
            if node not in out and node_of(tokens) == node:
                out[node] = row, tokens
        return out

    sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("blocks"))
    dealt = members.join(sizes, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # The centre visits every block of its members, so that what it links needs no more comparing.
    visits = dealt.where("node = centre").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.where("node <> centre").unionByName(visits).join(wanted, "node")
    met = placed.join(texts, "id").select("centre", "block", "blocks", "node", "bytes", "squeezed")
    met = met.repartition("centre", "block").sortWithinPartitions("centre", "block")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.bool_()), ("block", pa.int32())])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within blocks; members of several blocks that their centre does not reach come as ``apart``."""

        def run() -> Iterator[tuple]:
            for group in key_groups(batches, ["centre", "block"]):
                found = group_sets(group) if group.num_rows > 1 else {}
                ids = list(found)
                if len(ids) < 2:
                    continue
                centre, block, blocks = (group.column(c)[0].as_py() for c in ("centre", "block", "blocks"))
                component = np.arange(len(ids))
                for i, j in trie_links([t for _, t in found.values()], np.ones(len(ids), bool), component, percent):
                    component[component == component[j]] = component[i]
                    yield ids[i], ids[j], False, block
                if blocks > 1:
                    held = component[ids.index(centre)] if centre in found else -1
                    yield from ((node, centre, True, block) for node, c in zip(ids, component) if c != held)

        yield from batched(run(), links)

    found = stored(met.mapInArrow(inside, "a long, b long, apart boolean, block int"), "set-links")
    edges = found.where("not apart").select("a", "b")
    apart = found.where("apart").select(F.col("a").alias("node"), F.col("b").alias("centre"), "block")
    if not apart.isEmpty():
        # What the centre did not reach meets the other blocks, its own part of them at a time.
        flags = apart.withColumn("free", F.lit(True))
        targets = placed.join(flags.select("node", "centre", "free").distinct(), ["node", "centre"], "left")
        targets = targets.join(apart.select("centre", F.col("block").alias("asker")).distinct(), "centre").where("asker <> block")
        askers = apart.join(sizes, "centre").withColumnRenamed("block", "asker").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("asker <> block")
        both = targets.select("centre", "block", "asker", "node", F.coalesce("free", F.lit(False)).alias("free"), F.lit(False).alias("asks")).unionByName(
            askers.select("centre", "block", "asker", "node", F.lit(True).alias("free"), F.lit(True).alias("asks"))
        )
        both = both.join(wanted, "node").join(texts, "id").repartition("centre", "block", "asker").sortWithinPartitions("centre", "block", "asker")

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def run() -> Iterator[tuple]:
                for group in key_groups(batches, ["centre", "block", "asker"]):
                    found = group_sets(group)
                    ids, rows_of = list(found), [row for row, _ in found.values()]
                    free = np.array(group.column("free").to_pylist(), bool)[rows_of]
                    component = np.where(free, np.arange(len(ids)) + 1, 0)  # what the centre reaches is one
                    asks = np.array(group.column("asks").to_pylist(), bool)[rows_of]
                    if not asks.any():
                        continue
                    for i, j in trie_links([t for _, t in found.values()], asks, component, percent):
                        yield ids[i], ids[j], False, 0

            yield from batched(run(), links)

        more = stored(both.mapInArrow(across, "a long, b long, apart boolean, block int"), "set-links")
        edges = edges.union(more.select("a", "b"))

    reached = components(edges, "set-components")
    every = known.where("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    every = every.join(reached, every["node"] == reached["id"], "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    lowest = every.groupBy("component").agg(F.min("least").alias("component_id"))
    classes_of = every.join(lowest, "component").select("node", "component", "component_id")
    return known.select("id", "name", "size", "node").join(classes_of, "node", "left").select("id", "name", "size", "component", "component_id")


SETS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS size, unnest(s) AS gram FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""
