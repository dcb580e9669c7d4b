"""How filters of documents interact, in every order, from contingency tensors.

Each document is judged by all five filters once. What is kept of it is one cell of a table
of counts: for each part of the corpus how many documents pass or fail each filter, a tensor
of 2 x 2 x 2 x 2 x 2. Everything that an order of filters does at a step is a contraction
of that tensor: along each axis a selector takes pass, fail or both. The texts
are read once, whatever the number of orders; the tensors have 32 cells for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import prepare, stored
from tickloom.llm.rolling import pieces
from tickloom.llm.words import sums, word_blocks

FILTERS = "ABCDE"
LEAST_WORDS = 50  # A
LEAST_DISTINCT = 65  # B: percent of the words
MOST_CAPITALS = 5  # C: percent of the code points
MARKS = b"#$%&*|"  # D
PARTS_AT_ONCE = 32  # parts whose rows are made together

_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("docs", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_verdicts(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails, A the lowest."""
    out = []
    for _, data, at in pieces(column):
        words, distinct = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            seen: set[bytes] = set()
            n = 0
            for block in word_blocks(data[a:b].tobytes()):
                n += len(block)
                seen.update(block)
            words.append(n)
            distinct.append(len(seen))
        n, d = np.array(words, np.int64), np.array(distinct, np.int64)
        points = sums((data & 0xC0) != 0x80, at)
        fails = (n < LEAST_WORDS, 100 * d < LEAST_DISTINCT * n, 100 * sums(_CAPITAL[data], at) > MOST_CAPITALS * points, sums(_MARK[data], at) > 0)
        out.append(sum(f.astype(np.int32) << i for i, f in enumerate(fails)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per document: ``part, cell, good, toxic``; bit i of ``cell`` tells that filter i fails.

    A text's first document is found by an aggregation over digests of the texts. A document passes E where it is that
    first one, so the join back is on digest and id together: no key of it is shared by a text's copies.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("id"), batch.column("digest"), pa.array(text_verdicts(batch.column("text")), pa.int32())],
                ["part", "id", "digest", "cell"],
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).alias("id"), F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("text"))
    rows = stored(rows.mapInArrow(judge, f"part string, id {kind}, digest binary, cell int"), "verdicts")

    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("digest", "id", F.lit(True).alias("first"))
    again = F.col("first").isNull() & F.col("id").isNotNull()
    rows = rows.join(first, ["digest", "id"], "left").select("part", "id", (F.col("cell") + F.when(again, 1 << 4).otherwise(0)).alias("cell"))

    marks = labels.where(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(F.col(key).alias("id"))
    marks = marks.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    return rows.join(marks, "id", "left").select("part", "cell", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def contractions(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """``{count: [part, order, step]}`` from ``tensors[part, measure, A, B, C, D, E]`` (index 1: the filter fails)."""
    orders = list(permutations(range(len(FILTERS))))
    steps = range(len(FILTERS))

    def selectors(choose) -> np.ndarray:
        """``[order and step, axis, index]``; ``choose(place of the axis in the order, step)``."""
        return np.array([[choose(order.index(axis), step) for axis in range(len(FILTERS))] for order in orders for step in steps], np.int64)

    def contract(choose, chosen: np.ndarray) -> np.ndarray:
        s = selectors(choose)
        got = np.einsum("pmabcde,ra,rb,rc,rd,re->pmr", chosen, *(s[:, i] for i in range(len(FILTERS))), optimize=True)
        return got.reshape(*got.shape[:2], len(orders), len(FILTERS))

    docs = tensors[:, :1]
    removed = contract(lambda place, step: PASS if place < step else FAIL if place == step else ALL, tensors)
    out = {
        "kept": contract(lambda place, step: PASS if place <= step else ALL, docs)[:, 0],
        "removed": removed[:, 0],
        "redundant": contract(lambda place, step: FAIL if place == step else ALL, docs)[:, 0] - removed[:, 0],
        "unique_fails": contract(lambda place, step: FAIL if place == step else PASS, docs)[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
    }
    at = np.array(orders)  # [order, step] -> filter
    shapley = np.zeros((len(tensors), len(FILTERS)), np.int64)
    for i in range(len(FILTERS)):
        shapley[:, i] = (out["removed"] * (at == i)).sum((1, 2))
    out["shapley"] = shapley[:, at]
    return out


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters (120) and step (1 to 5) with the counts of ``COUNTS``.

    ``shapley`` is the filter's removals summed over all orders, so it is divided by 120 to get its Shapley value. A null
    text counts as empty, a null part as the empty string. A row without id has no smaller and is no smaller id, so it
    passes E and makes nothing fail; rows repeated with id and text do not make each other fail. Of several labels of
    an id one that says 1 counts. Labels without document and other columns are not read. An empty table gives no rows.
    """
    cells = judged(docs, labels, key, text, part).groupBy("part", "cell")
    cells = cells.agg(F.count(F.lit(1)).alias("docs"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))  # 32 at most

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = ["".join(FILTERS[i] for i in p) for p in permutations(range(len(FILTERS)))]
        for batch in batches:
            for start in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(start, PARTS_AT_ONCE)
                lists = some.column("cells")
                owner, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
                tensors = np.zeros((len(lists), len(MEASURES), 1 << len(FILTERS)), np.int64)
                for m, name in enumerate(MEASURES):
                    tensors[owner, m, flat.field("cell").to_numpy()] = flat.field(name).to_numpy()
                # Bit 0 of a cell is the last axis of a reshape, and the first filter.
                shaped = tensors.reshape(len(lists), len(MEASURES), *[2] * len(FILTERS)).transpose(0, 1, *range(1 + len(FILTERS), 1, -1))
                got = contractions(shaped)
                per_part = len(orders) * len(FILTERS)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").take(pa.array(np.repeat(np.arange(len(lists)), per_part))),
                        pa.array([o for o in orders for _ in FILTERS] * len(lists)),
                        pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(orders) * len(lists)), pa.int32()),
                        *(pa.array(np.ascontiguousarray(got[c]).ravel()) for c in COUNTS),
                    ],
                    ["part", "filter_order", "step", *COUNTS],
                )

    return parts.mapInArrow(contracted, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def _audit_sql() -> str:
    """The same for DuckDB: the cells once, then sums over the cells that an order has let through."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    bit_of = "CASE " + " ".join(f"WHEN f = '{f}' THEN {b}" for f, b in bits.items()) + " END"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), cells AS (
  SELECT part,
         (CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[{MARKS.decode()}]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS cell,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM texts
), counts AS (
  SELECT part, cell, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM cells GROUP BY ALL
), letters AS (SELECT unnest({list(FILTERS)}) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, {bit_of} AS own,
         list_sum(list_transform(string_split(substr(filter_order, 1, step), ''), lambda f: {bit_of})) - ({bit_of}) AS before
  FROM orders, (SELECT unnest(range(1, {len(FILTERS) + 1})) AS step)
), counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
         CAST(coalesce(sum(docs) FILTER (cell & CAST(before + own AS BIGINT) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(docs) FILTER (cell & own > 0 AND cell & CAST(before AS BIGINT) = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(docs) FILTER (cell & own > 0 AND cell & CAST(before AS BIGINT) > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(docs) FILTER (cell = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (cell & own > 0 AND cell & CAST(before AS BIGINT) = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (cell & own > 0 AND cell & CAST(before AS BIGINT) = 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""


AUDIT_SQL = _audit_sql()
