"""Filter audit, mixing and centroid clusters against plain versions, on small and awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import centroid_clusters, common, filter_audit, mixing, words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n", "one two", "Ä É ß", "A$ b", " ".join(f"w{i}" for i in range(60)), " ".join(["same"] * 80), "LOUD " * 60,
    "x" * 3_000_000 + " y", " ".join(f"word{i % 40}" for i in range(200_000)), "a\x0bb\x0cc\x85d\xa0e\x1cf", "\x00 \x00",
]


# --- words ------------------------------------------------------------------------


def test_words_are_counted_as_the_pattern_finds_them():
    texts = [*TEXTS, " a", "a ", "a  b", "é è", "a\nb"]
    assert words.word_counts(pa.array(texts)).tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert words.word_counts(pa.array(texts).slice(3, 5)).tolist() == [len(WORDS.findall(t or "")) for t in texts[3:8]]
    long = TEXTS[10].encode()
    assert sum(words.word_blocks(long), []) == long.split()
    assert words.word_counts(pa.array([], pa.string())).tolist() == []


# --- 11: filter audit ----------------------------------------------------------------


def fails(docs):
    """Which filters each of ``(id, text, ...)`` fails."""
    smallest = {}
    for i, text, *_ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    out = []
    for i, text, *_ in docs:
        text = text or ""
        found = WORDS.findall(text)
        out.append({
            "A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and smallest[text] < i,
        })
    return out


def audited(docs, labels):
    """{(part, order, step): counts} by letting every document through every order."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    out, removed_by = defaultdict(Counter), Counter()
    judged = fails(docs)
    for part in {s or "" for _, _, s in docs}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                out[part, order, step].update(kept=0)
    for (i, _, source), bad in zip(docs, judged):
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[source or "", order, step]
                row["unique_fails"] += bad[f] and sum(bad.values()) == 1
                if bad[f] and gone:
                    row["redundant"] += 1
                elif bad[f]:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += i in good
                    row["toxic_lost"] += i in toxic
                    removed_by[source or "", f] += 1
                row["kept"] += not gone
    return {(p, o, s): {**row, "shapley": removed_by[p, o[s - 1]]} for (p, o, s), row in out.items()}


def audit_case():
    rng = random.Random(4)
    pool = TEXTS[:9] + ["$ " + " ".join(f"w{i}" for i in range(55)), " ".join(["same"] * 80 + ["%"])]
    docs = [(rng.choice([i, i, i, max(0, i - 3), None]), rng.choice(pool), rng.choice(["s1", "s2", "", None])) for i in range(150)]
    docs += [(500, TEXTS[9], "s3"), (501, TEXTS[10], "s3"), (501, TEXTS[10], "s3"), (400, TEXTS[10], "s4")]
    labels = [(rng.randrange(160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1), (400, 1, 0), (400, 0, 1)]
    return docs, labels


def test_audit_equals_letting_every_document_through_every_order(spark):
    docs, labels = audit_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"good": F.lit(7), "cell": F.lit("x"), "digest": F.lit(1)}).repartition(5)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))).collect()
    want = audited(docs, labels)
    assert {(r.part, r.filter_order, r.step) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        row = want[r.part, r.filter_order, r.step]
        assert {c: r[c] for c in filter_audit.COUNTS} == {c: row.get(c, 0) for c in filter_audit.COUNTS}


def test_audit_of_an_empty_table_and_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and all(r.kept + r.removed + r.redundant == 1 or r.redundant == 0 for r in rows)


def test_no_key_of_the_audit_is_shared_by_copies(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a copy").alias("text"), F.lit("s").alias("source"))
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD'").collect()
    assert {r.step: (r.kept, r.removed) for r in rows} == {1: (1, 19_999), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


# --- 12: mixing ------------------------------------------------------------------------


def test_targets_are_shares_by_weight_below_the_cap():
    found = mixing.targets({"b": 10, None: 1000, "a": 300, "é": 50, "z": 0})
    assert [t.source for t in found] == ["a", "b", "z", "é", None] and [t.weight for t in found] == [5, 2, 1, 5, 2]
    total = sum(t.size for t in found)
    assert math.isclose(sum(t.words for t in found), total) and all(t.words <= 3 * t.size for t in found)
    free = [t for t in found if t.words < 3 * t.size]
    assert len({round(t.words / t.weight, 6) for t in free}) == 1
    level = free[0].words / free[0].weight
    assert all(3 * t.size <= level * t.weight + 1e-9 for t in found if t not in free)
    assert mixing.targets({}) == [] and [t.words for t in mixing.targets({"a": 0, None: 0})] == [0, 0]


def mix_docs(spark, n=600, parts=4):
    rng = random.Random(8)
    docs = [(i, rng.choice([None, "", " ".join(["w"] * rng.randrange(1, 40)), "a b"]), rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(n)]
    docs += [(3, "a b", "c"), (3, "a b", "c"), (None, "x y z", "c"), (None, "x y z", "c"), (n + 1, " ".join(["long"] * 100_000), "d"), (n + 2, "", "empty")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "_no": F.lit(9)}).drop("_no").repartition(parts)


def test_mix_meets_its_targets_and_every_copy_has_a_place(spark):
    docs, frame = mix_docs(spark)
    rows = common.stored(mixing.ordered(frame), "rows")
    made = mixing.mix(rows, block_words=64, shard_blocks=16)
    every = made.documents().collect()
    assert len(every) == len(docs)
    by_source = defaultdict(list)
    for r in every:
        assert r["_size"] == len(WORDS.findall(r["text"] or "")) and len(r["_shards"]) <= 3
        by_source[r["source"]].append(r)
    for source, own in by_source.items():
        size, target = sum(r["_size"] for r in own), own[0]["_target"]
        assert all(r["_source_size"] == size and r["_target"] == target for r in own)
        taken = sum(r["_size"] * len(r["_shards"]) for r in own)
        assert abs(taken - target) <= max([r["_size"] for r in own]) / 2 + 1
        assert max(len(r["_shards"]) for r in own) - min(len(r["_shards"]) for r in own) <= 1
    copies = made.shuffled().collect()
    assert Counter((r["doc_id"], r["text"]) for r in copies) == Counter({k: n for k, n in sum((Counter({(r["doc_id"], r["text"]): len(r["_shards"])}) for r in every), Counter()).items() if n})
    places = defaultdict(list)
    for r in copies:
        places[r["_shard"]].append(r["_position"])
    assert len(places) > 4 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {f.name for f in frame.schema.fields} <= set(made.shuffled().columns)


def test_mix_does_not_depend_on_how_the_rows_lie_and_seeds_differ(spark):
    def taken(parts, seed=0):
        rows = common.stored(mixing.ordered(mix_docs(spark, parts=parts)[1], seed=seed, keep=["doc_id"]), "rows")
        made = mixing.mix(rows, block_words=64, shard_blocks=16, seed=seed)
        return Counter((r["doc_id"], r["_size"], tuple(sorted(r["_shards"]))) for r in made.documents().collect())

    assert taken(1) == taken(7) != taken(3, seed=1)


def test_mix_of_an_empty_table_and_of_texts_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    made = mixing.mix(common.stored(mixing.ordered(empty), "rows"))
    assert made.documents().count() == made.shuffled().count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], empty.schema)
    made = mixing.mix(common.stored(mixing.ordered(blank), "rows"))
    assert [(r["_size"], r["_target"], r["_shards"]) for r in made.documents().collect()] == [(0, 0.0, [])] * 2 and made.shuffled().count() == 0


def test_splits_meet_the_quotas_and_are_hypergeometric():
    quotas = np.array([40, 0, 25, 7], np.int64)
    leaves = list(mixing._tree([(0, 9, quotas, np.zeros_like(quotas))], 3, None))
    assert sorted(n[0] for n in leaves) == list(range(9)) and (sum(n[2] for n in leaves) == quotas).all()
    assert {int(n[2].sum()) for n in leaves} == {8}
    for low, _, counts, first in leaves:
        assert (first == sum((n[2] for n in leaves if n[0] < low), np.zeros_like(quotas))).all()
    draws = np.array([mixing.split(0, 2, quotas, seed)[0] for seed in range(4000)])
    assert (draws.sum(1) == 36).all()
    share = quotas / quotas.sum()
    assert np.allclose(draws.mean(0), 36 * share, atol=0.15)
    assert np.allclose(draws.var(0), 36 * share * (1 - share) * (72 - 36) / 71, rtol=0.1, atol=0.01)
    top = list(mixing._tree([(0, 100, quotas * 50, np.zeros_like(quotas))], 3, 8))
    below = [leaf for node in top for leaf in mixing._tree([node], 3, None)]
    whole = list(mixing._tree([(0, 100, quotas * 50, np.zeros_like(quotas))], 3, None))
    assert sorted((n[0], n[2].tolist()) for n in below) == sorted((n[0], n[2].tolist()) for n in whole)
    assert mixing._large(np.random.default_rng(1), 10**12, 10**12, 10**6) in range(495_000, 505_000)


@pytest.mark.parametrize("count", [1, 2, 3, 100, 1000, 4097])
def test_blocks_are_permuted(count):
    out = mixing._permuted(np.arange(count), count, [1, 2])
    assert sorted(out.tolist()) == list(range(count))
    assert count < 100 or (out == mixing._permuted(np.arange(count), count, [1, 3])).sum() < count / 10


# --- 13: centroid clusters --------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, seed=3, dim=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("clash"), "vector": F.lit(1), "id": F.lit(2), "distance": F.lit(0)})


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 0.6, 64).astype(np.float32)]) for i in range(200)]
    rows += [(900, rows[0][1]), (900, rows[0][1]), (None, rows[1][1]), (901, [0.0] * 64), (902, [-0.0] * 64), (903, [1e-9] * 64)]
    bad = [(910, None), (911, []), (912, [1.0] * 63), (913, [1.0] * 65), (914, [float("nan")] + [1.0] * 63), (915, [None] + [1.0] * 63), (916, [float("inf")] * 64)]
    got = centroid_clusters.cluster(vectors(spark, rows + bad).repartition(4))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert shown(got) == lloyd(rows + bad)


def test_equal_distances_go_to_the_smaller_number_and_few_vectors_start_few_centroids(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(30)]
    assert shown(centroid_clusters.cluster(vectors(spark, rows))) == lloyd(rows)
    for few in ([], rows[:1], rows[:3], [(None, rows[0][1])], [(7, rows[0][1])] * 20):
        assert shown(centroid_clusters.cluster(vectors(spark, few))) == lloyd(few)


def test_distances_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="do not fit"):
        centroid_clusters.cluster(vectors(spark, [(1, [1e20] * 64)])).count()
    edge = [(1, [131_072.0] * 64), (2, [-131_072.0] * 64)]
    assert shown(centroid_clusters.cluster(vectors(spark, edge), k=1)) == lloyd(edge, k=1)


@pytest.mark.parametrize("k,spread", [(1, 5), (2, 5), (8, 3), (100, 2), (300, 50)])
def test_the_tree_finds_what_a_full_search_finds(k, spread):
    rng = np.random.default_rng(k)
    centroids, queries = rng.integers(-spread, spread, (k, 3)), rng.integers(-spread, spread, (500, 3))
    number, distance = centroid_clusters.VantageTree(centroids).nearest(queries)
    every = ((queries[:, None, :] - centroids[None]) ** 2).sum(-1)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
