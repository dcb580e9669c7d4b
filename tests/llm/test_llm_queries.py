"""The registered queries on the smallest tables: SQL, brute force, and the pipeline."""

from __future__ import annotations

import ast
import hashlib
import math
import pathlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from compare import connect, differences
from tokenizers import Tokenizer

import corpus_pipeline
from tickloom.llm import common, packing, toxicity
from tickloom.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    found = differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name])
    assert found is None, found


def test_near_vectors(spark):
    out = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op1_itq_near_duplicates"](spark, SF_DIR).collect()}
    assert out == brute.near_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in rows("embeddings")])


def test_similar_sets(spark):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_join"](spark, SF_DIR).collect()}
    assert out == brute.similar_sets({r["doc_id"]: r["text"] for r in rows("documents")})


def test_repeats(spark):
    docs = rows("documents")
    want = dict(zip((r["doc_id"] for r in docs), brute.repeats([r["text"] for r in docs], 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op10_repeats"](spark, SF_DIR).collect()} == want


def test_repeats_query_gives_the_text_that_is_left(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}
    out = QUERIES["op10_repeats"](spark, SF_DIR).collect()
    assert any(r.is_changed for r in out)
    for r in out:
        # At each end of a run three bytes of a split character may go with it.
        if r.is_changed:
            assert r.n_kept - 6 * r.n_spans <= len(r.text.encode()) <= r.n_kept
        else:
            assert r.text.encode() == docs[r.doc_id]


def test_repeats_query_tells_planted_passages(spark, tmp_path):
    words = sorted({w for r in rows("documents") for w in (r["text"] or "").split() if w.isascii() and 4 <= len(w) <= 6})
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    planted, texts = {}, {}
    for i in range(40):
        texts[i] = some(rng.randint(20, 120))  # nothing repeats
    for i in range(40, 80, 2):
        passage = some(rng.randint(51, 54))  # under 400 bytes, which the contract's columns leave
        for j in (i, i + 1):
            texts[j], planted[j] = f"{some(30)} <{j}> {passage} <{j}> {some(30)}", passage
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op10_repeats"](spark, str(tmp_path)).collect():
        assert r.text == texts[r.doc_id] and r.n_removed == 0
        if r.doc_id in planted:
            assert r.n_passages == 1 and planted[r.doc_id] not in r.text_without_passages and r.n_passage_bytes >= len(planted[r.doc_id])
        else:
            assert r.n_passages == r.n_passage_bytes == 0 and r.text_without_passages == texts[r.doc_id]


def test_repeats_query_gives_passages_beside_the_contract(spark):
    docs = rows("documents")
    want = dict(zip((r["doc_id"] for r in docs), brute.repeats([r["text"] for r in docs], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)))
    out = QUERIES["op10_repeats"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_bytes, r.n_passage_bytes, r.n_passages) for r in out} == {i: w[:3] for i, w in want.items()}


def test_sentencepiece_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r.doc_id: r for r in QUERIES["op2_sentencepiece"](spark, SF_DIR).collect()}
    for doc in rows("documents"):
        ids, r = library.encode(doc["text"] or "", add_bos=True, add_eos=True), out.pop(doc["doc_id"])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.agrees
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not out


def test_toxicity_query_holds_a_fifth_out(spark):
    out = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, SF_DIR).collect()}
    docs = rows("documents")
    assert set(out) == {d["doc_id"] for d in docs} and len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())


def test_packing_query_holds_the_ids_of_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_packing"](spark, SF_DIR).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for doc in rows("documents"):
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces.pop(doc["doc_id"]), key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert not pieces
    for held in places.values():
        ends = np.cumsum([0, *(length for _, length in sorted(held))])
        assert [offset for offset, _ in sorted(held)] == ends[:-1].tolist() and ends[-1] <= 4096


def test_search_query_finds_the_nearest(spark):
    base = [(r["vec_id"], r["embedding"]) for r in rows("embeddings")]
    want = brute.nearest(base, [x for x in base if x[0] % 20 == 0], 20)
    got = defaultdict(list)
    for r in QUERIES["op6_collision_search"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))


def test_toxicity_model_is_kneser_ney(spark):
    """The table of ratios against counts of plain strings."""
    rng = random.Random(11)
    words = sorted({w + e for w in ("stupid", "stupi", "abc", "clown", "clowns", "rain", "rainbow", "über", "x") for e in ("", "s", "ly", "like")})
    texts = [(" ".join(rng.choices(words, k=30)), int(i % 3 == 0)) for i in range(40)]
    count = [Counter(w for t, c in texts if c == side for w in t.split()) for side in (1, 0)]
    cut = [lambda w: w, *[lambda w, k=k: w.encode()[:k] for k in toxicity.BEGINNINGS]]
    below, want = None, {}
    for depth in reversed(range(4)):
        if depth:
            own = [Counter(cut[depth](w) for w in c) for c in count]  # distinct words
        else:
            own = count
        discount = toxicity.DISCOUNT / 2 if depth else toxicity.DISCOUNT
        names = {n: [c[n] for c in own] for n in set(own[0]) | set(own[1])}
        total = [max(sum(c.values()), 1) for c in own]
        kept = {n: [max(x - discount, 0) for x in c] for n, c in names.items()}
        rest = [1 - sum(k[i] for k in kept.values()) / total[i] for i in (0, 1)]
        shift = math.log(max(rest[0], 1e-9) / max(rest[1], 1e-9))
        parent = {n: (n.encode() if isinstance(n, str) else n)[: toxicity.BEGINNINGS[depth]] for n in names} if depth < 3 else {}
        mass = Counter()
        for n in parent:
            mass[parent[n]] += sum(names[n])
        made = {}
        for n, c in names.items():
            if below is None:
                p, shorter = [sum(c) / max(sum(map(sum, names.values())), 1)] * 2, 0.0
            else:
                p, shorter = [below[parent[n]][0][i] * sum(c) / mass[parent[n]] for i in (0, 1)], below[parent[n]][1]
            chance = [kept[n][i] / total[i] + rest[i] * p[i] for i in (0, 1)]
            ratio = math.log(chance[0] / chance[1]) if any(kept[n]) else shorter + shift
            made[n] = chance, ratio
            if any(kept[n]):
                want[depth, n if isinstance(n, bytes) else n.encode()] = ratio
        below = made
    table = []
    for w in words:
        _, hashes = toxicity.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        table.append((*(int(h[0].view(np.int64)) for h in hashes), *(c[w] for c in count)))
    schema = ", ".join(f"{n} long" for n in [*toxicity.NAMES, "toxic", "ordinary"])
    model, shifts = toxicity.learn(spark.createDataFrame(table, schema))
    got = {r.expression: r.ratio for r in model.collect()}
    assert len(got) == len(want)
    for (depth, name), ratio in want.items():
        _, hashes = toxicity.words(np.frombuffer(name, np.uint8), np.array([0, len(name)]))
        h = int(hashes[depth][0].view(np.int64)) ^ toxicity.SALTS[depth]
        assert math.isclose(got[h], ratio, rel_tol=1e-9, abs_tol=1e-12), (depth, name)


def test_pipeline_stages_against_brute_force(spark):
    docs = common.table(spark, SF_DIR, "documents")
    kept = common.stored(corpus_pipeline.drop_toxic(spark, docs, SF_DIR), "t")
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() <= docs.count()
    before = {r.doc_id: r.text for r in kept.collect()}
    unique = common.stored(corpus_pipeline.drop_near_duplicates(spark, kept, SF_DIR), "n")
    classes = brute.similar_sets(before, 5, 80)
    assert {r.doc_id for r in unique.collect()} == {i for i, (n, c) in classes.items() if i == c} and unique.columns == docs.columns
    texts = {r.doc_id: r.text for r in unique.collect()}
    cleaned = common.stored(corpus_pipeline.drop_repeats(spark, unique, SF_DIR), "r")
    want = dict(zip(texts, brute.repeats(list(texts.values()), corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)))
    left = {r.doc_id: r for r in cleaned.collect()}
    assert set(left) == {i for i, w in want.items() if w[0] > w[1] or not w[1]} and cleaned.columns == docs.columns
    assert all((left[i].text == texts[i]) == (want[i][1] == 0) and left[i].n_chars == len(left[i].text) for i in left if want[i][1])
    packed = corpus_pipeline.pack(spark, cleaned, SF_DIR).collect()
    own = packing.tokenizer(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in packed} == set(left)
    for r in packed[:50]:
        ids = own.encode_batch([left[r.doc_id].text])[0] + (2).to_bytes(4, "little")
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_pipeline_stages_on_empty_and_null_rows(spark):
    docs = common.table(spark, SF_DIR, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, None, 5)], docs.schema)
    for frame in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF_DIR).count() >= 0


def test_near_duplicates_under_one_id_or_none_leave_one_row(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    schema = common.table(spark, SF_DIR, "documents").schema
    docs = [(1, text, "en", "s", 1), (1, near, "en", "s", 1), (None, near, "en", "s", 1), (None, text + " z", "en", "s", 1), (7, "unlike " * 9, "en", "s", 1), (None, "", "en", "s", 0)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, schema), SF_DIR).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in left) == [(0, ""), (1, "w0 w1 "), (7, "unlike")]
    nulls = [d for d in docs if d[0] is None and d[1]]
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(nulls, schema), SF_DIR).count() == 1


def test_stages_take_very_long_texts(spark):
    schema = common.table(spark, SF_DIR, "documents").schema
    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long[:100_000] + " end", "en", "s", 1), (3, "x" * 2_000_000, "en", "s", 1), (4, "short", None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, SF_DIR), name)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2, 3, 4}
        docs = docs if name == "packing" else out
    assert {r.doc_id for r in docs.select("doc_id").collect()} >= {3, 4}


def test_native_operators_run_no_python(spark):
    for name in ("op4_perspectives", "op9_license_scan"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


def test_no_local_checkpoints_or_cross_joins():
    root = pathlib.Path(__file__).resolve().parents[2]
    for file in [*(root / "tickloom" / "llm").glob("*.py"), root / "corpus_pipeline.py"]:
        for node in ast.walk(ast.parse(file.read_text())):
            assert not (isinstance(node, ast.Attribute) and node.attr in {"localCheckpoint", "crossJoin", "collect", "toLocalIterator", "rdd"}), file.name
