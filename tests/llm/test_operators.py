"""Every operator against brute force or its library on small, awkward inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import collision_search, common, itq_dedup, license_scan, ngram_join, packing, perspectives, repeats, sentencepiece_codec, toxicity, url_filters

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "\n\n", "one", "A b  c\t\td ", "don't 'soft !!'s it's,ok. 3, 4. x", "ΣΑΣ İstanbul é É é", "<|endoftext|> a<|X|>b", "x\xa0y z\x1cq",
    "a²b½3 1/2 _x_y_", "日本語 한국어 ▁▁ ▁x", "😀😀 a😀b", "a" * 3000, "\x00a\x00", "lead ing", " lead", "trail ", "a\nb\n\nc \n d", "K ñ ǅ",
]


def noise(seed, n, alphabet="aB,.'’ \n\tstdlmre<|>é²½9_🙂▁Σ"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def documents(spark, texts, parts=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)


# --- 1: vectors ----------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clustered(seed=3, groups=12, size=9, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            v = centre + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.4])
            rows.append((len(rows), [float(np.float32(x)) for x in v], g % 3))
    return rows


@pytest.mark.parametrize("block_rows", [512, 4])
def test_near_vectors_match_all_pairs(spark, block_rows):
    rows = clustered()
    copies = [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 7)] + [(1100, rows[0][1], 99)]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] * 24, 1), (2004, [None, 1.0], 1), (2005, rows[0][1], None), (2006, [1.0, 2.0], 0)]
    every = rows + copies + bad
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq_dedup.near_duplicates(vectors(spark, every), block_rows=block_rows).collect()}
    want = {i: (*x, x[1] == i) for i, x in brute.near_vectors(every).items()}
    missed = {i for i in want if got[i] != want[i]}
    assert len(got) == len(every) and all(got[i][0] <= want[i][0] for i in want) and len(missed) <= 0.05 * len(want)


def test_near_vectors_of_an_empty_table(spark):
    assert itq_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_repeated_rows_link_with_each_other(spark):
    rows = [(1, [1.0, 0.0], 0)] * 3 + [(None, [1.0, 0.0], 0)]
    out = itq_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out) == [(0, 3, 1)] + [(1, 3, 1)] * 3


# --- 2: sentencepiece ------------------------------------------------------------


def test_ids_and_text_equal_the_library(spark):
    texts = ODD + noise(5, 150)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentencepiece_codec.encode_decode(documents(spark, texts).withColumn("ids", F.lit("clash")), PIECES).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == library.decode(ids) and r.agrees


def test_known_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "KEPT_CHUNKS", 5)
    own = sentencepiece_codec.Codec(PIECES)
    for text in noise(1, 40):
        ids, agrees = own.encode_batch([text], True)
        assert np.frombuffer(ids[0], "<u4").tolist() == own.library.encode(text, add_bos=True, add_eos=True) and agrees == [True]


# --- 3: toxicity -------------------------------------------------------------------


def toxic_corpus(n=600, seed=2):
    rng = random.Random(seed)
    usual = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(usual) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.2)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "vork" + rng.choice(["", "", "ax", "umi", "ol", "iss"]) + rng.choice(["", "er", "st"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_rows_are_judged_well(spark):
    docs, labels = toxic_corpus()
    truth = dict(labels)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_toxicity", F.lit("clash"))
    out = toxicity.score(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r._held_out]
    assert all(r._held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(out) == len(docs)
    assert np.mean([(r._toxicity >= 0.5) == (truth[r.doc_id] == 1) for r in held]) > 0.95
    assert all(0 <= r._toxicity <= 1 for r in out)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = toxic_corpus(200)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    a, b = (toxicity.score(frame, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "_toxicity").collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_all_labelled_rows_but_the_curve_sample_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_ROWS", 10)
    learn, sums = toxicity.learn, []
    monkeypatch.setattr(toxicity, "learn", lambda v: sums.append(v.agg(F.sum("toxic") + F.sum("ordinary")).toPandas().iloc[0, 0]) or learn(v))
    rows = [(i, "word") for i in range(100)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    folds = [zlib.crc32(str(i).encode()) % 5 for i in range(100)]
    assert folds.count(1) > 10 and sums == [100 - folds.count(0) - 10]


def test_discount_does_not_grow_with_the_corpus(spark):
    # words 1 and 2 are rare in classes of 1e9 tokens, 3 has no count; none shares its beginnings with the rest
    rows = [(1, 7000, 0), (2, 0, 7000), (3, 0, 0), *((i, 10**7, 10**7) for i in range(10, 110))]
    frame = spark.createDataFrame([(w, *[1000 * d + w for d in (1, 2, 3)], t, o) for w, t, o in rows], "word long, b0 long, b1 long, b2 long, toxic long, ordinary long")
    ratio = {r.word: r.ratio for r in toxicity.learn(frame).collect()}
    assert set(ratio) == {w for w, _, _ in rows}  # every word stays in the table
    assert ratio[1] > 5 and ratio[2] < -5 and abs(ratio[3]) < 0.1 and abs(ratio[50]) < 0.1


def test_blocks_of_texts_ask_for_their_words(spark, monkeypatch):
    texts = ["b a B", "", "c", "a c a"]
    for most in (1, 1 << 20):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", most)
        posts = toxicity.posted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "text_hash long, text string").coalesce(1)).collect()
        got: dict[int, dict] = {}
        for block in {r.block for r in posts}:
            ids, pairs, times = toxicity.unpacked(*next((r.size, bytes(r.squeezed)) for r in posts if r.block == block and r.squeezed))
            asked = [r.word for r in posts if r.block == block and r.word is not None]
            assert asked == sorted(set(asked))
            for p, t in zip(pairs.tolist(), times.tolist()):
                got.setdefault(int(ids[p // len(asked)]), {})[asked[p % len(asked)]] = t
        assert [sorted(got.get(i, {}).values()) for i in range(4)] == [[1, 2], [], [1], [1, 2]]


def test_waiting_parts_hold_each_word_of_a_text_once(monkeypatch):
    texts = ["b a B", "", "c", "a c a", "a " * 1000]

    def parts():
        for i, t in enumerate(texts):
            data = np.frombuffer(t.encode(), np.uint8)
            yield np.array([i]), *toxicity.words(data, np.array([0, len(data)])), len(data)

    for most, n_blocks in ((1, 4), (1 << 20, 1)):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", most)
        blocks, got = list(toxicity.gathered(parts())), defaultdict(dict)
        for b in blocks:
            assert len(b.text) <= 6 and (np.diff(b.hashes[0].astype(object)) > 0).all()
            for text, word, times in zip(b.text, b.word, b.times):
                got[int(b.tags[text])][int(b.hashes[0][word])] = int(times)
        assert len(blocks) == n_blocks and [sorted(got[i].values()) for i in range(5)] == [[1, 2], [], [1], [1, 2], [1000]]
        assert got[0].keys() & got[3].keys() == got[4].keys()


def test_other_operators_leave_nothing_in_a_worker():
    class Frame:
        select = lambda self, *columns: self
        mapInArrow = lambda self, task, fields: task

    kept = packing.tokenizer(WORDS)
    assert packing.tokenizer(WORDS) is kept  # from task to task
    list(toxicity.counted(Frame())(iter([])))
    assert packing.tokenizer(WORDS) is not kept


def test_whole_numbers_travel_unchanged():
    arrays = [np.array([], np.int64), np.array([0, -1, 2**63 - 1, -(2**63)]), np.arange(1000), np.array([7])]
    assert [a.tolist() for a in toxicity.expanded(toxicity.squeezed(*arrays))] == [a.tolist() for a in arrays]


def test_curve_of_classes_that_lie_apart(spark):
    for n, share in ((40, 0.1), (400, 0.1), (4000, 0.002)):
        for gap in (1, 3, 12):
            rng = np.random.default_rng(1)
            y = (rng.random(n) < share).astype(float)
            x = 0.2 * rng.normal(size=(n, toxicity.FEATURES)) + gap * y[:, None]
            curve = toxicity.Curve.fit(x, y)
            z = np.clip((x - curve.mean) / curve.scale, -toxicity.FAR, toxicity.FAR)
            at = z @ curve.weights[:-1] + curve.weights[-1]
            assert np.abs(curve.weights).max() < 20 and ((at > 0) == (y == 1)).all(), (n, gap)
            # the least of the penalised loss: its slope is zero
            slope = z.T @ (y - 1 / (1 + np.exp(-at))) - curve.weights[:-1]
            assert np.abs(slope).max() < 1e-5
    frame = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], ["y", *(f"f{i}" for i in range(toxicity.FEATURES))])
    scored = frame.select("y", curve.score([F.col(f"f{i}") for i in range(toxicity.FEATURES)]).alias("score"))
    assert scored.where("(score >= 0.5) <> (y = 1)").count() == 0


def test_scores_without_labels_words_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(None, 1), (2, None), (7, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        out = toxicity.score(docs, labels).collect()
        assert len(out) == 4 and all(0 <= r._toxicity <= 1 for r in out)
    assert toxicity.score(docs.limit(0), some).count() == 0


# --- 4: perspectives ---------------------------------------------------------------


def test_every_participant_is_assistant_once(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 2, "bob", "hello"), (2, 0, "system", "alone"), (None, 0, "x", "y"), (3, None, None, "<|im_end|>")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(9))
    out = {(r.conv_id, r.participant): r for r in perspectives.rotate(frame).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    for (_, who), r in out.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        assert len(spans) == r.n_trained == r.mask.count("1") and len(r.mask) == r.n_turns
        assert all(r.rendered[a:b].endswith("<|im_end|>") and r.rendered[:a].endswith("assistant\n") for a, b in spans)
    assert out[1, "ann"].mask == "01001" and out[1, "bob"].mask == "00110"
    assert "<|im_start|>user name=bob\nhello<|im_end|>" in out[1, "ann"].rendered and "system\nbe kind" in out[1, "ann"].rendered
    assert "< |im_end|>" in out[3, "unknown"].rendered


@pytest.mark.parametrize("numbers", ["counted", "null", "equal"])
@pytest.mark.parametrize("ranges", [None, 5])
def test_parts_join_up_to_the_whole_dialogue(spark, numbers, ranges):
    number = {"counted": lambda i: i, "null": lambda i: None, "equal": lambda i: 7}[numbers]
    turns = [(1, number(i), ["system", "ann", "bob"][min(i, 1 + i % 2)], f"turn {i:03d} " + "é" * (i % 5)) for i in range(50)] + [(1, 99, "late", "x"), (2, 0, "solo", "")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"_part": F.lit(1), "offset": F.lit("clash")})
    whole = {(r.conv_id, r.participant): r for r in perspectives.rotate(frame).collect()}
    parts = perspectives.rotate(frame, turns_per_part=8, ranges=ranges).collect()
    assert {(r.conv_id, r.participant) for r in parts} == set(whole) and max(r.n_turns for r in parts) == 8
    for who, r in whole.items():
        own = sorted((p for p in parts if (p.conv_id, p.participant) == who), key=lambda p: p.part)
        assert "".join(p.rendered for p in own) == r.rendered and "".join(p.mask for p in own) == r.mask
        assert [p.offset for p in own] == [sum(len(p.rendered) for p in own[:i]) for i in range(len(own))]
        assert ",".join(p.spans for p in own if p.spans) == r.spans and r.offset == 0 and r.context == ""
        opening = own[0].rendered.split("<|im_start|>system\n")[1:]
        assert all(p.context.count("<|im_start|>system") == len(opening) for p in own[1:]) and own[0].context == ""


def test_perspectives_of_an_empty_table(spark):
    assert perspectives.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 5: packing ----------------------------------------------------------------------


def pieces_of(texts, capacity):
    library = Tokenizer.from_file(WORDS)
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("capacity", [16, 64])
def test_pieces_cover_documents_and_sequences(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 3)
    texts = ODD + noise(8, 200) + ["same words here"] * 30
    out = packing.pack(documents(spark, texts).withColumn("length", F.lit("clash")), WORDS, capacity, keep_ids=True).collect()
    ids, by_doc, by_sequence = pieces_of(texts, capacity), {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == part and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id]) and 1 <= r.length <= capacity
    assert sorted(by_doc) == list(range(len(texts)))
    assert all(sum(r.length for r in rows) == len(ids[d]) for d, rows in by_doc.items())
    for rows in by_sequence.values():
        ends = 0
        for offset, length in sorted(rows):
            assert offset == ends
            ends += length
        assert ends <= capacity
    total = sum(map(len, ids))
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) * capacity < total * 1.25 + capacity


def test_shortest_pack_first_keeps_every_length():
    rng = random.Random(4)
    for _ in range(30):
        histogram = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(20)}
        patterns = packing.shortest_pack_first(histogram, 50)
        used: dict[int, int] = {}
        for count, pattern in patterns:
            assert sum(length * often for length, often in pattern) <= 50
            for length, often in pattern:
                used[length] = used.get(length, 0) + count * often
        assert used == histogram


def test_packing_nothing(spark):
    assert packing.pack(documents(spark, ["x"]).limit(0), WORDS).count() == 0


# --- 6: nearest neighbours -------------------------------------------------------------


def test_recall_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SHARD_ROWS", 300)
    monkeypatch.setattr(collision_search, "QUERY_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(32) * rng.uniform(0.5, 2)], 0) for i in range(1000)]
    rows += [(5000, None, 0), (5020, [0.0] * 32, 0), (5040, [float("inf")] * 32, 0), (5060, [1.0, 2.0], 0), (1001, rows[3][1], 0)]
    frame = vectors(spark, rows)
    exact = {i: [float(np.float32(x)) if x is not None else None for x in v] if v else v for i, v, _ in rows}
    out = collision_search.nearest(frame, frame.where("vec_id % 20 = 0"), 10).collect()
    want = brute.nearest(exact.items(), [(i, v) for i, v in exact.items() if i % 20 == 0], 10)
    got: dict[int, list] = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.score == pytest.approx(float(np.dot(exact[r.query_id], exact[r.vec_id])), abs=1e-9) and r.vec_id != r.query_id
    assert 5060 not in got and all([s for _, s in g] == sorted((s for _, s in g), reverse=True) for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items() if w)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("spread", ["one row twice as long", "one row ten times as long", "log-normal"])
def test_recall_whatever_the_norms(spread):
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((4000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    if spread == "log-normal":
        rows *= np.exp(0.5 * rng.standard_normal(len(rows)))[:, None]
    else:
        rows[77] *= 2 if "twice" in spread else 10
    ids = np.arange(len(rows))
    group = pa.table({"asked": [False] * len(rows) + [True] * 40, "id": [*ids.tolist(), *ids[::100].tolist()], "vector": [*rows.tolist(), *rows[::100].tolist()]})
    out = collision_search.visit(20)(group).to_pandas()
    recall = []
    for q in ids[::100]:
        score = np.where(ids == q, -np.inf, rows @ rows[q])
        recall.append(len(set(out["vec_id"][out["query_id"] == q]) & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) > 0.98 and min(recall) >= 0.9


def test_fewer_rows_than_asked(spark):
    frame = vectors(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)])
    out = collision_search.nearest(frame, frame.where("vec_id = 0"), 20).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 1.0)]
    assert collision_search.nearest(frame.limit(0), frame.limit(0)).count() == 0


# --- 7: URLs -----------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [url_filters.host_rule(*r) for r in (("net", "/", "block"), ("example.net", "/en/", "allow"))] + [url_filters.word_rule("cheap-pills")]
    urls = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.NET/x", "a.net", "/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"),
        ("http://m.Example.net/en/a?b", "m.example.net", "/en/a", "example.net/en/", "allow"), ("http://myexample.net/en/", "myexample.net", "/en/", "net/", "block"),
        ("x://h#p/q", "h", "", None, "allow"), ("http://cheap-pills.org/", "cheap-pills.org", "/", None, "block"), ("http://o.org/?q=CHEAP_pills", "o.org", "/", None, "block"),
        ("http://notcheap-pills.org/", "notcheap-pills.org", "/", None, "allow"), ("://net/", "net", "/", "net/", "block"), ("http://a b.net/", "a b.net", "/", "net/", "block"), ("", "", "", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filters.judge(frame, rules).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))] == [u[1:] for u in urls]
    assert out[2].tested < len(rules) and url_filters.judge(frame.limit(0), rules).count() == 0


# --- 8: n-gram join ------------------------------------------------------------------------


def near_texts(seed=1, groups=14, size=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.5 else "\t\n").join(words))
    return texts


@pytest.mark.parametrize(("n", "percent", "block_sets"), [(4, 85, 1024), (4, 85, 3), (2, 60, 2)])
def test_components_match_all_pairs(spark, n, percent, block_sets):
    texts = near_texts() + ["", None, "one", "ONE", "one two", "a b c", "  a\tB c "] + ["x " * 500, "x " * 480]
    frame = documents(spark, texts).withColumn("size", F.lit("clash"))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_sets(frame, n, percent, block_sets=block_sets).collect()}
    assert out == brute.similar_sets(dict(enumerate(texts)), n, percent)


def test_join_of_null_and_repeated_keys(spark):
    frame = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "z"), (7, None)], "doc_id long, text string")
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_sets(frame).collect()]
    assert sorted(out, key=str) == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (None, 1, None), (7, 0, 7)], key=str)
    assert ngram_join.similar_sets(frame.limit(0)).count() == 0


# --- 9: licenses -----------------------------------------------------------------------------


def test_phrases_and_templates(spark):
    texts = [
        None, "", "MIT  License, mit-license. The Apache/License", "general public license general public", "x y z " + license_scan.TEMPLATES[9][1] + " tail",
        "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software and associated files (the Software), to deal in the Software",
        "permission is hereby refused", "licensed under cc by nc 4.0", "mit\u00e9 license", "mit license " * 50,
    ]
    scan = license_scan.scan(documents(spark, texts).withColumn("labels", F.lit("clash")))
    out = {r.doc_id: r for r in scan.documents.collect()}
    for i, text in enumerate(texts):
        assert (out[i].n_words, out[i].n_base, out[i].first_word, out[i].last_word, out[i].base_labels) == brute.licenses(text)
        assert 0 <= out[i].score <= 1 and set(out[i].base_labels.split(",")) - {""} <= set(out[i].labels.split(","))
    assert out[4].labels == out[5].labels == "mit" and out[6].labels == "" and out[7].labels == "cc-by-nc"
    spans = {r.doc_id: r for r in scan.spans.where("label = 'mit' and coverage < 1").collect()}
    assert spans[5].first_word == 0 and len(out) == len(texts)
    assert license_scan.scan(documents(spark, ["x"]).limit(0)).documents.count() == 0


# --- 10: repeats -----------------------------------------------------------------------------


def passages(seed=5, alphabet="abcdefgh é"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared, texts = [word(90) for _ in range(3)], []
    for _ in range(40):
        text = word(rng.randint(0, 80))
        if rng.random() < 0.6:
            begin = rng.randint(0, 30)
            text += rng.choice(shared)[begin : begin + rng.randint(15, 90)] + word(rng.randint(0, 60))
        texts.append(text)
    return texts + [texts[3], texts[3], None, "", "z" * 200, "zy" * 90, shared[0] + "!" + shared[0]]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_kept_bytes_match_all_windows(spark, crowd):
    texts = passages()
    frame = documents(spark, texts).withColumn("_kept", F.lit("clash"))
    out = {r.doc_id: r for r in repeats.remove_repeats(frame, 30, gram=8, crowd=crowd).collect()}
    for i, want in enumerate(brute.repeats(texts, 30)):
        r = out[i]
        removed = sum(s.end - s.begin for s in r._spans)
        assert (r._bytes, removed, len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) == want


def test_repeats_of_repeated_rows_and_none(spark):
    text = "the quick brown fox jumps over the lazy dog"
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text[:29])], "doc_id long, text string")
    out = repeats.remove_repeats(frame, 30, gram=8).collect()
    assert sorted(len(r._kept) for r in out) == [0, 0, 0, 29]
    assert repeats.remove_repeats(frame.limit(0), 30, gram=8).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_passages_beside_longer_strings(spark, crowd):
    texts = passages(8)
    sought = repeats.Passages(12, 5, 2)
    frame = documents(spark, texts).withColumn("_rest", F.lit("clash"))
    out = {r.doc_id: r for r in repeats.remove_repeats(frame, 30, gram=8, crowd=crowd, passages=sought).collect()}
    both = list(zip(brute.repeats(texts, 30), brute.repeats(texts, 12, 2)))
    assert any(short[1] and not long[1] for long, short in both) and any(long[1] for long, _ in both)
    for i, want in enumerate(both):
        r = out[i]
        assert tuple((r._bytes, sum(s.end - s.begin for s in runs), len(runs), hashlib.sha256(bytes(left)).hexdigest()) for runs, left in ((r._spans, r._kept), (r._passages, r._rest))) == want
    assert repeats.remove_repeats(frame.limit(0), 30, gram=8, passages=sought).count() == 0


def test_text_that_is_left_loses_split_characters_alone(spark):
    kept = ["a\ufffdb".encode(), b"\xa9a" + "é€".encode() + b"\xe2\x82", b"", "é".encode()]
    frame = spark.createDataFrame([(i, k) for i, k in enumerate(kept)], "i long, _kept binary")
    assert [r.text for r in frame.select("i", repeats.kept_text().alias("text")).orderBy("i").collect()] == ["a\ufffdb", "aé€", "", "é"]


# --- shared ------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(i, i + 1000) for i in range(100, 110)] + [(7, 7)]
    rng.shuffle(edges)
    classes = brute.Classes({x for e in edges for x in e})
    for a, b in edges:
        classes.join(a, b)
    out = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out.get(x, x) == classes.find(x) for x in classes.parent)
