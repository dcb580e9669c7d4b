"""Toxicity scores from class-conditional Kneser-Ney models.

Toxic and ordinary texts each have a model of expressions: words, then word beginnings of falling
length. A model keeps an expression's count less a constant discount; the discounted mass goes to
the next shorter beginning, by counts that both classes share, so a word that was never or
rarely seen is judged by how it begins. Shorter levels count distinct words, not
tokens. All kept expressions stay in a stored table that grows with the corpus, dealt by hash into buckets. Texts go in blocks; a
block asks each bucket once for the expressions it holds there, and the answers add up to the difference of both
log-likelihoods. Its length-normalised features are set against each other by a logistic curve fitted on labelled
rows that no model counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, forget, prepare, stored
from tickloom.llm.rolling import Prefix, pieces
from tickloom.llm.shipping import shipped, unsqueezed

BEGINNINGS = (6, 5, 4)  # bytes of the word beginnings behind whole words
NAMES = ("word", *(f"b{i}" for i in range(len(BEGINNINGS))))
DISCOUNT = 2.0  # of a token count, whatever the corpus; half as much of a count of words
BLOCK_BYTES = 12 << 20  # texts whose words are looked up together
BUCKET_EXPRESSIONS = 1 << 19  # of the model that a task holds at once, about
FILTER_BITS = 1 << 24  # of the filter that tells which expressions need not be asked for; a full one only saves less
SALTS = tuple(int(x) for x in np.random.default_rng(5).integers(-(2**62), 2**62, len(NAMES)))  # a word differs from itself as a beginning
STRONG = (1.5, 3.0, 4.5)  # log-ratios from which on a word speaks for toxicity, more or less strongly
FEATURES = 2 + 2 * len(STRONG)
FAR = 8.0  # deviations of a feature from its mean, beyond which it counts no more, to the fit as to a score
FIT_ROWS = 20_000  # labelled rows for the logistic curve, those with the smallest hashes


def words(data: np.ndarray, at: np.ndarray, beginnings: tuple[int, ...] = BEGINNINGS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Text of each word, then its hash and those of its beginnings.

    Words are runs of ASCII letters and digits and of all bytes beyond ASCII, A-Z in lower case.
    """
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = np.append(((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128), False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] |= inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = Prefix(data)
    return np.searchsorted(at, start, "right") - 1, [prefix.of(start, stop), *(prefix.of(start, np.minimum(start + k, stop)) for k in beginnings)]


@dataclass
class Tally:
    """Which texts have which words, and how often."""

    tags: np.ndarray  # of each text
    hashes: list[np.ndarray]  # of each distinct word, ascending, and of its beginnings
    text: np.ndarray  # of each pair
    word: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, tags: np.ndarray, place: np.ndarray, hashes: list[np.ndarray]) -> Tally:
        """From the text and the hashes of every word."""
        _, first, back = np.unique(hashes[0], return_index=True, return_inverse=True)
        pairs, times = np.unique(place * max(len(first), 1) + back, return_counts=True)
        text, word = np.divmod(pairs, max(len(first), 1))
        return cls(tags, [h[first] for h in hashes], *(x.astype(np.int32) for x in (text, word, times)))

    @classmethod
    def joined(cls, parts: list[Tally]) -> Tally:
        """One of several, whose texts follow each other."""
        _, first, back = np.unique(np.concatenate([p.hashes[0] for p in parts]), return_index=True, return_inverse=True)
        texts, words = (np.cumsum([0, *sizes]).tolist() for sizes in ([len(p.tags) for p in parts], [len(p.hashes[0]) for p in parts]))
        back = back.astype(np.int32)
        return cls(
            np.concatenate([p.tags for p in parts]),
            [np.concatenate(level)[first] for level in zip(*(p.hashes for p in parts))],
            np.concatenate([p.text + np.int32(n) for p, n in zip(parts, texts)]),
            np.concatenate([back[n : n + len(p.hashes[0])][p.word] for p, n in zip(parts, words)]),
            np.concatenate([p.times for p in parts]),
        )


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]]) -> Iterator[Tally]:
    """Parts ``(tag of each text, text of each word, hashes, bytes)`` put together until a block holds enough bytes of words.

    A part is tallied at once, so that what waits for the rest of its block holds each of its words once.
    """
    held: list[Tally] = []
    size = 0
    for tags, place, hashes, n_bytes in parts:
        held.append(Tally.of(tags, place, hashes))
        del place, hashes
        size += n_bytes
        if size >= BLOCK_BYTES:
            held, block, size = [], Tally.joined(held), 0
            yield block
            del block
    if held:
        yield Tally.joined(held)


def counted(labelled: DataFrame) -> DataFrame:
    """``word, b0.., toxic, ordinary``: tokens of words of shipped texts with ``toxic`` in each class, in parts to be added up."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for row, data, at in pieces(unsqueezed(batch)):
                yield toxic[row : row + len(at) - 1], *words(data, at), len(data)

    def one(block: Tally) -> pa.RecordBatch:
        bad = block.tags[block.text] == 1
        sums = [np.bincount(block.word[side], block.times[side], len(block.hashes[0])).astype(np.int64) for side in (bad, ~bad)]
        return pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in block.hashes), *map(pa.array, sums)], [*NAMES, "toxic", "ordinary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        # Nothing of a block stays while the next one is gathered.
        yield from map(one, gathered(read(batches)))

    fields = ", ".join(f"{n} long" for n in [*NAMES, "toxic", "ordinary"])
    return labelled.select("bytes", "squeezed", "toxic").mapInArrow(run, fields)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, each array compressed by itself and by planes of bytes, so that like bytes lie together."""
    out = []
    for a in arrays:
        planes = pa.compress(a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)
        out += [len(a).to_bytes(8, "little"), len(planes).to_bytes(8, "little"), planes]
    return b"".join(out)


def expanded(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = (int.from_bytes(data[i : i + 8], "little") for i in (at, at + 8))
        planes = pa.decompress(data[at + 16 : at + 16 + size], 8 * n, "zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").ravel())
        at += 16 + size
    return out


def expression_filter(model: DataFrame) -> np.ndarray:
    """Bits that tell of every expression of ``model(expression)`` that it is there, and of few others: ``FILTER_BITS`` of them."""
    places = F.array(*(F.shiftrightunsigned("expression", i).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in _SHIFTS))
    bits = model.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    got = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


_SHIFTS = (0, 19, 38)  # the filter's places are bits of the expression itself, which is a hash


def may_hold(bits: np.ndarray, expressions: np.ndarray) -> np.ndarray:
    held = np.ones(len(expressions), bool)
    for i in _SHIFTS:
        at = (expressions >> np.uint64(i)) & np.uint64(FILTER_BITS - 1)
        held &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return held


def bucket_of(expressions: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the expressions as unsigned numbers."""
    return ((expressions >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def posted(texts: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, data``: what each block of ``texts(text_hash, text)`` asks each bucket for, and, with a null bucket, what waits for the answers.

    Words whose expressions the model cannot hold are one with all words of their beginning. What waits is hashes of the texts,
    ascending ``text * chains + chain``, how often, and for each level the place of a chain's expression among those asked for, or -1.
    """
    bits = texts.sparkSession.sparkContext.broadcast(expression_filter(model))
    salts = [np.int64(x).view(np.uint64) for x in SALTS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column("text_hash").to_numpy()
            for row, data, at in pieces(batch.column("text")):
                yield ids[row : row + len(at) - 1], *words(data, at), len(data)

    def one(block: Tally, number: int) -> pa.RecordBatch:
        levels = [h ^ salt for h, salt in zip(block.hashes, salts)]
        held = [may_hold(bits.value, e) for e in levels]
        chain, some, of_word = np.unique(np.where(held[0], levels[0], levels[1]), return_index=True, return_inverse=True)
        levels, held = [e[some] for e in levels], [h[some] for h in held]
        asked = np.unique(np.concatenate([e[h] for e, h in zip(levels, held)]))
        at = [np.where(h, np.searchsorted(asked, e), -1) for e, h in zip(levels, held)]
        pairs = block.text * np.int64(max(len(chain), 1)) + of_word[block.word]
        order = np.argsort(pairs)
        pairs, times = pairs[order], block.times[order]
        del order
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, times = pairs[new], np.add.reduceat(times, new, dtype=np.int64) if len(new) else times
        bucket = bucket_of(asked, buckets)
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        data = [squeezed(np.diff(asked[a:b], prepend=np.uint64(0)).view(np.int64)) for a, b in zip(edges, edges[1:])]
        data.append(squeezed(block.tags, np.diff(pairs, prepend=0), times, *at))
        where = [*bucket[edges[:-1]].tolist(), None]
        return pa.RecordBatch.from_arrays([pa.array([number] * len(data), pa.int64()), pa.array(where, pa.int64()), pa.array(data, pa.binary())], ["block", "bucket", "data"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        first = TaskContext.get().partitionId() << 32
        yield from map(one, gathered(read(batches)), count(first))

    return texts.mapInArrow(post, "block long, bucket long, data binary")


def answered(posts: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, data``: the ratios of what was asked for, in its order; those the model does not hold are not numbers.

    A task holds one bucket of the model at a time, and the questions stream past it.
    """
    unsigned = F.shiftrightunsigned("expression", 32) * F.lit(buckets)
    held = model.select(F.shiftrightunsigned(unsigned, 32).alias("bucket"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), "expression", "ratio")
    asked = posts.where("bucket IS NOT NULL").select("bucket", "block", "data", F.lit(None).cast("long").alias("expression"), F.lit(None).cast("double").alias("ratio"))
    # The model's rows come first in a bucket: they have no block.
    rows = held.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block", "expression")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        known, ratios = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for batch in batches:
            own, is_model = batch.column("bucket").to_numpy(), batch.column("block").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(own, prepend=own[:1] - 1) != 0) | np.diff(is_model, prepend=~is_model[:1])) if len(own) else own
            out: list[tuple] = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(own)]):
                if own[a] != bucket:
                    bucket, parts, known, ratios = own[a], [], known[:0], ratios[:0]
                if is_model[a]:
                    part = batch.slice(a, b - a)
                    parts.append((part.column("expression").to_numpy().view(np.uint64), part.column("ratio").to_numpy().astype(np.float32)))
                    continue
                if parts:
                    known, ratios = np.concatenate([known, *(e for e, _ in parts)]), np.concatenate([ratios, *(r for _, r in parts)])
                    order, parts = np.argsort(known), []
                    known, ratios = known[order], ratios[order]
                for block, data in zip(batch.column("block")[a:b].to_pylist(), batch.column("data")[a:b].to_pylist()):
                    wanted = np.cumsum(expanded(data)[0].view(np.uint64))
                    got = np.full(len(wanted), np.nan, "<f4")
                    if len(known):
                        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                        got = np.where(known[at] == wanted, ratios[at], np.float32("nan")).astype("<f4")
                    out.append((block, int(bucket), pa.compress(got.tobytes(), "zstd", asbytes=True), 4 * len(got)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "bucket", "data", "size"])

    return rows.mapInArrow(answer, "block long, bucket long, data binary, size long")


def learn(vocabulary: DataFrame) -> tuple[DataFrame, list[float]]:
    """``expression, ratio``: log-ratio of both classes for every expression of ``vocabulary(word, b0.., toxic, ordinary)`` that a class keeps.

    An expression that no class keeps has the ratio of its beginning, shifted by what both classes give to beginnings: by level, the
    second result.
    """
    below: DataFrame | None = None
    levels, tables, shifts = [], [], [0.0] * len(NAMES)
    for depth in reversed(range(len(NAMES))):
        name = NAMES[depth]
        if depth:  # distinct words of each class behind a beginning
            own = vocabulary.groupBy(*NAMES[depth:]).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary")))
        else:
            own = vocabulary
        discount = F.lit(DISCOUNT / 2 if depth else DISCOUNT)
        kept = {c: F.greatest(F.col(c) - discount, F.lit(0.0)) for c in ("toxic", "ordinary")}
        facts = own.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in kept), *(F.coalesce(F.sum(kept[c]), F.lit(0.0)).alias(c) for c in kept)).toPandas()
        total = {c: float(facts[f"n_{c}"][0]) for c in kept}
        rest = {c: 1 - float(facts[c][0]) / max(total[c], 1.0) for c in total}  # mass for shorter beginnings
        if below is None:
            shared = (F.col("toxic") + F.col("ordinary")) / max(sum(total.values()), 1.0)
            joined = own.withColumns({**{f"p_{c}": shared for c in total}, "shorter": F.lit(0.0)})
        else:
            parent = NAMES[depth + 1]
            mass = own.groupBy(parent).agg(F.sum(F.col("toxic") + F.col("ordinary")).alias("mass"))
            joined = own.join(mass, parent).join(below, parent)
            share = F.coalesce(F.try_divide(F.col("toxic") + F.col("ordinary"), F.col("mass")), F.lit(0.0))
            joined = joined.withColumns({f"p_{c}": F.col(f"p_{c}") * share for c in total})
        chances = {f"p_{c}": kept[c] / max(total[c], 1.0) + rest[c] * F.col(f"p_{c}") for c in total}
        backoff = shifts[depth] = float(np.log(max(rest["toxic"], 1e-9) / max(rest["ordinary"], 1e-9)))
        counted_ratio = F.log(F.greatest("p_toxic", F.lit(1e-300)) / F.greatest("p_ordinary", F.lit(1e-300)))
        is_kept = (kept["toxic"] > 0) | (kept["ordinary"] > 0)
        ratio = F.when(is_kept, counted_ratio).otherwise(F.col("shorter") + backoff)
        made = joined.withColumns(chances).select(name, "p_toxic", "p_ordinary", ratio.alias("ratio"), is_kept.alias("kept"))
        own = stored(made if depth else made.where("kept").select(name, "ratio", "kept"), "expressions")
        levels.append(own)
        tables.append(own.where("kept").select(F.col(name).bitwiseXOR(F.lit(SALTS[depth])).alias("expression"), "ratio"))
        below = own.drop("kept").withColumnRenamed("ratio", "shorter")
    model = stored(reduce(DataFrame.unionByName, tables), "model")
    discard(*levels)
    return model, shifts


def features(place: np.ndarray, times: np.ndarray, ratio: np.ndarray, n: int) -> np.ndarray:
    """Length-normalised log-ratio of each text over all words and over the strong ones, the sums of those, and the length."""
    counts = np.maximum(np.bincount(place, times, n), 1)
    out = [np.bincount(place, times * ratio, n) / counts, np.log(counts)]
    for least in STRONG:
        strong = np.bincount(place, np.where(ratio > least, times * ratio, 0), n)
        out += [np.log(strong / counts + 1e-3), np.log1p(strong)]
    return np.stack(out, 1)


def weighed(posts: DataFrame, answers: DataFrame, shifts: list[float]) -> DataFrame:
    """``text_hash, f0..``: the features of every distinct text."""
    names = [f"f{i}" for i in range(FEATURES)]
    beyond = np.cumsum([0.0, *shifts])  # what a word is shifted by that is first known at each level, or nowhere

    def weigh(waits: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        parts = [np.frombuffer(pa.decompress(d, n, "zstd", asbytes=True), "<f4") for d, n in zip(found["data"].to_pylist(), found["size"].to_pylist())]
        known = np.concatenate([*parts, np.array([np.nan], "<f4")]).astype(float)  # the last one stands for -1
        ids, steps, times, *at = expanded(waits["data"][0].as_py())
        ratio = np.full(len(at[0]), beyond[-1])
        for depth in reversed(range(len(at))):
            got = known[at[depth]]
            ratio = np.where(np.isnan(got), ratio, got + beyond[depth])
        place, chain = np.divmod(np.cumsum(steps), max(len(ratio), 1))
        x = features(place, times, ratio[chain], len(ids))  # a text's words add up in order of their hashes, in whatever block it stands
        hashes, first = np.unique(ids, return_index=True)
        return pa.table([pa.array(hashes), *(pa.array(c) for c in x[first].T)], ["text_hash", *names])

    waiting = posts.where("bucket IS NULL").select("block", "data")
    answers = answers.withColumnRenamed("block", "of")
    found = waiting.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(weigh, ", ".join(["text_hash long", *(f"{n} double" for n in names)]))
    return found.groupBy("text_hash").agg(*(F.max(n).alias(n) for n in names))


@dataclass
class Curve:
    """Logistic curve over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Curve:
        if not len(x):
            x, y = np.zeros((1, FEATURES)), np.zeros(1)
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.hstack([np.clip((x - mean) / scale, -FAR, FAR), np.ones((len(x), 1))])
        w = np.zeros(z.shape[1])
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        penalty = np.diag([ridge] * (len(w) - 1) + [1e-3])

        def loss(w: np.ndarray) -> float:
            return np.logaddexp(0, z @ w).sum() - y @ (z @ w) + w @ penalty @ w / 2

        for _ in range(100):
            p = np.exp(-np.logaddexp(0, -(z @ w)))
            slope = z.T @ (y - p) - penalty @ w
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, slope)
            # A whole step overshoots where classes lie well apart: all rows end on one side, where the curve is flat.
            size, now = 1.0, loss(w)
            while size > 1e-9 and loss(w + size * step) > now - 1e-4 * size * (slope @ step):
                size /= 2
            w += size * step
            if np.abs(size * step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def score(self, x: list[Column]) -> Column:
        clipped = [F.greatest(F.least((c - float(m)) / float(s), F.lit(FAR)), F.lit(-FAR)) * float(w) for c, m, s, w in zip(x, self.mean, self.scale, self.weights)]
        z = reduce(lambda a, b: a + b, clipped, F.lit(float(self.weights[-1])))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held_out: Column | None = None) -> DataFrame:
    """The columns of ``docs``, then ``_held_out`` and ``_toxicity`` from 0 to 1.

    ``labels(key, label)``: 1 toxic, 0 ordinary; null labels and keys are ignored, of several
    labels of a key the largest counts. Rows where ``held_out`` (by default ``crc32(key) % 5 = 0``) teach nothing. Of
    the others, a quarter by the same hash, but at most the ``FIT_ROWS`` keys with the smallest hashes, fit the curve; all others are counted.
    A null or empty text has no words and its own place on the curve. Repeated rows count and are
    scored each. Without labels every score is one half of the prior: low.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("_held_out", "_toxicity")
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % 5
    out = F.coalesce(held_out if held_out is not None else fold == 0, F.lit(False))
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    truth = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    truth = stored(truth.withColumnRenamed(key, "id"), "labels")
    teachers = docs.where(~out).select(F.col(key).alias("id"), content.alias("text"))
    known = shipped(teachers, truth).join(truth, "id")
    hashed = teachers.select("id", F.xxhash64("text").alias("text_hash")).join(truth, "id")
    chosen = hashed.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1).select("id").distinct()
    chosen = stored(chosen.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "curve")
    tokens = counted(known.join(chosen, "id", "left_anti"))
    vocabulary = stored(tokens.groupBy(*NAMES).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "vocabulary")
    model, shifts = learn(vocabulary)
    discard(vocabulary)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(model.count() / BUCKET_EXPRESSIONS))
    posts = stored(posted(docs.select(F.xxhash64(content).alias("text_hash"), content.alias("text")), model, buckets), "posts")
    found = stored(weighed(posts, answered(posts, model, buckets), shifts), "features")
    discard(posts, model)

    names = [f"f{i}" for i in range(FEATURES)]
    sample = hashed.join(chosen, "id").orderBy(F.xxhash64("id"), "id", "text_hash").limit(FIT_ROWS)
    fitted = sample.join(found, "text_hash").orderBy("id", "text_hash").toPandas()
    curve = Curve.fit(fitted[names].to_numpy(float), fitted["toxic"].to_numpy(float))

    scores = found.select(F.col("text_hash").alias("_text_hash"), curve.score([F.col(n) for n in names]).alias("_toxicity"))
    rows = docs.withColumn("_held_out", out).withColumn("_text_hash", F.xxhash64(content))
    return rows.join(scores, "_text_hash", "left").drop("_text_hash")
