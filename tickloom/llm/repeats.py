"""Removal of long strings that start more than once, by prefix-free parsing.

Departure from the method: no suffix array of the dictionary and none of the parse is built, and nothing is merged into corpus
order. Only strings of one length matter here, so the order of suffixes is replaced by hashes of 64 bits of those strings, compared
within the phrases of one trigger; between phrases, by hashes of whole phrases.

A rolling hash cuts texts into phrases: in each stretch of bytes as long as the strings looked for,
the gram with the smallest hash is the trigger, so equal strings are cut alike wherever they
stand. All strings with one trigger form a phrase with its context. The dictionary
of distinct phrases decides most: one that occurs again repeats as a whole, and one whose trigger
occurs nowhere else repeats nowhere. Only distinct phrases that share a trigger
need their bytes: the strings in them, as hashes, are sorted, and neighbours that are equal start more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, forget, prepare, stored
from tickloom.llm.grouped import batched, key_groups
from tickloom.llm.rolling import Prefix, pieces, text_bytes
from tickloom.llm.shipping import likely, shipped, unsqueezed

GRAM = 64  # bytes of a trigger
CROWD = 20_000  # distinct phrases of one trigger; more are ordered by the hash of each string


class Passages(NamedTuple):
    """Runs of repeated strings of ``length`` bytes, told by triggers of ``gram`` bytes, that hold so many words."""

    length: int = 200
    gram: int = 48
    words: int = 51


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first start, number of starts, trigger hash and context hash of every phrase.

    A phrase is a run of starts of strings of ``length`` bytes with the same trigger; its context
    reaches from the first start to the end of the last string.
    """
    prefix = Prefix(data)
    hashes = prefix.every(gram)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    # The place breaks ties: the leftmost smallest gram is the trigger.
    place_bits = max(1, int(len(hashes)).bit_length())
    marked = (hashes >> np.uint64(place_bits) << np.uint64(place_bits)) | np.arange(len(hashes), dtype=np.uint64)
    trigger = (window_minima(marked, length - gram + 1) & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    starts = np.arange(len(trigger))
    texts = np.searchsorted(at, starts, "right") - 1
    inside = starts + length <= at[texts + 1]
    starts, texts, trigger = starts[inside], texts[inside], trigger[inside]
    if not len(starts):
        return none, none, none, none, none
    new = np.append(True, (trigger[1:] != trigger[:-1]) | (texts[1:] != texts[:-1]))
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    context = prefix.of(begin, begin + counts - 1 + length)
    key = hashes[trigger[first]]
    return texts[first], begin - at[texts[first]], counts, key.view(np.int64), context.view(np.int64)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each distinct context, which of its strings start more than once among all of them."""
    ranks = [Prefix(np.frombuffer(c, np.uint8)).every(length) for c in contexts]
    every = np.concatenate(ranks)
    order = np.argsort(every, kind="stable")  # equal strings become neighbours
    same = every[order][1:] == every[order][:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.split(twice, np.cumsum([len(r) for r in ranks])[:-1])


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def merged(spans: list) -> list[tuple[int, int]]:
    """Disjoint maximal spans."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(s) for s in out]


def kept_text(kept: str = "_kept") -> Column:
    """The bytes of ``kept`` as text: characters that a cut splits go with the passage."""
    rest = F.col(kept).cast("string")
    return F.when(F.is_valid_utf8(rest), rest).otherwise(F.replace(F.make_valid_utf8(rest), F.lit("\ufffd"), F.lit("")))


def repeated_spans(texts: DataFrame, length: int, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Spans ``(name, begin, end)`` of UTF-8 bytes that cover all strings of ``length`` bytes in ``texts(name, text)`` which start more than once.

    Equal names are rows of equal texts. The spans may overlap.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names = batch.column("name")
            for row, data, at in pieces(batch.column("text")):
                which, begin, starts, trigger, context = phrases(data, at, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(which + row)), *(pa.array(x) for x in (begin, starts, trigger, context))],
                    ["name", "begin", "starts", "trigger", "context"],
                )

    parsed = stored(texts.mapInArrow(parse, "name long, begin long, starts long, trigger long, context long"), "phrases")
    dictionary = parsed.groupBy("trigger", "context").agg(F.count("*").alias("n"), F.min(F.struct("name", "begin", "starts")).alias("one"))
    dictionary = stored(dictionary, "dictionary")
    again = dictionary.where("n > 1").select("trigger", "context")
    spans = likely(parsed, ["trigger", "context"], again).join(again, ["trigger", "context"], "left_semi").select("name", "begin", (F.col("begin") + F.col("starts") - 1 + length).alias("end"))

    # Triggers of several distinct phrases: their bytes decide.
    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unsure = dictionary.join(shared, "trigger").select("trigger", "context", "kinds", (F.col("n") > 1).alias("whole"), "one.*")
    wanted = unsure.groupBy("name").agg(F.collect_list(F.struct("trigger", "context", "kinds", "whole", "begin", "starts")).alias("parts"))
    wanted = stored(wanted.withColumnRenamed("name", "id"), "unsure")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("trigger", pa.int64()), ("context", pa.int64()), ("kinds", pa.int64()), ("whole", pa.bool_()), ("name", pa.int64()), ("begin", pa.int64()), ("bytes", pa.binary())])

        def run() -> Iterator[tuple]:
            for batch in batches:
                data, at = text_bytes(unsqueezed(batch))
                for name, begin, parts in zip(batch.column("id").to_pylist(), at.tolist(), batch.column("parts").to_pylist()):
                    for p in parts:
                        a = begin + p["begin"]
                        yield p["trigger"], p["context"], p["kinds"], p["whole"], name, p["begin"], data[a : a + p["starts"] - 1 + length].tobytes()

        yield from batched(run(), fields, 1024)

    held = shipped(texts.withColumnRenamed("name", "id"), wanted.select("id")).join(wanted, "id")
    cuts = held.mapInArrow(cut, "trigger long, context long, kinds long, whole boolean, name long, begin long, bytes binary")
    cuts = stored(cuts.dropDuplicates(["trigger", "context"]), "contexts")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for group in key_groups(batches, ["trigger"]):
                twice = repeated_starts(group.column("bytes").to_pylist(), length)
                for name, begin, whole, mask in zip(*(group.column(c).to_pylist() for c in ("name", "begin", "whole")), twice):
                    if not whole and mask.any():
                        yield from ((name, begin + a, begin + b - 1 + length) for a, b in runs(mask))

        yield from batched(run(), pa.schema([("name", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    few = cuts.where(F.col("kinds") <= crowd).repartition("trigger").sortWithinPartitions("trigger")
    ordered = few.mapInArrow(order, "name long, begin long, end long")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin, data in zip(*(batch.column(c).to_pylist() for c in ("name", "begin", "bytes"))):
                hashes = Prefix(np.frombuffer(data, np.uint8)).every(length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hashes)), pa.array(np.arange(begin, begin + len(hashes))), pa.array(hashes)], ["name", "begin", "string"])

    # A crowded trigger is never one group: each of its strings is counted by itself.
    single = cuts.where(F.col("kinds") > crowd).mapInArrow(strings, "name long, begin long, string long")
    common = single.groupBy("string").count().where("count > 1").select("string")
    crowded = single.join(common, "string", "left_semi").select("name", "begin", (F.col("begin") + length).alias("end"))

    found = stored(spans.unionByName(ordered).unionByName(crowded), "spans")
    discard(parsed, dictionary, wanted, cuts)
    return found


def maximal(spans: DataFrame) -> DataFrame:
    """The disjoint maximal runs ``(name, begin, end)`` of ``spans(name, begin, end)``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[tuple]:
            for batch in batches:
                for name, found in zip(batch.column("name").to_pylist(), batch.column("found").to_pylist()):
                    yield from ((name, x, y) for x, y in merged([(s["begin"], s["end"]) for s in found]))

        yield from batched(run(), pa.schema([("name", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    # A text has as many spans as bytes at most.
    return spans.groupBy("name").agg(F.collect_set(F.struct("begin", "end")).alias("found")).mapInArrow(merge, spans.schema)


def remove_repeats(
    docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", gram: int = GRAM, crowd: int = CROWD, least_words: int = 0, passages: Passages | None = None
) -> DataFrame:
    """The columns of ``docs``, then ``_bytes``, ``_spans`` and ``_kept``; with ``passages`` also ``_passages`` and ``_rest``.

    ``_spans`` are the maximal runs ``(begin, end)`` of UTF-8 bytes that some string of ``length`` bytes
    covers which also starts anywhere else, in the same text or in another; ``_kept`` are the other
    bytes. Columns of ``docs`` with these names give way. Strings never cross texts. A null text counts as empty; a text shorter than ``length``
    has no spans; repeated rows repeat each other. Runs that hold fewer than ``least_words`` words, cut ones included, stay.

    ``_passages`` are such runs for the shorter strings of ``passages`` with its least number of words, and ``_rest`` what is left without them.
    A string of ``length`` bytes that repeats lies in a run of the shorter ones, so the longer are sought only in texts with such a run.
    """
    prepare(docs.sparkSession)
    assert 0 < gram <= length
    wanted = [(False, "_spans", "_kept", least_words), *([(True, "_passages", "_rest", passages.words)] if passages else [])]
    docs = docs.drop("_bytes", "__name", "__found", *(c for _, runs_name, left_name, _ in wanted for c in (runs_name, left_name)))
    # Rows of equal key and text have equal results and share a name.
    name = F.xxhash64(F.col(key), F.col(text).cast("string"))
    texts = docs.select(name.alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if passages:
        assert 0 < passages.gram <= passages.length <= length
        found = repeated_spans(texts, passages.length, passages.gram, crowd)
        short = stored(maximal(found), "runs")
        discard(found)
        texts = likely(texts, ["name"], short.where(F.col("end") - F.col("begin") >= length).select("name").distinct())
    joined = repeated_spans(texts, length, gram, crowd).withColumn("passage", F.lit(False))
    if passages:
        joined = joined.unionByName(short.withColumn("passage", F.lit(True)))
    # A text has as many spans as bytes at most.
    by_name = joined.groupBy("name").agg(F.collect_set(F.struct("passage", "begin", "end")).alias("__found"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(text))
            out = {"_bytes": pa.array(np.diff(at))}
            found = batch.column("__found").to_pylist()
            for passage, runs_name, left_name, words in wanted:
                spans, kept = [], []
                for a, b, own in zip(at[:-1].tolist(), at[1:].tolist(), found):
                    own = merged([(s["begin"], s["end"]) for s in own or [] if s["passage"] == passage])
                    if words:
                        own = [(x, y) for x, y in own if len(data[a + x : a + y].tobytes().split()) >= words]
                    spans.append([{"begin": x, "end": y} for x, y in own])
                    marks = [0, *(m for s in own for m in s), b - a]
                    kept.append(b"".join(data[a + x : a + y].tobytes() for x, y in zip(marks[::2], marks[1::2])))
                out[runs_name] = pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                out[left_name] = pa.array(kept, pa.binary())
            others = [c for c in batch.schema.names if not c.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *out.values()], [*others, *out])

    every = docs.withColumn("__name", name).join(by_name.withColumnRenamed("name", "__name"), "__name", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    added = ", ".join(f"{runs_name} array<struct<begin: long, end: long>>, {left_name} binary" for _, runs_name, left_name, _ in wanted)
    return every.mapInArrow(keep, f"{fields}, _bytes long, {added}")
