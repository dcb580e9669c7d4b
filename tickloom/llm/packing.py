"""Shortest-pack-first packing over the histogram of lengths.

Documents become ids and are cut into pieces of at most the capacity. Only the
histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches
the driver. There lengths are placed longest first, each into the emptiest packs
that can take it; what is kept is a count for each packing pattern, not a
sequence. Pieces then find their pattern by their rank among pieces of the same length.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import prepare, remembered, stored

KEPT_WORDS = 300_000  # words that a worker remembers of the present, and of the generation before
GROUP_ROWS = 4096  # pieces ranked together

# The vocabulary's own word pattern always ends a word between a letter and another mark, save that
# an apostrophe may draw the letters after it to itself.
_LETTER = r"[^\W\d_]"
_OTHER = r"(?:[^\w \t\r\n]|[\d_])"
_WORDS = re.compile(f"{_LETTER}+|{_OTHER}*'{_LETTER}+|{_OTHER}+")
_BLANKS = re.compile(r"[^ \t\r\n]+")
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"  # white space for Python, not for the vocabulary


# A comma or full stop before a blank is a word of its own if nothing but a letter stands before it.
_JOINED_MARK = re.compile(r"[,.](?<![^\W\d_].)\s")


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file; each distinct word goes through the library once.

    Valid for vocabularies that drop white space, never join words across it and mark the
    last token of a word.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        # The library composes, then lowers each character. On composed text the cuts are safe,
        # and lowering may come first; strings of special tokens are left as they are. A dotted capital I becomes two
        # characters, of which the second joins marks that follow: its words go to the library uncut.
        if "<|" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
            return _BLANKS.findall(text)
        if not text.isascii() and any(c in text for c in "ΣK"):
            return _WORDS.findall(text)
        text = text.lower()
        if "'" in text or _JOINED_MARK.search(text):
            return _WORDS.findall(text)
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return _BLANKS.findall(text) if any(c in text for c in _ODD_BLANKS) else text.split()

    def _learn(self, new: list[str]) -> None:
        letters = [w for w in new if w.isalpha()]
        runs = [letters[i : i + 2000] for i in range(0, len(letters), 2000)]
        for run, got in zip(runs, self.library.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(run):
                self._learn_each(run)
                continue
            flat, start = ids.tobytes(), 0
            for word, stop in zip(run, cuts.tolist()):
                self.known[word] = flat[start:stop]
                start = stop
        self._learn_each([w for w in new if not w.isalpha()])

    def _learn_each(self, words: list[str]) -> None:
        for word, got in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
            self.known[word] = np.array(got.ids, "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known  # words that are still in use come back from there
        known, older = self.known, self.older
        cut = [self.words(t) for t in texts]
        found = [list(map(known.get, words)) for words in cut]
        gaps = [(words, ids, [i for i, x in enumerate(ids) if x is None]) for words, ids in zip(cut, found) if None in ids]
        fresh = {words[i] for words, _, at in gaps for i in at}
        known.update((w, older[w]) for w in fresh & older.keys())
        self._learn(list(fresh - older.keys()))
        for words, ids, at in gaps:
            for i in at:
                ids[i] = known[words[i]]
        return [b"".join(ids) for ids in found]


_tokenizers: dict[str, WordTokenizer] = remembered()


def tokenizer(file: str) -> WordTokenizer:
    if file not in _tokenizers:
        _tokenizers[file] = WordTokenizer(file)
    return _tokenizers[file]


def pieces(docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, ids``: each document's ids in pieces of at most ``capacity``."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file)
        for batch in batches:
            out = []
            for row, ids in enumerate(own.encode_batch([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((row, start, len(part) // 4, zlib.crc32(part), n, part))
            rows, *rest = zip(*out) if out else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(rest, kinds))],
                ["key", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary").withColumnRenamed("key", key)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(how many sequences, [(length, how often), ...])`` for a histogram of lengths."""
    packs: dict[int, list] = defaultdict(list)  # by free space
    spaces: list[int] = []  # heap of -free space

    def put(free: int, count: int, pattern: list) -> None:
        if not packs[free]:
            heapq.heappush(spaces, -free)
        packs[free].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while spaces and not packs[-spaces[0]]:
                heapq.heappop(spaces)
            free = -spaces[0] if spaces else 0
            if free < length:
                # As many new packs as these pieces need, one piece in each to begin with.
                opened = math.ceil(left / (capacity // length))
                put(capacity - length, opened, [(length, 1)])
                left -= opened
                continue
            count, pattern = packs[free].pop()
            used = min(count, left)
            if count > used:
                packs[free].append((count - used, pattern))
            left -= used
            more = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            put(free - length, used, more)
    return [(count, pattern) for group in packs.values() for count, pattern in group]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of one length in a pattern: its ranks, its first sequence and its offset there."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, often in pattern:
            out.append((length, used[length], often, first, offset))
            used[length] += count * often
            offset += length * often
        first += count
    length, rank, often, sequence, offset = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return {"length": length, "rank": rank, "often": often, "sequence": sequence, "offset": offset}


def pack(docs: DataFrame, file: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset each was given.

    Returns ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``keep_ids``, the piece's ids. A null text counts as empty and has the end id only; repeated
    rows are packed each; an empty table gives no rows. Ties in length are ranked by key and start.
    """
    cut = pieces(docs, file, capacity, end_id, key, text)
    cut = stored(cut if keep_ids else cut.drop("ids"), "pieces")
    counts = cut.groupBy("length").count().toPandas()  # one row for each length, capacity rows at most
    histogram = dict(zip(counts["length"].tolist(), counts["count"].tolist()))
    place = slots(shortest_pack_first(histogram, capacity), capacity)
    salts = max(16, math.ceil(max(histogram.values(), default=0) / GROUP_ROWS))

    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(key, "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "start", "ids_crc32"))
    ranked = salted.withColumn("_in", inside).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1)

    step = int(max(place["rank"], default=0)) + sum(histogram.values()) + 1
    keys = place["length"] * step + place["rank"]
    assert capacity * step < 2**62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            at = np.searchsorted(keys, length * step + rank, "right") - 1
            pack_no, slot = np.divmod(rank - place["rank"][at], place["often"][at])
            kept = [c for c in batch.schema.names if not c.startswith("_")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(place["sequence"][at] + pack_no), pa.array(place["offset"][at] + slot * length)],
                [*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*cut.columns, "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")
