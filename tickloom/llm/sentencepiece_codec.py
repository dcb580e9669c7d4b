"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece of the vocabulary spans the cut. Every chunk is
encoded by an agenda: adjacent symbol pairs that form a piece wait in a heap
ordered by score, then by place; the best pair is merged, and the pairs it makes
with its neighbours join the agenda. What stays outside the vocabulary becomes
bytes. Distinct chunks are encoded once for each Arrow batch and kept in a bounded table
of the worker; each is compared with the sentencepiece library as it is made.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import prepare

SPACE = "▁"
KEPT_CHUNKS = 500_000  # chunks that a worker remembers of the present, and of the generation before
KEPT_LENGTH = 64  # longer chunks are encoded anew each time


_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_LETTER = re.compile(r"[^\W\d_]")
# A mark before a blank that may be cut off, if only a letter stands before it.
_JOINED_MARK = re.compile(r"[,.](?<![^\W\d_].) ")
GLUE = "\x00"  # in front of a chunk: no space belongs to it


class Codec:
    """Agenda encoder over the normal pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_score = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.pieces = [sp.id_to_piece(i) for i in by_score]
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.id = {sp.id_to_piece(i): i for i in normal}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        beside = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        #: whether no piece goes on over a space or a line feed
        self.splits = not (any(b == SPACE and a != SPACE for a, b in beside) or any("\n" in p for p in beside))
        #: marks that no piece has after a letter
        self.marks = [m for m in ",." if not any(b == m and _LETTER.match(a) for a, b in beside)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks that no piece spans; ``word`` stands for space and word, ``GLUE + word`` for the word alone."""
        if not text:
            return []
        if not self.splits or GLUE in text:
            return [GLUE + SPACE + text.replace(" ", SPACE)]
        if "  " in text or text[0] == " " or SPACE in text:
            found = _CHUNKS.findall(SPACE + text.replace(" ", SPACE))
            return [c[1:] if c[0] == SPACE and c[1:2] != SPACE else GLUE + c for c in found]
        text = text.replace("\n", f" {GLUE}\n {GLUE}").replace(f" {GLUE} ", " ")
        if self.marks and not _JOINED_MARK.search(text):
            for mark in self.marks:
                text = text.replace(f"{mark} ", f" {GLUE}{mark} ")
        return text.split(" ")

    def merge(self, chunk: str) -> list[str]:
        """The chunk's symbols after all merges, best score first, leftmost on ties."""
        symbols: list[str | None] = list(chunk)
        n, rank = len(symbols), self.rank
        agenda = [(r, i) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        after, before, pieces = list(range(1, n + 1)), list(range(-1, n - 1)), self.pieces
        while agenda:
            r, i = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pieces[r]:
                continue  # a neighbour has been merged meanwhile
            symbols[i], symbols[j] = pieces[r], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (made := rank.get(pieces[r] + symbols[k])) is not None:
                    heapq.heappush(agenda, (made, i))
            if (h := before[i]) >= 0 and (made := rank.get(symbols[h] + pieces[r])) is not None:
                heapq.heappush(agenda, (made, h))
        return [s for s in symbols if s is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            if (i := self.id.get(symbol)) is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in symbol.encode())
        return out

    def learn(self, wanted: set[str]) -> set[str]:
        """Make new chunks known; those whose ids differ from the library's come back."""
        known, new = self.known, list(wanted)
        plain = [c[1:] if c[:1] == GLUE else SPACE + c for c in new]
        made = [self.chunk_ids(c) for c in plain]
        for c, ids in zip(new, made):
            known[c] = array("I", ids).tobytes()
        # A line feed before each chunk keeps the library from adding a space to it.
        asked = [c for c in plain if "\n" not in c]
        theirs = self.library.encode("\n" + "\n".join(asked).replace(SPACE, " "), num_threads=1)[1:] if asked else []
        feed = self.byte[10]
        ours = list(chain.from_iterable((feed, *ids) for c, ids in zip(plain, made) if "\n" not in c))
        if ours == theirs and len(asked) == len(plain):
            return set()
        each = self.library.encode(["\n" + c.replace(SPACE, " ") for c in plain], num_threads=1)
        return {c for c, a, b in zip(new, made, each) if a != b[2:]}

    def encode_batch(self, texts: list[str], add_ends: bool) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian unsigned 32-bit integers; whether the library agrees."""
        if len(self.known) > KEPT_CHUNKS:
            self.known, self.older = {}, self.known  # chunks that are still in use come back from there
        known, older = self.known, self.older
        cut = [self.chunks(t) for t in texts]
        found = [list(map(known.get, chunks)) for chunks in cut]
        gaps = [(chunks, ids, [i for i, x in enumerate(ids) if x is None]) for chunks, ids in zip(cut, found) if None in ids]
        fresh = {chunks[i] for chunks, _, at in gaps for i in at}
        known.update((c, older[c]) for c in fresh & older.keys())
        fresh -= older.keys()
        differ = self.learn(fresh)
        for chunks, ids, at in gaps:
            for i in at:
                ids[i] = known[chunks[i]]
        for c in fresh:
            if len(c) > KEPT_LENGTH or c in differ:
                del known[c]
        begin, end = (array("I", [i] * add_ends).tobytes() for i in (self.begin, self.end))
        return [b"".join((begin, *ids, end)) for ids in found], [not differ or differ.isdisjoint(c) for c in cut]


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The worker's codec for a model file."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", add_ends: bool = True) -> DataFrame:
    """``key, ids, decoded, agrees`` for each row of ``docs``.

    ``ids`` is binary: little-endian unsigned 32-bit ids, with begin and end ids if
    ``add_ends``. ``decoded`` is the library's decoding of them. ``agrees`` tells whether the
    agenda and the library gave the same ids. A null text counts as empty; an
    empty text has only the end ids. Null and repeated keys keep their rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, agrees = own.encode_batch(texts, add_ends)
            decoded = [own.library.decode(np.frombuffer(b, "<u4").tolist()) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                ["key", "ids", "decoded", "agrees"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded string, agrees boolean").withColumnRenamed("key", key)
