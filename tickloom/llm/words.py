"""Words between ASCII blanks, counted over the bytes of an Arrow batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tickloom.llm.rolling import text_bytes

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True  # the bytes that bytes.split() cuts at
BLOCK_BYTES = 1 << 20  # of one text that are cut into words at once


def sums(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks each text holds; ``at`` as ``text_bytes`` gives it."""
    before = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=before[1:])
    return before[at[1:]] - before[at[:-1]]


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text; a null text has none."""
    data, at = text_bytes(column)
    word = ~BLANK[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < at[1:]]  # a text's first byte begins a word, whatever stands before it
    starts[begins] = word[begins]
    return sums(starts, at)


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch at a time."""
    start = 0
    while start < len(text):
        stop = min(start + BLOCK_BYTES, len(text))
        while stop < len(text) and not BLANK[text[stop]]:
            stop += 1
        yield text[start:stop].split()
        start = stop
