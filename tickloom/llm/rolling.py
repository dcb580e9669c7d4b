"""Rolling hashes over the bytes of an Arrow batch of texts, without a Python step per character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_BYTES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)
PIECE_BYTES = 1 << 19  # texts hashed together; a longer text is hashed alone

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, PIECE_BYTES) + 1
        both = []
        for base in (ODD, INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[:] = both
    return _powers[0], _powers[1]


class Prefix:
    """Hashes of any stretch of some bytes from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * ODD)

    def every(self, length: int) -> np.ndarray:
        """Of the stretch of ``length`` bytes from each place on."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length * int(ODD) % (1 << 64)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each begins, with the end as last."""
    column = column.fill_null("").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return data, (at - at[0] if len(at) else np.zeros(1, np.int64))


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and beginnings of runs of rows that are hashed together."""
    data, at = text_bytes(column)
    row = 0
    while row < len(at) - 1:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop
