"""Rows of one key at a time from partitions that are sorted by it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One record batch for each run of rows with equal whole-number ``keys``; a run may span batches."""
    rest: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return rest[0] if len(rest) == 1 else pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist()]
        if rest and any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield joined()
            rest = []
        for start, stop in zip(starts, [*starts[1:], None]):
            part = batch.slice(start) if stop is None else batch.slice(start, stop - start)
            if stop is None:
                rest.append(part)
            elif rest:
                rest.append(part)
                yield joined()
                rest = []
            else:
                yield part
    if rest:
        yield joined()


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of so many tuples."""
    held: list[tuple] = []
    for row in chain(rows, [None]):
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) >= size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
