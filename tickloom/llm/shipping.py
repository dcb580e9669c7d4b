"""Moving few of many texts: a filter of fixed size spares the others a shuffle, the rest travel compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24  # of the filter, whatever the corpus; a full one lets every text pass
FILTER_HASHES = 3


def filter_places(ids: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(ids, F.lit(i)), F.lit(FILTER_BITS)) for i in range(FILTER_HASHES)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of ``ids(id)``: ``FILTER_BITS`` whatever their number."""
    places = ids.select(F.explode(F.array(*filter_places(F.col("id")))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    got = words.toPandas()  # FILTER_BITS / 64 rows at most
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _held(bits: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Which rows the filter lets pass, by their places ``at0``..."""
    held = np.ones(batch.num_rows, bool)
    for i in range(FILTER_HASHES):
        at = batch.column(f"at{i}").to_numpy()
        held &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return held


def likely(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``keys`` are in ``wanted(keys)``, and few others; nothing is shuffled.

    For the big side of a join with few matches, in front of it.
    """
    bits = rows.sparkSession.sparkContext.broadcast(id_filter(wanted.select(F.xxhash64(*keys).alias("id"))))
    names = rows.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names).filter(pa.array(_held(bits.value, batch)))

    places = [c.alias(f"at{i}") for i, c in enumerate(filter_places(F.xxhash64(*keys)))]
    return rows.select(*names, *places).mapInArrow(choose, rows.schema)


def shipped(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, bytes, squeezed`` of the rows of ``rows(id, text)`` whose id is in ``wanted(id)``, and of few others.

    The caller joins the result with its ids, which leaves the others out. Null ids never pass.
    """
    bits = rows.sparkSession.sparkContext.broadcast(id_filter(wanted))
    kind = rows.schema["id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _held(bits.value, batch)
            ids, texts = (batch.column(c).filter(pa.array(held)) for c in ("id", "text"))
            squeezed = [pa.compress((t or "").encode(), "zstd", asbytes=True) for t in texts.to_pylist()]
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sizes, pa.array(squeezed, pa.binary())], ["id", "bytes", "squeezed"])

    places = [c.alias(f"at{i}") for i, c in enumerate(filter_places(F.col("id")))]
    return rows.where("id IS NOT NULL").select("id", "text", *places).mapInArrow(squeeze, f"id {kind}, bytes long, squeezed binary")


def unsqueezed(batch: pa.RecordBatch) -> pa.Array:
    """The texts of shipped rows."""
    pairs = zip(batch.column("squeezed").to_pylist(), batch.column("bytes").to_pylist())
    return pa.array([pa.decompress(s, n, "zstd", asbytes=True).decode() for s, n in pairs], pa.string())
