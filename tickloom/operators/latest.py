"""One row per key, chosen by a total order so that reruns agree."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.casts import quoted


def _orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return _orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(_orderable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def one_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str] = ()) -> DataFrame:
    """Keep the row with the greatest ``(newest_by..., remaining columns...)``.

    ``max`` over a struct that holds the whole row is combined on the map side,
    so a key that holds a third of all rows reaches the shuffle as one row per
    map task. Columns keep their order.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*[quoted(k) for k in keys]).distinct()
    first = [c for c in newest_by if c in rest]
    ranked = [*first, *[c for c in rest if c not in first]]
    sortable = {f.name: _orderable(f.dataType) for f in df.schema.fields}
    if all(sortable[c] for c in ranked):
        winner = F.max(F.struct(*[quoted(c) for c in ranked]))
    else:
        order = [quoted(c) if sortable[c] else F.to_json(quoted(c)) for c in ranked]
        winner = F.max_by(F.struct(*[quoted(c) for c in ranked]), F.struct(*order))
    grouped = df.groupBy(*[quoted(k) for k in keys]).agg(winner.alias("_winner"))
    return grouped.select(
        *[quoted(c) if c in keys else F.col("_winner").getField(c).alias(c) for c in df.columns]
    )


def keyed_replace(
    frames: Iterable[DataFrame], keys: Sequence[str], version: str, newest_by: Sequence[str] = ()
) -> DataFrame:
    """Merge loads of one table, later frames superseding earlier ones.

    The load number becomes the leading order column, so all loads are resolved
    by the same single aggregation instead of one per load.
    """
    loads = [f.withColumn(version, F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loads)
    return one_per_key(merged, keys, (version, *newest_by)).drop(version)


def conform(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Project to a table's declared columns and types.

    Unknown columns are dropped, missing ones become null, values that do not
    fit the declared type become null.
    """
    known = {c.lower(): c for c in df.columns}

    def project(name: str, data_type: str) -> Column:
        if name in known:
            return quoted(known[name]).try_cast(data_type).alias(name)
        return F.lit(None).cast(data_type).alias(name)

    return df.select(*[project(name, data_type) for name, data_type in columns])
