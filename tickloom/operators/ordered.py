"""Order-dependent operators for keys of any size.

A window partitioned by the key alone pulls the key's whole history into one
task. Here rows are first dealt out by ranges of (key, order), so that any key, a null one too, is cut
wherever it outgrows a range. Each stretch of a key is windowed on its own, and
one small row per cut carries what the next stretch needs (rows so far, first
value). There is one path for keys of every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.workspace import shared_dir


def in_ranges(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, which never decreases along ``(keys, order_by)``.

    Written to the shared folder: ranges come from a sample, and every later read must
    see the same ones. Without ``ranges`` their number follows the data's size.
    """
    columns = [*keys, *order_by]
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    dealt = dealt.withColumn("_range", F.spark_partition_id())
    path = shared_dir(df.sparkSession, "ranges")
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str = "position",
    next_of: dict[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its key.

    ``next_of`` adds, under the given new name, the value the column has in
    the key's next row; such a column must be the leading order column.
    """
    next_of = next_of or {}
    placed = in_ranges(df, keys, order_by, ranges)
    per_range = placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        # Inside a struct a null is the smallest value, as in the order.
        *[F.min(F.struct(F.col(source).alias("v"))).alias(f"_first_{target}") for target, source in next_of.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_range")
    carried = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        *[F.lead(f"_first_{target}").over(along).alias(f"_after_{target}") for target in next_of],
    )
    # Only the first key of a range can go on from the one before, and only the last
    # into the next: at most two rows for each range, which bounds the broadcast.
    goes_on = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("_before", *[f"_after_{t}" for t in next_of])])
    cuts = F.broadcast(carried.where(goes_on))

    inside = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    local = placed.withColumns(
        {
            "_local": F.row_number().over(inside),
            **{f"_lead_{target}": F.lead(source).over(inside) for target, source in next_of.items()},
            **{f"_last_{target}": F.lead(F.lit(True)).over(inside).isNull() for target in next_of},
        }
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_k_range")]
    return local.join(cuts, same, "left").select(
        *df.columns,
        (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint").alias(name),
        *[
            F.when(F.col(f"_last_{target}"), F.col(f"_after_{target}").getField("v")).otherwise(F.col(f"_lead_{target}")).alias(target)
            for target in next_of
        ],
    )


def with_halo(df: DataFrame, position: str, size: int, halo: int) -> DataFrame:
    """Cut numbered rows into blocks of ``size``, each led by ``halo`` older rows.

    Adds ``_block`` and ``_own``; rows with ``_own`` false only serve as history
    for the block that follows theirs.
    """
    if not 0 <= halo <= size:
        raise ValueError("halo must not exceed the block size")
    offset = F.col(position) - F.lit(1)
    home = F.floor(offset / F.lit(size))
    blocks = F.when(offset % F.lit(size) >= F.lit(size - halo), F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(blocks))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_home")
    )
