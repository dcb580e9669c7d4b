"""Schemas of raw JSON as they are found, and how they change from hour to hour.

Records are parsed once into VARIANT values. What each hour holds is one small row for each field: its type
over all records and how many carry it. These rows can be kept and compared without the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.sources.lake import hour_of_file, topic_path


def scan_variant(spark: SparkSession, root: str, topic: str, hour: str | None = None) -> DataFrame:
    """``dt_hour, record`` for every record of a topic; a record is a VARIANT, null where it cannot be read.

    Lines may hold one object or an array of them.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(topic_path(root, topic, hour))
    lines = lines.select(F.trim("value").alias("value"), hour_of_file().alias("dt_hour")).where("value <> ''")
    parsed = lines.select("dt_hour", F.try_parse_json("value").alias("line"))
    many = F.try_variant_get("line", "$", "array<variant>")
    return parsed.select("dt_hour", F.explode(F.coalesce(many, F.array("line"))).alias("record"))


def field_types(records: DataFrame, by: Sequence[str] = ("dt_hour",)) -> DataFrame:
    """``by..., field, type, records``: the type that fits all values of each top-level field, and how many records carry it.

    A field that is null throughout has the type VOID. Records that are no objects have no fields.
    """
    spark = records.sparkSession
    fields = records.lateralJoin(spark.tvf.variant_explode(F.col("record").outer())).where("key IS NOT NULL")
    return fields.groupBy(*by, F.col("key").alias("field")).agg(F.schema_of_variant_agg("value").alias("type"), F.count(F.lit(1)).alias("records"))


def drift(types: DataFrame) -> DataFrame:
    """``dt_hour, field, change, was, now`` for every field that an hour has ``new``, ``lost`` or ``retyped`` against the hour before it.

    Works on the rows of ``field_types`` alone. The first hour has nothing before it and does not come out.
    """
    # One row for each hour.
    hours = types.select("dt_hour").distinct()
    hours = hours.select("dt_hour", F.lag("dt_hour").over(Window.orderBy("dt_hour")).alias("before")).where("before IS NOT NULL")
    now = types.join(hours, "dt_hour").select("dt_hour", "before", "field", F.col("type").alias("now"))
    was = types.select(F.col("dt_hour").alias("before"), "field", F.col("type").alias("was")).join(hours, "before")
    both = now.join(was, ["dt_hour", "before", "field"], "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "lost").when(F.col("was") != F.col("now"), "retyped")
    return both.select("dt_hour", "field", change.alias("change"), "was", "now").where("change IS NOT NULL")
