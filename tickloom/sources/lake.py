"""Raw JSON in the lake, in folders by topic and ingest hour.

Files hold one object per line, or one array of records per line; both yield one
row per record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.casts import quoted
from tickloom.sinks.commits import CommitLog

CORRUPT = "_corrupt_record"
KEYS = "_keys"  # the cleaned names of a record's fields, where names come in any case


def topic_path(root: str, topic: str, hour: str | None = None, hive_style: bool = True) -> str:
    """The hour's folder if one is named, else the whole topic.

    Folders are ``topic=<name>/dt_hour=<yyyy-MM-dd_HH>``, or the bare names in a
    lake that was not written by Spark.
    """
    topic_key, hour_key = ("topic=", "dt_hour=") if hive_style else ("", "")
    base = f"{root.rstrip('/')}/{topic_key}{topic}"
    return f"{base}/{hour_key}{hour}" if hour else base


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None, recursive: bool = False) -> DataFrame:
    """JSON files under ``path``.

    With a schema there is no inference pass over the data, files that lack a
    column give nulls, and unreadable records keep their text in
    ``_corrupt_record``. Without one the schema is the union of what the files
    hold.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if schema is not None:
        reader = reader.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path)


def hour_of_file() -> Column:
    """The ingest hour of a file, which is the name of its folder."""
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    # No search by pattern: over a long path, for every record, it costs many times what parsing the record does.
    return F.when(folder.startswith("dt_hour="), F.substring(folder, len("dt_hour=") + 1, 1 << 20)).otherwise(folder)


def read_any_case(spark: SparkSession, path: str, schema: str, with_hour: bool = False) -> DataFrame:
    """JSON files whose field names come in any case, with blanks around or inside them.

    All values are read as text. ``_keys`` lists what each record carries, so that a field that
    is null can be told from one that is not there. Unreadable records keep their text.
    """
    hour = [hour_of_file().alias("dt_hour")] if with_hour else []
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", *hour).where(F.trim("value") != "")
    kept = ["value", *["dt_hour"] * with_hour]
    many = F.from_json("value", "array<map<string,string>>")
    one = F.array(F.from_json("value", "map<string,string>"))
    records = F.explode_outer(F.when(F.ltrim("value").startswith("["), many).otherwise(one))
    fields = lines.select(*kept, records.alias("_record"))
    clean = F.transform(
        F.map_entries("_record"),
        lambda e: F.struct(F.replace(F.lower(F.trim(e["key"])), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")),
    )
    fields = fields.select(*kept, F.col("_record").isNull().alias("_bad"), clean.alias("_fields"))

    def value_of(name: str) -> Column:
        # The last value of a repeated field counts, as with exact names.
        return F.try_element_at(F.filter("_fields", lambda e: e["key"] == name), F.lit(-1))["value"].alias(name)

    names = StructType.fromDDL(schema).names
    return fields.select(*map(value_of, names), *kept[1:], F.col("_fields.key").alias(KEYS), F.when(F.col("_bad"), F.col("value")).alias(CORRUPT))


def carried(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that any record of ``read_any_case`` carries, counted in one pass."""
    seen = Observation()
    watched = df.observe(seen, *[F.coalesce(F.max(F.array_contains(KEYS, n)), F.lit(False)).alias(n) for n in names])
    watched.write.format("noop").mode("overwrite").save()
    return [n for n in names if seen.get[n]]


def scan_topic(
    spark: SparkSession,
    root: str,
    topic: str,
    hour: str | None = None,
    schema: str | None = None,
    hive_style: bool = True,
    any_case: bool = False,
    with_hour: bool = False,
) -> DataFrame:
    """Every record of a topic, or of one of its hours.

    ``with_hour`` adds the ingest hour, which is the name of a file's folder, as ``dt_hour``.
    """
    path = topic_path(root, topic, hour, hive_style)
    if any_case:
        return read_any_case(spark, path, schema, with_hour)
    records = read_json(spark, path, schema, recursive=True)
    return records.select("*", hour_of_file().alias("dt_hour")) if with_hour else records


def scan_partitioned(spark: SparkSession, root: str, topic: str, schema: str, hour: str | None = None) -> DataFrame:
    """A topic with ``dt_hour`` as a column; an hour filter prunes folders."""
    df = read_json(spark, topic_path(root, topic), f"{schema}, dt_hour string")
    return df.where(F.col("dt_hour") == hour) if hour else df


def scan_archive(
    spark: SparkSession, root: str, topic: str, hour: str | None = None, schema: str | None = None
) -> DataFrame:
    """Records of a topic that the archive stream has committed.

    Read from the root, where the stream keeps its commit log, files left behind by
    failed tasks are not seen; topic and hour prune folders.
    """
    if schema is None:
        raise ValueError("an archive of several topics has no common schema to infer")
    merged = CommitLog(spark, compacted_root(root))
    folders = {part.split("/", 1)[1]: folder for part, folder in merged.latest().parts.items() if part.split("/", 1)[0] == topic}
    df = read_json(spark, root, f"{schema}, topic string, dt_hour string").where(F.col("topic") == topic)
    if hour:
        df = df.where(F.col("dt_hour") == hour)
        folders = {h: f for h, f in folders.items() if h == hour}
    df = df.where(~F.col("dt_hour").isin(list(folders))) if folders else df
    df = df.drop("topic", "dt_hour")
    # Hours that were merged into few files are read from there.
    return df.unionByName(read_json(spark, [f"{merged.path}/{f}" for f in folders.values()], schema)) if folders else df


def compacted_root(root: str) -> str:
    """Where the merged hours of an archive are."""
    return f"{root.rstrip('/')}.compacted"


def is_corrupt(df: DataFrame) -> Column:
    """True for records that could not be read."""
    if CORRUPT not in df.columns:
        return F.lit(False)
    # A field never equals the text of its whole record, so the comparison below
    # adds nothing but a second column: Spark refuses to parse for this one alone.
    anchor = quoted(next(c for c in df.columns if c not in (CORRUPT, KEYS))).cast("string")
    return F.col(CORRUPT).isNotNull() & ~anchor.eqNullSafe(F.col(CORRUPT))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, unreadable ones for quarantine)."""
    return df.where(~is_corrupt(df)).drop(CORRUPT), df.where(is_corrupt(df))
