"""Published tables as Parquet: appended per load, resolved to one row per key.

Every attempt to write a load has a folder of its own, ``batch_id=<n>/attempt=<id>``; the commit log tells which
attempt counts, so writing the same load again replaces it and nothing else, whenever it comes. Readers merge the loads
by key. Compaction merges the partitions that later loads touch into a base, whose rows keep the number of
their load: a load that arrives late, or again, is then merged as if it had come in time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.counting import counted, rows_written
from tickloom.functions.temporal import day_key, month_key
from tickloom.operators.latest import conform, one_per_key
from tickloom.session import shuffles_dropped
from tickloom.sinks.commits import CommitLog, Snapshot, ranges, without
from tickloom.specs import TABLES, TableSpec

PARTITION = "part_key"
NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null key
WHOLE = ""  # stands for the partition of a table without partitions
FILE_BYTES = 128 << 20  # of a base's files, about
BLOOM_BYTES = 64 << 10  # of the filter of one row group at most
SMALL_SHARE = 4  # later loads below this share of the base are merged without shuffling the base


def _with_partition(df: DataFrame, spec: TableSpec) -> DataFrame:
    if spec.partition_time is None:
        return df
    grain = {"day": day_key, "month": month_key}[spec.partition_grain]
    return df.withColumn(PARTITION, grain(F.col(spec.partition_time)))


def layout(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows placed by partition (large ones split) and sorted by key inside.

    Partitions follow time, not ticker: a folder per ticker would mean as many
    small files as there are tickers, and one huge folder for a busy one. The
    sort by key keeps a ticker's rows together, so file statistics skip the rest.
    """
    keyed = _with_partition(df, spec)
    if spec.partition_time is None:
        return keyed.hint("rebalance").sortWithinPartitions(*spec.keys)
    return keyed.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, *spec.keys)


def clustered(df: DataFrame, spec: TableSpec, files: int) -> DataFrame:
    """Rows in ``files`` ranges of (partition, key): a key lies in one file of its partition, or in few that follow each other."""
    keyed = _with_partition(df, spec)
    order = [*([] if spec.partition_time is None else [PARTITION]), *spec.keys]
    return keyed.repartitionByRange(files, *order).sortWithinPartitions(*order)


def _write(df: DataFrame, path: str, spec: TableSpec, files: int | None = None) -> None:
    placed = layout(df, spec) if files is None else clustered(df, spec, files)
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if spec.keys[0] in [name for name, kind in spec.columns if kind == "string"]:
        # Readers of one key skip the row groups whose filter does not know it.
        writer = writer.option(f"parquet.bloom.filter.enabled#{spec.keys[0]}", "true").option("parquet.bloom.filter.max.bytes", BLOOM_BYTES)
    if spec.partition_time is not None:
        writer = writer.partitionBy(PARTITION)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)


def append_load(df: DataFrame, path: str, spec: TableSpec, batch_id: int) -> None:
    """Write one load; repeating a ``batch_id`` replaces that load, compacted or not."""
    folder = f"batch_id={batch_id}/attempt={uuid4().hex}"
    _write(conform(df, spec.columns), f"{path.rstrip('/')}/{folder}", spec)
    CommitLog(df.sparkSession, path).commit(lambda now: replace(now, loads={**now.loads, batch_id: folder}))


def publish(df: DataFrame, root: str, table: str, batch_id: int) -> int:
    """Append a load to a declared table below ``root``; gives its row count."""
    rows, counter = counted(df)
    append_load(rows, f"{root.rstrip('/')}/{table}", TABLES[table], batch_id)
    return rows_written(counter)


def _columns_ddl(spec: TableSpec) -> str:
    columns = ", ".join(f"`{name}` {data_type}" for name, data_type in spec.columns)
    return columns if spec.partition_time is None else f"{columns}, {PARTITION} string"


def _read_folders(spark: SparkSession, path: str, spec: TableSpec, folders: Sequence[str]) -> DataFrame:
    ddl = f"{_columns_ddl(spec)}, batch_id bigint"
    if not folders:
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(ddl).option("basePath", path).parquet(*[f"{path}/{f}" for f in folders])
    return rows.drop("attempt", "base")  # parts of the folders' names


def _in_parts(parts: Sequence[str]) -> Column:
    chosen = F.col(PARTITION).isin(list(parts))
    return chosen | F.col(PARTITION).isNull() if NO_PARTITION in parts else chosen


def _base(spark: SparkSession, path: str, spec: TableSpec, snapshot: Snapshot, parts: Sequence[str] = ()) -> DataFrame:
    """The base's rows with the load that each came from."""
    chosen = [f for part, f in sorted(snapshot.parts.items()) if not parts or part in parts] if snapshot.base_holds else []
    rows = _read_folders(spark, path, spec, chosen)
    # Once a merged load's own folder is gone, its replacement can only mask the rows it has left in the base.
    return rows.where(~F.col("batch_id").isin(snapshot.replaced)) if snapshot.replaced else rows


def _later(spark: SparkSession, path: str, spec: TableSpec, snapshot: Snapshot) -> DataFrame:
    return _read_folders(spark, path, spec, [f for _, f in sorted(snapshot.later.items())])


def read_loads(spark: SparkSession, path: str, spec: TableSpec, snapshot: Snapshot | None = None) -> DataFrame:
    """The base and all loads beside it, with ``batch_id``; a filter on it or on the
    partition key skips folders. Without ``snapshot`` the latest version is read."""
    path = path.rstrip("/")
    snapshot = snapshot or CommitLog(spark, path).latest()
    return _base(spark, path, spec, snapshot).unionByName(_later(spark, path, spec, snapshot))


@contextmanager
def held(spark: SparkSession, path: str) -> Iterator[Snapshot]:
    """The latest version, to be read as often as needed: ``expire`` leaves its files alone while the block runs."""
    with CommitLog(spark, path).held() as snapshot:
        yield snapshot


def read_current(spark: SparkSession, path: str, spec: TableSpec, parts: Sequence[str] = (), snapshot: Snapshot | None = None) -> DataFrame:
    """One row per key: the declared version wins, then the latest load.

    ``parts`` limits the read to some partition keys. A key never spans two
    partitions, so nothing outside them needs to be read. A base alone is read as it is: its rows are unique. Beside
    few later rows only those base rows are merged whose keys they hold; the others are never shuffled.
    """
    path = path.rstrip("/")
    log = CommitLog(spark, path)
    snapshot = snapshot or log.latest()
    names = [name for name, _ in spec.columns]
    base, later = _base(spark, path, spec, snapshot, parts), _later(spark, path, spec, snapshot)
    if parts:
        base, later = (df.where(_in_parts(parts)) for df in (base, later))
    base, later = (df.select(*names, "batch_id") for df in (base, later))
    newest = (*spec.version, "batch_id")
    if not snapshot.base_holds:
        return one_per_key(later, spec.keys, newest).select(*names)
    if not snapshot.later:
        return base.select(*names)
    if SMALL_SHARE * log.size(list(snapshot.later.values())) > log.size(list(snapshot.parts.values())):
        return one_per_key(base.unionByName(later), spec.keys, newest).select(*names)
    touched = later.select(*[F.col(k).alias(f"_{k}") for k in spec.keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in spec.keys]
    merged = one_per_key(base.join(touched, same, "left_semi").unionByName(later), spec.keys, newest)
    return base.join(touched, same, "left_anti").select(*names).unionByName(merged.select(*names))


def compact(spark: SparkSession, path: str, spec: TableSpec, upto: int | None = None, file_bytes: int = FILE_BYTES) -> int | None:
    """Merge the loads up to ``upto`` (by default all) into the base; gives the greatest number merged so far.

    Only the partitions that these loads touch are written anew, in files of ``file_bytes`` at most, about, that each hold a range
    of keys, so that a read of few keys opens few of them. Nothing is moved or removed, so readers that started
    earlier are not disturbed, and later loads keep landing in ``path``. ``expire`` removes what the base has
    replaced. Repeating it changes nothing.
    """
    path = path.rstrip("/")
    log = CommitLog(spark, path)
    now = log.latest()
    chosen = {n: f for n, f in now.later.items() if upto is None or n <= upto or n in now.replaced or n in now.merged}
    done = [n for n in now.merged if n not in now.replaced] + [high for _, high in now.forgotten]
    if not chosen:
        return max(done, default=None)
    source = replace(now, loads={n: f for n, f in now.loads.items() if n in chosen or n in now.merged and n not in now.replaced})
    touched: Sequence[str] = ()
    if spec.partition_time is not None and now.base_holds and not now.replaced:
        touched = sorted({p.split("=", 1)[1] for f in chosen.values() for p in log.children(f, f"{PARTITION}=")})
    rows = read_loads(spark, path, spec, source)
    if touched:
        rows = rows.where(_in_parts(touched))
    merged = one_per_key(rows.drop(PARTITION), spec.keys, (*spec.version, "batch_id"))
    folder = f"base={uuid4().hex}"
    sources = {*chosen.values(), *(f for p, f in now.parts.items() if not touched or p in touched)} if now.base_holds else set(chosen.values())
    files = max(spark.sparkContext.defaultParallelism, math.ceil(log.size(sorted(sources)) / file_bytes))
    _write(merged.select(*[name for name, _ in spec.columns], "batch_id"), f"{path}/{folder}", spec, files)
    if spec.partition_time is None:
        written = {WHOLE: folder}
    else:
        written = {p.split("=", 1)[1]: f"{folder}/{p}" for p in log.children(folder, f"{PARTITION}=")}
    kept = {p: f for p, f in now.parts.items() if p not in touched} if touched else {}

    def settle(latest: Snapshot) -> Snapshot:
        if latest.parts != now.parts:
            return latest  # another compaction was first; its base stays, and these loads are merged by the next
        merged_now = {**(now.merged if now.base_holds else {}), **chosen}
        return replace(latest, parts={**kept, **written}, merged=merged_now, forgotten=without(now.forgotten, list(chosen)))

    if not set(written.values()) <= log.commit(settle).folders():
        log.delete(folder)
    return max([*done, *chosen])


def expire(spark: SparkSession, path: str) -> None:
    """Delete what the latest version no longer needs: replaced attempts, older bases, and loads that the base holds.

    Versions that a reader holds keep their files. From then on a load written again replaces its rows in
    the base, but what those rows had superseded does not come back.
    """
    log = CommitLog(spark, path)
    if not log.versions():
        return

    def forget(latest: Snapshot) -> Snapshot:
        if not latest.base_holds:
            return latest
        gone = [n for n in latest.merged if n not in latest.replaced]
        loads = {n: f for n, f in latest.loads.items() if n not in gone}
        return replace(latest, loads=loads, merged={}, forgotten=ranges(list(latest.merged), latest.forgotten))

    latest = log.commit(forget)
    older = {v: log.at(v) for v in log.versions() if v < latest.version}
    spared = log.held_versions()
    for v in older:
        if v not in spared:
            log.delete(f"_commits/{v:020d}.json")
    needed = set(latest.folders())
    for v in spared | log.held_versions():
        needed |= older[v].folders() if v in older else set()
    for folder in sorted({f for snapshot in older.values() for f in snapshot.folders()} - needed):
        log.delete(folder)
