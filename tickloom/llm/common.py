"""What the operators share: tables on the shared folder, worker set-up, connected components."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.workspace import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = 2000  # rows handed to Python at once
BATCH_BYTES = 2 << 20  # and bytes; one longer text is a batch of its own


#: Workers live through many stages: large arrays go back to the system when they are freed.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep their batches and their memory small."""
    env = spark.sparkContext.environment
    env.update({k: v for k, v in WORKER_MEMORY.items() if k not in env})
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


_remembered: list[dict] = []


def remembered() -> dict:
    """Where a worker keeps things from task to task, until tasks of another operator need the room."""
    _remembered.append({})
    return _remembered[-1]


def forget() -> None:
    """Before a task that uses nothing of the kind: what tasks of other operators have left goes, and free memory back to the system."""
    for kept in _remembered:
        kept.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors cost nothing that was done."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(id, component)``: the smallest id that each id of ``edges(a, b)`` reaches.

    Alternates linking every larger neighbour to the smallest one with linking
    every smaller neighbour to it, until no edge changes. The rounds grow
    with the logarithm of the longest chain. Every neighbourhood is reduced to
    its minimum before the shuffle, so a hub is never gathered in one task.
    Every round is written, so that no lineage grows.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stored(links, label)
    for _ in range(most_rounds):
        # Large star: every larger neighbour is linked to the smallest id around.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, label)
        # Small star: every smaller neighbour, and the id itself, to the smallest.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = stored(small.union(lowest.select("a", F.col("m").alias("b"))).distinct(), label)
        changed = small.exceptAll(links).isEmpty() and small.count() == links.count()
        links = small
        if changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
