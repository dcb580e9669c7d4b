"""Session settings shared by every job.

Master, memory and executor counts belong to the deployment, so they are never
set here.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SESSION_CONF = {
    # Raw times carry no zone; parsing and bucketing must not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    # Bad values become null through try_cast, never through lenient casts.
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning: coalesce small shuffle partitions, split skewed ones
    # even where the split costs one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles stay spread over the cores: a write into many folders costs
    # per file, not per byte, and must not end up in one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Folders are listed in parallel, but not with one task per hour folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "128",
    # Pack many small raw files into 128 MB scan tasks.
    "spark.sql.files.maxPartitionBytes": "134217728",
    "spark.sql.files.openCostInBytes": "10485760",
}


def session(app_name: str = "tickloom", **extra: str) -> SparkSession:
    """Build (or reuse) a session with the settings above; ``extra`` wins."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_session_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings on a session somebody else created."""
    for key, value in SESSION_CONF.items():
        if not key.startswith("spark.sql.files."):
            spark.conf.set(key, value)
    return spark


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping: dict[str, tuple[int, str | None]] = {}  # by session: blocks that run, and what the setting was before them
_dropping_lock = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While the block runs, the shuffle files of a write go when it ends, not when the driver next collects its garbage.

    Meant for writes, which are planned anew each time: a frame that is collected twice would shuffle twice.
    """
    owner = spark._jsparkSession.sessionUUID()
    with _dropping_lock:
        running, before = _dropping.get(owner, (0, None))
        if not running:
            before = spark.conf.get(_DROP_SHUFFLES, None)
            spark.conf.set(_DROP_SHUFFLES, "true")
        _dropping[owner] = running + 1, before
    try:
        yield
    finally:
        with _dropping_lock:
            running, before = _dropping.pop(owner)
            if running > 1:
                _dropping[owner] = running - 1, before
            elif before is None:
                spark.conf.unset(_DROP_SHUFFLES)
            else:
                spark.conf.set(_DROP_SHUFFLES, before)
