"""Directories for tables and checkpoints that must outlive an executor."""

from __future__ import annotations

import os
import re
import tempfile
import time
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])

_local_base: str | None = None


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package, wherever the application was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or set as checkpoint folder.

    Only a single-machine session may fall back to a temporary folder: on a
    cluster such a folder is invisible to the other machines.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="tickloom-")
    return _local_base


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses; it goes when the application ends."""
    base = shared_base(spark)
    owner = f"{spark.sparkContext.applicationId} {base}"
    if owner not in _scratch:
        _scratch[owner] = f"{base}/scratch-{uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(_scratch[owner])
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{_scratch[owner]}/{label}-{uuid4().hex}"


_SCRATCH = re.compile(r"scratch-[0-9a-f]{32}$")


def sweep(spark: SparkSession, older_than_seconds: float) -> int:
    """Delete what applications that were killed have left below the shared folder; gives the number of folders.

    Only the folders of whole applications go, and only those that got nothing new for so long: choose more than any
    application runs.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (time.time() - older_than_seconds) * 1000
    old = [f.getPath() for f in (files.listStatus(base) if files.exists(base) else []) if f.getModificationTime() < before and _SCRATCH.match(f.getPath().getName())]
    for place in old:
        files.delete(place, True)
    return len(old)
