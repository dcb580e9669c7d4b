"""Raw topic to published table: the batch jobs.

Every dataset runs the same chain; ``tickloom.specs`` holds what differs.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tickloom.counting import counted, rows_written
from tickloom.functions.columns import TECHNICAL_COLUMNS, drop_technical, fill_nulls, trim_strings
from tickloom.operators.latest import keyed_replace, one_per_key
from tickloom.sinks.tables import publish
from tickloom.sources.lake import KEYS, carried, is_corrupt, scan_topic, split_corrupt
from tickloom.specs import DATASETS, DatasetSpec
from tickloom.workspace import shared_dir

logger = logging.getLogger(__name__)


def typed_rows(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Trim, type and fill; one projection once the optimizer has merged them."""
    return (
        raw.transform(trim_strings).transform(spec.transform).transform(fill_nulls, numeric=spec.fill_numeric)
    )


def _without_label(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    # Technical columns that do not decide between rows need not be shuffled.
    return df.drop(*[c for c in TECHNICAL_COLUMNS if c not in spec.stamp])


def normalize(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Typed rows, one per business key, without the technical columns.

    Nulls are filled before the keys are compared, so rows that lack a key value
    share its default.
    """
    rows = _without_label(typed_rows(raw, spec), spec)
    return one_per_key(rows, spec.keys, spec.stamp).transform(drop_technical)


def normalize_loads(loads: list[tuple[DataFrame, DatasetSpec]]) -> DataFrame:
    """Several feeds of one table, later ones superseding earlier ones.

    The feeds are typed separately and resolved together: one shuffle in all.
    """
    spec = loads[-1][1]
    typed = [_without_label(typed_rows(raw, s), s) for raw, s in loads]
    return keyed_replace(typed, spec.keys, "_load", spec.stamp).transform(drop_technical)


@dataclass(frozen=True)
class JobResult:
    """Rows published, unreadable records met, and whether those were kept in quarantine."""

    rows: int
    quarantined: bool = False
    corrupt_rows: int = 0


def run(
    spark: SparkSession,
    spec: DatasetSpec,
    lake_root: str,
    warehouse_root: str,
    batch_id: int,
    hour: str | None = None,
    quarantine_root: str | None = None,
    scan: Callable[..., DataFrame] = scan_topic,
) -> JobResult:
    """Publish one hour of a topic, or all of it.

    ``scan`` reads the lake: ``scan_topic`` any folder of JSON files,
    ``scan_archive`` what the archive stream wrote.

    An empty folder writes nothing. Failures are raised, not logged away. Rows and
    unreadable records are counted while the rows are written; the lake is parsed once more only if
    there are unreadable records to keep under ``quarantine_root``. Without one they are counted and logged.
    """
    options = {"any_case": spec.any_case, "with_hour": True} if scan is scan_topic else {}
    raw = scan(spark, lake_root, spec.topic, hour, spec.raw_schema, **options)
    if spec.any_case:
        # Fields of any spelling are looked up once; what follows reads the parsed records.
        parsed = shared_dir(spark, f"parsed-{spec.topic}")
        raw.write.parquet(parsed)
        raw = spark.read.schema(raw.schema).parquet(parsed)
    if raw.isEmpty():
        logger.info("%s: no data under %s", spec.topic, hour or "any hour")
        return JobResult(0)
    if spec.any_case:
        # Only what some record carries is filled where it is null; the rest stays null in the table.
        held = carried(raw, spec.optional)
        raw = raw.drop(KEYS, *[c for c in spec.optional if c not in held])
    watched, unreadable = counted(raw, is_corrupt(raw))
    readable, _ = split_corrupt(watched)
    rows = publish(normalize(readable, spec), warehouse_root, spec.table, batch_id)
    corrupt_rows = rows_written(unreadable)
    quarantined = quarantine_root is not None and corrupt_rows > 0
    if quarantined:
        _, corrupt = split_corrupt(raw)
        corrupt.write.mode("overwrite").json(f"{quarantine_root.rstrip('/')}/{spec.topic}/batch_id={batch_id}")
    if corrupt_rows:
        logger.warning("%s: %d unreadable records, %s", spec.topic, corrupt_rows, "kept" if quarantined else "not kept")
    logger.info("%s: %d rows into %s", spec.topic, rows, spec.table)
    return JobResult(rows, quarantined, corrupt_rows)


def run_topic(spark: SparkSession, topic: str, lake_root: str, warehouse_root: str, batch_id: int, **kwargs) -> JobResult:
    """``run`` by topic name."""
    return run(spark, DATASETS[topic], lake_root, warehouse_root, batch_id, **kwargs)
