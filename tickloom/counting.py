"""Row counts taken while rows are written, so that nothing is computed twice."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, Observation]:
    """The same rows, and the observation that counts them (or those ``which`` holds for) once they are written."""
    rows = Observation()
    one = F.lit(1) if which is None else F.when(which, F.lit(1))
    return df.observe(rows, F.count(one).alias("rows")), rows


def rows_written(rows: Observation) -> int:
    """The count, once the write has finished.

    Where the planner finds at run time that nothing can come out, it drops the
    counting step together with its input; the observation then has no values.
    """
    try:
        return int(rows.get["rows"])
    except Py4JJavaError as error:
        # The observation holds a row without a schema; anything else is a real failure.
        if error.java_exception.getClass().getName() == "java.lang.AssertionError":
            return 0
        raise
