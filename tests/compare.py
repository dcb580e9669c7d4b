"""Order-insensitive comparison of a Spark result with SQL over the same files."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(file))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


_SPARK_TO_SQL = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def type_mismatches(df, relation) -> list[str]:
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types)))
    out = []
    for name, spark_type in ours.items():
        want = _SPARK_TO_SQL.get(spark_type, spark_type.upper())
        if theirs.get(name) != want:
            out.append(f"{name}: spark {spark_type}, sql {theirs.get(name)}")
    return out


def differences(df, con, sql) -> str | None:
    relation = con.sql(sql)
    ours_cols, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    their_cols, theirs = rows_of(relation.columns, relation.fetchall())
    if ours_cols != their_cols:
        return f"columns {ours_cols} vs {their_cols}"
    if ours != theirs:
        only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"rows {sum(ours.values())} vs {sum(theirs.values())}; only spark {only_ours}; only sql {only_theirs}"
    types = type_mismatches(df, con.sql(sql))
    return f"types {types}" if types else None
