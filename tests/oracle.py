"""Running a registered query beside its SQL and comparing the two tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type names as DuckDB prints them.
TYPE_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty if the tables agree."""
    names = sorted(spark_df.columns)
    found = con.execute(sql)
    described = {d[0]: str(d[1]).upper() for d in found.description}
    rows = found.fetchall()
    order = [d[0] for d in found.description]
    if sorted(order) != names:
        return [f"columns {names} != {sorted(order)}"]
    out = []
    types = dict(spark_df.dtypes)
    for n in names:
        kind = {"NUMBER": None, "STRING": "VARCHAR"}.get(described[n], described[n])
        if kind is not None and TYPE_NAMES.get(types[n], types[n]) != kind and kind != "DATETIME":
            out.append(f"type of {n}: {types[n]} != {kind}")
    want = sorted(tuple(_cell(r[order.index(n)]) for n in names) for r in rows)
    got = sorted(tuple(_cell(r[n]) for n in names) for r in spark_df.collect())
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        out.append(f"{names}: {len(extra)} rows only in Spark, e.g. {extra[:2]}; SQL has {missing[:2]}")
    return out
