"""Registration of queries and small helpers for both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dataloupe.functions.columns import col, is_floating

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 4


class Tables:
    """The parquet tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str, digits: int = DIGITS):
    """Register a function of ``Tables`` under its own name, its doubles rounded."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(Tables(spark, folder)), digits)

        QUERIES[name] = run
        SQL[name] = sql
        return build

    return register


def nudge(digits: int) -> float:
    """A thousandth of the last digit. Means of cents over 8, 24, ... rows lie exactly between
    two rounded values; moved by this much, both engines round them the same way."""
    return 10.0 ** -(digits + 3)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    near = F.lit(nudge(digits))
    floats = {n: F.round(col(n) + near, digits) for n in df.columns if is_floating(df, n)}
    return df.withColumns(floats) if floats else df


def r(expression: str, alias: str, digits: int = DIGITS) -> str:
    """``round(expression) AS alias`` as double."""
    return f"round(CAST({expression} AS DOUBLE) + {nudge(digits)}, {digits}) AS {alias}"


def quartiles(y: str) -> str:
    return ", ".join(
        f"quantile_cont({y}, {p}) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
    )
