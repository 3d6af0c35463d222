"""Filling missing numbers and leaving out extreme ones, by figures of the whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloupe.functions.columns import col, number, present, require_columns, without_nan
from dataloupe.plans.quantiles import exact_quantiles

FILLS = ("mean", "median", "zero")


def impute(df: DataFrame, fills: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the missing numbers of columns filled, and ``(column, fill, value, n_filled)``.

    ``fills`` maps numeric columns to ``mean``, ``median`` or ``zero``; NULL and NaN are missing. Means and
    exact medians of all columns come from one pass over their cells, and one number per column
    is put back as a literal. Columns filled by mean or median become double, whatever their
    type; with zero the type stays. A column without values stays as it is, with a NULL value in
    the report, whose counts are taken when it is read.
    """
    require_columns(df, *fills)
    unknown = sorted({f for f in fills.values()} - set(FILLS))
    if unknown:
        raise ValueError(f"fills must be of {FILLS}, not {unknown}")
    values = {n: number(df, n) for n in fills}  # refuses other columns
    measured = [n for n, f in fills.items() if f != "zero"]
    found: dict[str, float | None] = {n: 0.0 for n, f in fills.items() if f == "zero"}
    if measured:
        cells = [F.struct(F.lit(n).alias("column"), values[n].alias("value")) for n in measured]
        names = [f"c{i}" for i in range(len(cells))]
        long = df.select(*[c.alias(n) for c, n in zip(cells, names)]).unpivot([], names, "of", "cell")
        long = long.select("cell.*").where(F.col("value").isNotNull())
        facts = exact_quantiles(long, "value", ["column"], {"median": 0.5}, [F.avg("value").alias("mean")])
        told = {r["column"]: r for r in facts.collect()}  # one row per column
        found |= {n: told[n][fills[n]] if n in told else None for n in measured}
    filled = {}
    for n, fill in fills.items():
        kept = without_nan(df, n) if fill == "zero" else values[n]
        filled[n] = F.coalesce(kept, F.lit(found[n]).cast(df.schema[n].dataType if fill == "zero" else "double"))
    rows = [
        F.struct(
            F.lit(n).alias("column"), F.lit(f).alias("fill"), F.lit(found[n]).cast("double").alias("value"),
            (F.count_if(~present(df, n)) if found[n] is not None else F.lit(0).cast("long")).alias("n_filled"),
        )
        for n, f in fills.items()
    ]
    report = df.agg(F.array(*rows).alias("a")).select(F.inline("a"))
    return df.select([filled[n].alias(n) if n in filled else col(n) for n in df.columns]), report


def zscore_filter(df: DataFrame, y: str, limit: float = 3.0) -> DataFrame:
    """The rows whose ``y`` lies within ``limit`` sample standard deviations of the mean, and those
    without a value. Fewer than two values, or values without spread, leave out nothing.

    Spark merges central moments of tasks pairwise, so a small spread around a large mean is kept.
    The two ends are literals, which reach the scan.
    """
    require_columns(df, y)
    if limit <= 0:
        raise ValueError("the limit must be positive")
    value = number(df, y)
    mean, spread = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if not spread or spread != spread:
        return df
    inside = (col(y) >= F.lit(mean - limit * spread)) & (col(y) <= F.lit(mean + limit * spread))
    return df.where(~present(df, y) | inside)
