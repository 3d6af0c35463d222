"""Outliers per group: detection, evidence and removal; fences and dispersion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import col, fresh, is_numeric, number, present, require_columns
from dataloupe.plans.joins import lookup_join
from dataloupe.plans.quantiles import exact_quantiles
from dataloupe.plans.storage import materialize

# The clip level, and how far the maximum must exceed it.
CLIP_LEVEL = 0.99
TRIGGER = 3
FENCE = 1.5

INFINITY = float("inf")

EVIDENCE_SCHEMA = (
    "`group` string, n long, p99 double, max double, outlier_count long, outlier_sum double, "
    "total_sum double, impact_pct double, original_max double, clipped_at double, "
    "hidden_impact_pct double, summary string"
)


def clip_thresholds(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """``(_group, n, p99, max, sum)`` of the groups whose maximum exceeds 3 x p99 > 0.

    Without ``by`` there is one group, without a ``_group`` column.
    """
    rows = _values(df, y, by)
    stats = exact_quantiles(rows, "_y", ["_group"] if by else [], {"p99": CLIP_LEVEL})
    return stats.where((F.col("p99") > 0) & (F.col("max") > TRIGGER * F.col("p99")))


def _values(df: DataFrame, y: str, by: str | None) -> DataFrame:
    require_columns(df, y, by)
    kept = df.where(present(df, y))
    if by is None:
        return kept.select(number(df, y).alias("_y"))
    return kept.where(present(df, by)).select(col(by).alias("_group"), number(df, y).alias("_y"))


def outliers_by_group(
    df: DataFrame, y: str, by: str | None, thresholds: DataFrame | None = None
) -> DataFrame:
    """Evidence rows, one per group that triggers; a non-numeric ``y`` gives none.

    Outliers are values above their group's p99; ``impact_pct`` is their share of the
    group's sum, 0 unless that sum is positive. Rounded columns stand next to the exact ones.
    """
    require_columns(df, y, by)
    if not is_numeric(df, y):
        return df.sparkSession.createDataFrame([], EVIDENCE_SCHEMA)
    thresholds = clip_thresholds(df, y, by) if thresholds is None else thresholds
    keys = ["n", "p99", "max", "sum"]
    if by is None:
        found = thresholds.first()
        if found is None:
            return df.sparkSession.createDataFrame([], EVIDENCE_SCHEMA)
        above = _above(df, y, found["p99"])
        hidden = above.agg(_count(), F.sum("_y").alias("outlier_sum")).select(
            F.lit(wording.GLOBAL_GROUP).alias("group"),
            F.lit(found["n"]).cast("long").alias("n"),
            *[F.lit(found[k]).alias(k) for k in keys[1:]],
            "outlier_count",
            "outlier_sum",
        )
    else:
        joined = lookup_join(_values(df, y, by), thresholds, ["_group"], "n")
        hidden = (
            joined.where(F.col("_y") > F.col("p99"))
            .groupBy("_group", *keys)
            .agg(_count(), F.sum("_y").alias("outlier_sum"))
            .withColumnRenamed("_group", "group")
        )
    text = wording.template(wording.OUTLIER_SUMMARY, y)
    return evidence_columns(hidden, lambda *args: F.format_string(text, *args))


def evidence_columns(hidden: DataFrame, summary: Callable[..., Column], *more: str) -> DataFrame:
    """Evidence from ``(group, n, p99, max, sum, outlier_count, outlier_sum)``; ``summary`` puts the
    sentence together from count, maximum and share."""
    share = F.when(F.col("sum") > 0, F.col("outlier_sum") / F.col("sum") * 100).otherwise(0.0)
    return hidden.select(
        *more,
        F.col("group").cast("string").alias("group"),
        "n",
        "p99",
        "max",
        "outlier_count",
        "outlier_sum",
        F.col("sum").alias("total_sum"),
        share.alias("impact_pct"),
        F.bround("max", 2).alias("original_max"),
        F.bround("p99", 2).alias("clipped_at"),
        F.bround(share, 1).alias("hidden_impact_pct"),
        summary("outlier_count", "max", share).alias("summary"),
    )


def outliers_global(df: DataFrame, y: str) -> DataFrame:
    """The same for the whole column as one group called ``Global``."""
    return outliers_by_group(df, y, None)


def _count() -> Column:
    return F.count(F.lit(1)).alias("outlier_count")


def _above(df: DataFrame, y: str, limit: float) -> DataFrame:
    """Values above a known number; the plain comparison reaches the parquet scan."""
    return df.where((col(y) > F.lit(limit)) & present(df, y)).select(number(df, y).alias("_y"))


def clip_outliers(
    df: DataFrame, y: str, by: str | None = None, thresholds: DataFrame | None = None
) -> DataFrame:
    """Drop rows above the p99 of their own triggered group; every other row stays,
    also those without a value or a group.

    The limits of groups are joined, whatever the type of the group and the number of limits;
    a single limit is a plain comparison.
    """
    require_columns(df, y, by)
    if not is_numeric(df, y):
        return df
    if by is None:
        thresholds = clip_thresholds(df, y) if thresholds is None else thresholds
        limit = thresholds.select("p99").scalar()  # one row or none
        return df.where(~(present(df, y) & (col(y) > F.coalesce(limit, F.lit(INFINITY)))))
    if thresholds is None:
        thresholds = materialize(clip_thresholds(df, y, by))
    group, limit, rows = (fresh(n, *df.columns) for n in ("_group", "_limit", "_rows"))
    limits = thresholds.select(
        F.col("_group").alias(group), F.col("p99").alias(limit), F.col("n").alias(rows)
    )
    joined = lookup_join(df.withColumn(group, col(by)), limits, [group], rows, "left")
    inside = F.col(limit).isNull() | ~present(df, y) | (col(y) <= F.col(limit))
    return joined.where(inside).select([col(n) for n in df.columns])


LEVELS = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def numeric_facts(
    df: DataFrame, y: str, levels: tuple[str, ...] = tuple(LEVELS), moments: bool = True
) -> DataFrame:
    """The quartiles asked for, moments and sum of one column: one row, lazy."""
    rows = _values(df, y, None)
    extra = [
        F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("std"),
        F.kurtosis("_y").alias("kurtosis"),
    ]
    asked = {n: LEVELS[n] for n in levels}
    return exact_quantiles(rows, "_y", [], asked, extra if moments else None)


def iqr_outliers(df: DataFrame, y: str, facts: Row | None = None) -> DataFrame:
    """One row ``(q1, q3, upper_fence, outlier_count, outlier_impact_pct)``.

    Only the upper fence q3 + 1.5 IQR counts. The quartiles are read first, by one query, so that
    the fence is a literal in the scan that counts, and row groups below it are skipped.
    """
    facts = facts or numeric_facts(df, y, ("q1", "q3"), moments=False).first()
    if facts["n"] == 0:
        nothing = F.lit(None).cast("double")
        return df.sparkSession.range(1).select(
            *[nothing.alias(n) for n in ("q1", "q3", "upper_fence")],
            F.lit(0).cast("long").alias("outlier_count"),
            F.lit(0.0).alias("outlier_impact_pct"),
        )
    fence = facts["q3"] + FENCE * (facts["q3"] - facts["q1"])
    hidden = _above(df, y, fence).agg(_count(), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("s"))
    impact = F.col("s") / F.lit(facts["sum"]) * 100 if facts["sum"] else F.lit(0.0)
    return hidden.select(
        F.lit(facts["q1"]).alias("q1"),
        F.lit(facts["q3"]).alias("q3"),
        F.lit(fence).alias("upper_fence"),
        "outlier_count",
        impact.alias("outlier_impact_pct"),
    )


def dispersion(df: DataFrame, y: str) -> DataFrame:
    """One row ``(median, mean, cv, kurtosis)``; kurtosis is the excess of the population. Lazy."""
    return numeric_facts(df, y, ("median",)).select("median", "mean", variation(), "kurtosis")


def variation() -> Column:
    """Standard deviation by mean, 0 if that is 0."""
    ratio = F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))
    return F.when((F.col("mean") == 0) & F.col("std").isNotNull(), 0.0).otherwise(ratio).alias("cv")
