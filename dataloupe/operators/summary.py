"""Concentration of a category and the three-sentence summary of a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import (
    col, is_numeric, is_text, present, require_columns, without_nan,
)
from dataloupe.operators.outliers import iqr_outliers, numeric_facts, variation
from dataloupe.plans.cardinality import short_key

# Share in % that means imbalance, entropy above which a column is fragmented.
IMBALANCE = 50
FRAGMENTED = 0.7


def _category_facts(df: DataFrame, name: str) -> Row:
    """All concentration figures in one aggregate over the value counts, as one row.

    With N rows in all, -sum(p log2 p) is log2 N - sum(n log2 n) / N, so neither a
    window nor a second pass over the values is needed. Long texts are counted by digest
    and only the winner is looked up.
    """
    require_columns(df, name)
    text = is_text(df, name)
    key = short_key(name) if text else without_nan(df, name)
    values = df.where(present(df, name)).select(key.alias("_value"))
    counts = values.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("unique_count"),
        F.min(F.struct((-F.col("_n")).alias("n"), "_value")).alias("top"),
        F.sum(F.col("_n") * F.log2("_n")).alias("spread"),
    )
    bits = F.greatest(F.log2("rows") - F.col("spread") / F.col("rows"), F.lit(0.0))
    widest = F.when(F.col("unique_count") > 1, F.log2("unique_count")).otherwise(1.0)
    share = -F.col("top")["n"] / F.col("rows") * 100
    row = facts.select(
        F.col("top")["_value"].cast("string").alias("top_class"),
        share.alias("top_share"),
        "unique_count",
        (share > IMBALANCE).alias("is_imbalanced"),
        (bits / widest).alias("entropy"),
    ).first()
    top = row["top_class"]
    if text and top is not None and len(top) == 64:
        full = df.where(short_key(name) == F.lit(top)).select(col(name)).first()[0]
        row = Row(**{**row.asDict(), "top_class": full})
    return row


def concentration(df: DataFrame, name: str) -> DataFrame:
    """One row ``(top_class, top_share, unique_count, is_imbalanced)``; the share is in %,
    ties go to the smaller value (of texts with 64 and more characters: the smaller digest)."""
    schema = "top_class string, top_share double, unique_count long, is_imbalanced boolean"
    facts = _category_facts(df, name)
    names = ("top_class", "top_share", "unique_count", "is_imbalanced")
    return df.sparkSession.createDataFrame([tuple(facts[n] for n in names)], schema)


def normalized_entropy(df: DataFrame, name: str) -> DataFrame:
    """One row ``(unique_count, entropy)``: 0 for a single class, 1 for equal shares."""
    facts = _category_facts(df, name)
    return df.sparkSession.createDataFrame(
        [(facts["unique_count"], facts["entropy"])], "unique_count long, entropy double"
    )


def forensic_summary(df: DataFrame, metric: str) -> DataFrame:
    """Three rows ``(act, text)`` about the metric: baseline, divergence, lever.

    The figures are a single row, so the sentences are put together on the driver.
    """
    require_columns(df, metric)
    if is_numeric(df, metric):
        known = numeric_facts(df, metric).select("*", variation()).first()
        if known["n"] == 0:
            raise ValueError(f"column {metric!r} has no values")
        fence = iqr_outliers(df, metric, known).first()
        count, limit = fence["outlier_count"], fence["upper_fence"]
        return _acts(
            df,
            metric,
            wording.NUMERIC_ACTS,
            (known["median"], _shown(known["cv"])),
            (count, fence["outlier_impact_pct"], _shown(known["kurtosis"])),
            (count, limit, limit),
        )
    facts = _category_facts(df, metric)
    if not facts["unique_count"]:
        raise ValueError(f"column {metric!r} has no values")
    top, entropy, unique = facts["top_class"], facts["entropy"], facts["unique_count"]
    status = "fragmented" if entropy > FRAGMENTED else "concentrated"
    return _acts(
        df,
        metric,
        wording.CATEGORICAL_ACTS,
        (top, facts["top_share"]),
        (status, entropy, unique),
        (top, top, unique),
    )


def _shown(value: float | None) -> float:
    return float("nan") if value is None else value


def _acts(df: DataFrame, metric: str, texts: tuple[str, ...], *values: tuple) -> DataFrame:
    acts = [
        (no, wording.template(text, metric) % args)
        for no, (text, args) in enumerate(zip(texts, values), start=1)
    ]
    return df.sparkSession.createDataFrame(acts, "act int, text string")
