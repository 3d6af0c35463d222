"""Ranking categories and folding the long tail into one label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import col, fresh, number, present, quoted, require_columns
from dataloupe.plans.ordering import part_offsets, range_parts
from dataloupe.plans.storage import materialize

# Share of the total and number of labels at which the list of tops ends.
COVERAGE = 0.9
MAX_K = 12


def category_totals(df: DataFrame, cat: str, val: str) -> DataFrame:
    """``(cat, total)``: sum per category; rows without a category are left out."""
    require_columns(df, cat, val)
    rows = df.where(present(df, cat)).select(col(cat), number(df, val).alias(fresh("_y", cat)))
    total = F.coalesce(F.sum(fresh("_y", cat)), F.lit(0.0))
    return rows.groupBy(quoted(cat)).agg(total.alias(fresh("total", cat)))


def _totals(df: DataFrame, cat: str, val: str) -> DataFrame:
    """The same under the names ``_cat`` and ``total``."""
    found = category_totals(df, cat, val)
    return found.toDF("_cat", "total")


def category_pareto(df: DataFrame, cat: str, val: str) -> DataFrame:
    """``(cat, total, rank, cum_share, gap_ratio)`` for every category, largest first.

    ``gap_ratio`` is the total divided by the next one. The categories are range-partitioned by
    total, ranked and summed inside each part, and shifted by the sums of the earlier parts.
    Figures whose name the category column has are underscored.
    """
    parts = range_parts(_totals(df, cat, val), [F.desc("total"), F.asc("_cat")])
    offsets = part_offsets(parts, {"_rank": F.lit(1).cast("long"), "_sum": F.col("total")})
    heads = parts.groupBy("_part").agg(F.max("total").alias("_head"), F.sum("total").alias("_whole"))
    following = W.partitionBy(F.lit(0)).orderBy("_part")
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    edges = offsets.join(heads, "_part").select(
        "_part",
        "_rank",
        "_sum",
        F.lead("_head").over(following).alias("_head"),
        F.sum("_whole").over(W.partitionBy(F.lit(0))).alias("_grand"),
    )
    inside = W.partitionBy("_part").orderBy("_row")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    ranked = parts.join(F.broadcast(edges), "_part").select(
        "_cat",
        "total",
        (F.col("_rank") + F.col("_row") + 1).alias("rank"),
        (F.col("_sum") + F.sum("total").over(so_far)).alias("_reached"),
        F.coalesce(F.lead("total").over(inside), F.col("_head")).alias("_next"),
        "_grand",
    )
    return ranked.select(
        F.col("_cat").alias(cat),
        F.col("total").alias(fresh("total", cat)),
        F.col("rank").alias(fresh("rank", cat)),
        F.try_divide(F.col("_reached"), F.col("_grand")).alias(fresh("cum_share", cat)),
        F.try_divide(F.col("total"), F.col("_next")).alias(fresh("gap_ratio", cat)),
    )


def top_categories(
    df: DataFrame, cat: str, val: str, coverage: float = COVERAGE, max_k: int = MAX_K
) -> list:
    """The leading categories: up to the first rank that reaches ``coverage`` of the
    total, at most ``max_k`` of them. Only ``max_k`` rows and the grand total reach the driver."""
    totals = materialize(_totals(df, cat, val))
    tops = totals.orderBy(F.desc("total"), F.asc("_cat")).limit(max_k).collect()
    grand = totals.agg(F.sum("total")).first()[0]
    names, reached = [], 0.0
    for name, total in tops:
        names.append(name)
        reached += total
        if grand and reached / grand >= coverage:
            break
    return names


def top_k_others(
    df: DataFrame, cat: str, val: str, coverage: float = COVERAGE, max_k: int = MAX_K
) -> DataFrame:
    """``df`` with every value of ``cat`` outside the top list, and NULL, turned into 'Others'."""
    tops = top_categories(df, cat, val, coverage, max_k)
    return df.withColumn(cat, F.when(col(cat).isin(tops), col(cat)).otherwise(wording.OTHERS))
