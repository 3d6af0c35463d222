"""Keeping the findings worth reporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, fresh, require_columns
from dataloupe.plans.joins import lookup_join

# Fixed value: the quality and strategic score from which a finding is good.
GOOD = 6


def finding_outcome(df: DataFrame) -> Column:
    """'drop', 'retry' or 'complete' for a row of scored findings.

    Columns read: ``strategic_score`` and ``is_spurious``; if present, ``suggested_tweak``,
    ``tweak_repeated``, and ``color_by``, ``facet_by``, ``x``, ``y`` and ``chart_color``. A finding
    that asks for a tweak it already had stands as it is if its strategic score is good;
    spurious ones go, and so do requests to colour by x or y, or to split a chart without
    colour by x or y; other tweak requests are for another round.
    """
    require_columns(df, "strategic_score", "is_spurious")
    spurious = F.coalesce(col("is_spurious"), F.lit(False))
    if "suggested_tweak" not in df.columns:
        return F.when(spurious, "drop").otherwise("complete")
    asks = col("suggested_tweak").isNotNull()
    again = F.lit(False)
    if "tweak_repeated" in df.columns:
        again = F.coalesce(col("tweak_repeated"), F.lit(False))

    def on_axis(wanted: str) -> Column:
        """Whether the column that a tweak wants is x or y; a missing one equals a missing y."""
        axes = [n for n in ("x", "y") if n in df.columns]
        tests = [col(wanted).eqNullSafe(col(n)) for n in axes] if wanted in df.columns else []
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    plain = col("chart_color").isNull() if "chart_color" in df.columns else F.lit(True)
    coloured = (col("suggested_tweak") == "color_by_segment") & on_axis("color_by")
    split = (col("suggested_tweak") == "facet_grid") & plain & on_axis("facet_by")
    return (
        F.when(again & (col("strategic_score") < GOOD), "drop")
        .when(again, "complete")
        .when(spurious, "drop")
        .when(asks & (coloured | split), "drop")
        .when(asks, "retry")
        .otherwise("complete")
    )


def with_tweak_history(findings: DataFrame, chart: list[str], round_col: str) -> DataFrame:
    """``findings`` with ``tweak_repeated``: whether an earlier round of the same chart, named by
    the columns ``chart``, already asked for the same tweak and did not drop out.

    The first round with a (chart, tweak) is an aggregate combined on the map side and joined
    back null-safely. A round that was dropped or repeated leaves no trace in the history,
    and later rounds only repeat the first, so the first one that stayed decides.
    """
    require_columns(findings, *chart, round_col, "suggested_tweak")
    keys = [*chart, "suggested_tweak"]
    plain = findings.drop("tweak_repeated")
    stayed = plain.where(finding_outcome(plain) != "drop")
    names = [f"_k{i}" for i in range(len(keys))]
    first = stayed.groupBy(*[col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.min(col(round_col)).alias("_first")
    )
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    joined = plain.join(first, same, "left")
    repeated = F.coalesce(F.col("_first") < col(round_col), F.lit(False))
    return joined.select(*map(col, plain.columns), repeated.alias("tweak_repeated"))


def triage_findings(findings: DataFrame, run_col: str) -> DataFrame:
    """The complete findings of each run with both scores at 6 or more; all complete
    findings of a run that has no such row. Rows without a run are one run.

    Whether a run has a good finding is one flag per run, aggregated on the map side and
    joined back, so a run of any size stays spread over many tasks.
    """
    require_columns(findings, run_col, "quality_score", "strategic_score")
    complete = findings.where(finding_outcome(findings) == "complete")
    good = F.coalesce(
        (col("quality_score") >= GOOD) & (col("strategic_score") >= GOOD), F.lit(False)
    )
    # A struct is never null itself, so that rows without a run meet in the join.
    run, some, rows = (fresh(n, *findings.columns) for n in ("_run", "_any_good", "_rows"))
    flags = complete.groupBy(F.struct(col(run_col)).alias(run)).agg(
        F.max(F.when(good, True)).alias(some), F.count(F.lit(1)).alias(rows)
    )
    flags = flags.where(F.col(some))
    with_run = complete.withColumn(run, F.struct(col(run_col)))
    joined = lookup_join(with_run, flags, [run], rows, "left")
    kept = joined.where(good | F.col(some).isNull())
    return kept.select([col(n) for n in findings.columns])


def unfinished_runs(findings: DataFrame, run_col: str) -> DataFrame:
    """``(run)``: the runs that end without a complete finding, which get a plain summary."""
    require_columns(findings, run_col)
    done = F.max((finding_outcome(findings) == "complete").cast("int"))
    return findings.groupBy(col(run_col)).agg(done.alias("_done")).where("_done = 0").select(col(run_col))
