"""Filled and filtered columns beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators import repair as ops

_GAPPED = "(SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)"


def _filled(figure: str) -> str:
    return f"""
WITH g AS {_GAPPED} SELECT event_id, {r(f"coalesce(v, (SELECT {figure}(v) FROM g))", "v")} FROM g"""


def _gapped(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))


@query(_filled("median"))
def impute_median(t: Tables) -> DataFrame:
    return ops.impute(_gapped(t), {"v": "median"})[0]


@query(_filled("avg"))
def impute_mean(t: Tables) -> DataFrame:
    return ops.impute(_gapped(t), {"v": "mean"})[0]


@query(f"""
WITH g AS {_GAPPED} SELECT 'v' AS "column", 'zero' AS fill, CAST(0 AS DOUBLE) AS value, count(*) - count(v) AS n_filled FROM g""")
def impute_report(t: Tables) -> DataFrame:
    return ops.impute(_gapped(t), {"v": "zero"})[1]


@query(f"""
WITH s AS (SELECT avg(v) AS m, stddev_samp(v) AS d FROM {_GAPPED})
SELECT event_id, {r("v", "v")} FROM {_GAPPED}, s WHERE v IS NULL OR abs(v - m) <= 2 * d""")
def zscore_filter(t: Tables) -> DataFrame:
    return ops.zscore_filter(_gapped(t), "v", 2.0)
