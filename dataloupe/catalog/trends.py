"""Means, trends and counts over time."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators import battery, charts as ops

_MEAN = ", ".join([
    r("avg({y})", "mean"),
    r("avg({y}) - 1.96 * stddev_samp({y}) / sqrt(count(*))", "ci_low"),
    r("avg({y}) + 1.96 * stddev_samp({y}) / sqrt(count(*))", "ci_high"),
    "count(*) AS n",
])


def mean_sql(table: str, keys: str, y: str) -> str:
    return f"SELECT {keys}, {_MEAN.format(y=y)} FROM {table} GROUP BY ALL"


@query(mean_sql("orders", "o_orderpriority", "o_totalprice"))
def bar_mean(t: Tables) -> DataFrame:
    return ops.bar_mean(t.orders, "o_orderpriority", "o_totalprice")


@query(mean_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice"))
def bar_mean_by_hue(t: Tables) -> DataFrame:
    return ops.bar_mean(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus")


@query(mean_sql("orders", "o_orderdate", "o_totalprice"))
def line_mean(t: Tables) -> DataFrame:
    return ops.line_mean(t.orders, "o_orderdate", "o_totalprice")


@query(mean_sql("lineitem", "l_shipdate, l_linestatus", "l_extendedprice"))
def line_mean_by_hue(t: Tables) -> DataFrame:
    return ops.line_mean(t.lineitem, "l_shipdate", "l_extendedprice", "l_linestatus")


@query(f"""
SELECT l_shipdate, {r("avg(l_extendedprice)", "y_mean")}, {r("avg(nullif(l_discount, 0))", "y2_mean")}
FROM lineitem GROUP BY 1""")
def twin_line(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("rate", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return ops.twin_line(rows, "l_shipdate", "l_extendedprice", "rate")


def _rolling(table: str, x: str, y: str, window: int, by: str = "") -> str:
    split = f"PARTITION BY {by}" if by else ""
    shown = f"{by}, " if by else ""
    return f"""
SELECT {shown}{x}, {r(y, y)}, {r(f"avg({y}) OVER (w ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)", "rolling_y")},
       CAST({window} AS INTEGER) AS "window" FROM {table} WINDOW w AS ({split} ORDER BY {x}, {y})"""


_DAILY = "(SELECT o_orderdate, avg(o_totalprice) AS day_mean FROM orders GROUP BY 1)"


@query(_rolling(_DAILY, "o_orderdate", "day_mean", 30))
def rolling_mean_daily(t: Tables) -> DataFrame:
    daily = t.orders.groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("day_mean"))
    return ops.rolling_mean(daily, "o_orderdate", "day_mean", span_days=2404)


@query(_rolling("orders", "o_orderdate", "o_totalprice", 14))
def rolling_mean_rows(t: Tables) -> DataFrame:
    """Every row of the table in one series."""
    return ops.rolling_mean(t.orders, "o_orderdate", "o_totalprice", span_days=200)


@query(_rolling("orders", "o_orderdate", "o_totalprice", 30, "o_orderstatus"))
def rolling_mean_by_group(t: Tables) -> DataFrame:
    return ops.rolling_mean(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus", span_days=2404)


def _by_days(table: str, x: str, y: str, days: int, by: str = "") -> str:
    split, shown = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""
WITH daily AS (SELECT {shown}date_trunc('day', {x}) AS {x}, sum({y}) AS total, count({y}) AS known, count(*) AS n
               FROM {table} GROUP BY ALL)
SELECT {shown}{x}, {r("total / known", "y_mean")}, n, {r("sum(total) OVER w / sum(known) OVER w", "rolling_y")},
       CAST({days} AS INTEGER) AS days
FROM daily WINDOW w AS ({split} ORDER BY {x} RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)"""


@query(_by_days("orders", "o_orderdate", "o_totalprice", 7, "o_orderstatus"))
def rolling_mean_by_days(t: Tables) -> DataFrame:
    return ops.rolling_mean_by_days(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus")


@query(_by_days("events", "ts", "value", 30))
def rolling_mean_by_days_of_timestamps(t: Tables) -> DataFrame:
    return ops.rolling_mean_by_days(t.events, "ts", "value", days=30)


@query("SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1")
def events_over_time(t: Tables) -> DataFrame:
    return ops.events_over_time(t.orders, "o_orderdate")


@query("SELECT date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def events_per_hour(t: Tables) -> DataFrame:
    return ops.events_over_time(t.events, "ts", "hour")


_MONTHLY = "(SELECT *, date_trunc('month', l_shipdate) AS ship_month FROM lineitem)"


@query(mean_sql(_MONTHLY, "ship_month, l_linestatus", "l_extendedprice"))
def facet_lines(t: Tables) -> DataFrame:
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    rows = t.lineitem.withColumn("ship_month", month)
    _, data = battery.facet(rows, "ship_month", "l_extendedprice", "l_linestatus", ["ship_month"])
    return data


@query("SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def facet_falls_back_to_scatter(t: Tables) -> DataFrame:
    """Eleven different discounts: too many numbers for facets."""
    _, data = battery.facet(t.lineitem, "l_quantity", "l_extendedprice", "l_discount")
    return data


@query(f"""
SELECT o_orderstatus AS "window", o_orderdate, {r("o_totalprice", "o_totalprice")},
       {r("avg(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_totalprice ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)", "rolling_y")},
       CAST(14 AS INTEGER) AS _window FROM orders""")
def rolling_mean_of_a_column_called_window(t: Tables) -> DataFrame:
    renamed = t.orders.withColumnRenamed("o_orderstatus", "window")
    return ops.rolling_mean(renamed, "o_orderdate", "o_totalprice", "window", span_days=200)
