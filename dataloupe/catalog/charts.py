"""Chart choice, chart data, explorer queries, batteries and triage."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.outliers import _SQUARED, _evidence, _folded, squared
from dataloupe.catalog.registry import Tables, quartiles, query, r
from dataloupe.catalog.trends import mean_sql
from dataloupe.operators import battery, chart_choice, charts as ops, triage
from dataloupe.specs import ChartSpec, Tweak

# ---------------------------------------------------------------- choice

LINE_SPECS = [
    ChartSpec("l_shipdate", "l_extendedprice"),
    ChartSpec("l_shipdate", "l_extendedprice", "l_discount"),
    ChartSpec("l_shipdate", "l_returnflag"),
    ChartSpec("l_shipdate"),
    ChartSpec("l_quantity"),
    ChartSpec("l_returnflag"),
    ChartSpec("l_quantity", "l_extendedprice", "l_returnflag"),
    ChartSpec("l_quantity", "l_returnflag"),
    ChartSpec("l_returnflag", "l_quantity"),
    ChartSpec("l_returnflag", "l_quantity", "l_linestatus"),
    ChartSpec("l_returnflag", "l_linestatus"),
    ChartSpec("l_returnflag", "l_linestatus", "l_quantity"),
]


@query("""
WITH f AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS d FROM lineitem)
SELECT s.x, s.y, s.color, coalesce(s.kind,
  CASE s.x || coalesce(s.y, '') WHEN 'l_returnflag' THEN CASE WHEN d <= 10 THEN 'pie' ELSE 'countplot' END
  ELSE CASE WHEN n > 1000 THEN 'violin' ELSE 'box' END END) AS chart_type
FROM f, (VALUES ('l_shipdate', 'l_extendedprice', NULL, 'line'),
  ('l_shipdate', 'l_extendedprice', 'l_discount', 'twin_line'), ('l_shipdate', 'l_returnflag', NULL, 'stacked_bar'),
  ('l_shipdate', NULL, NULL, 'line'), ('l_quantity', NULL, NULL, 'histogram'), ('l_returnflag', NULL, NULL, NULL),
  ('l_quantity', 'l_extendedprice', 'l_returnflag', 'scatter'), ('l_quantity', 'l_returnflag', NULL, 'box'),
  ('l_returnflag', 'l_quantity', NULL, NULL), ('l_returnflag', 'l_quantity', 'l_linestatus', 'box'),
  ('l_returnflag', 'l_linestatus', NULL, 'stacked_bar'), ('l_returnflag', 'l_linestatus', 'l_quantity', 'heatmap')
) s (x, y, color, kind)""")
def choose_chart(t: Tables) -> DataFrame:
    return chart_choice.choose_chart(t.lineitem, LINE_SPECS, ["l_shipdate"])


@query("""
SELECT 'p_brand' AS x, CAST(NULL AS VARCHAR) AS y, CAST(NULL AS VARCHAR) AS color,
       CASE WHEN count(DISTINCT p_brand) <= 10 THEN 'pie' ELSE 'countplot' END AS chart_type FROM part
UNION ALL SELECT 'p_type', NULL, NULL, CASE WHEN count(DISTINCT p_type) <= 10 THEN 'pie' ELSE 'countplot' END FROM part
UNION ALL SELECT 'p_name', NULL, NULL, CASE WHEN count(DISTINCT p_name) <= 10 THEN 'pie' ELSE 'countplot' END FROM part
UNION ALL SELECT 'p_type', 'p_retailprice', NULL, CASE WHEN count(*) > 1000 THEN 'violin' ELSE 'box' END FROM part""")
def choose_chart_by_counts(t: Tables) -> DataFrame:
    specs = [ChartSpec("p_brand"), ChartSpec("p_type"), ChartSpec("p_name"), ChartSpec("p_type", "p_retailprice")]
    return chart_choice.choose_chart(t.part, specs)


# ---------------------------------------------------------------- distributions


def _histogram(table: str, x: str, hue: str = "") -> str:
    shown = f"{hue}, " if hue else ""
    return f"""
WITH f AS (SELECT count({x}) AS n, min({x}) AS low, max({x}) AS high, {quartiles(x)} FROM {table}),
s AS (SELECT *, (high - low) / (log2(n) + 1) AS sturges FROM f),
b AS (SELECT low, high, ceil((high - low) / CASE WHEN q3 > q1 THEN least(sturges, 2 * (q3 - q1) / pow(n, 1.0 / 3))
        ELSE sturges END) AS bins FROM s),
w AS (SELECT low, bins, (high - low) / bins AS width FROM b),
c AS (SELECT {shown}CAST(least(floor(({x} - low) / width), bins - 1) AS BIGINT) AS bin, low, width
      FROM {table}, w WHERE {x} IS NOT NULL)
SELECT {shown}bin, {r("any_value(low) + bin * any_value(width)", "bin_start")},
       {r("any_value(low) + bin * any_value(width) + any_value(width)", "bin_end")}, count(*) AS n
FROM c GROUP BY {shown}bin"""


@query(_histogram("lineitem", "l_extendedprice"))
def histogram(t: Tables) -> DataFrame:
    return ops.histogram(t.lineitem, "l_extendedprice")


@query(_histogram("lineitem", "l_extendedprice", "l_returnflag"))
def histogram_by_hue(t: Tables) -> DataFrame:
    return ops.histogram(t.lineitem, "l_extendedprice", "l_returnflag")


_WIDE = "(SELECT CASE event_id % 97 WHEN 0 THEN value * 100000 ELSE value END AS wide FROM events)"


@query(_histogram(_WIDE, "wide"))
def histogram_with_many_bins(t: Tables) -> DataFrame:
    """Far outliers ask for hundreds of thousands of bins, of which few are filled."""
    wide = F.when(F.col("event_id") % 97 == 0, F.col("value") * 100000).otherwise(F.col("value"))
    return ops.histogram(t.events.select(wide.alias("wide")), "wide")


@query(_histogram("(SELECT value FROM events WHERE event_id % 50 > 1)", "value"))
def histogram_without_infinite_values(t: Tables) -> DataFrame:
    endless = F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).when(F.col("event_id") % 50 == 1, F.lit(float("-inf")))
    return ops.histogram(t.events.select(F.coalesce(endless, "value").alias("value")), "value")


@query(_histogram("lineitem", "l_quantity", "l_returnflag"))
def facet_histogram(t: Tables) -> DataFrame:
    return battery.facet(t.lineitem, "l_quantity", None, "l_returnflag")[1]


@query(f"""
SELECT l_returnflag, l_linestatus, count(*) AS n,
       {r("count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus) * 100", "pct")} FROM lineitem GROUP BY 1, 2""")
def run_chart_facet_counts(t: Tables) -> DataFrame:
    """A chart without y is split too."""
    tweak = Tweak("facet_grid", facet_by="l_linestatus")
    return battery.run_chart(t.lineitem, ChartSpec("l_returnflag"), [], "l_extendedprice", tweak).data


@query(f"""
SELECT l_linenumber, l_returnflag AS x, l_linestatus AS segment, count(*) AS n,
       {r("count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber, l_returnflag) * 100", "pct")},
       count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber, l_returnflag) * 100 > 5 AS show_label
FROM lineitem GROUP BY 1, 2, 3""")
def facet_composition(t: Tables) -> DataFrame:
    return battery.facet(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber")[1]


@query("SELECT event_type AS n, count(*) AS _n FROM events GROUP BY 1")
def count_plot_of_a_column_called_n(t: Tables) -> DataFrame:
    return ops.count_plot(t.events.withColumnRenamed("event_type", "n"), "n")


def _density(table: str, x: str, by: str, points: int, adjust: float, cut: float, common: bool) -> str:
    """The same cells of 1/32 bandwidth, each added to every grid point."""
    ends = "min(low - {c} * h) OVER () AS first, max(high + {c} * h) OVER () AS last" if common else (
        "low - {c} * h AS first, high + {c} * h AS last")
    return f"""
g AS (SELECT *, {ends.format(c=cut)} FROM (SELECT {by} AS k, count({x}) AS n, min({x}) AS low, max({x}) AS high,
       stddev_samp({x}) * pow(count({x}), -0.2) * {adjust} AS h FROM {table} GROUP BY ALL HAVING stddev_samp({x}) > 0)),
cells AS (SELECT k, floor(({x} - low) / h * 32) AS cell, count(*) AS m, avg({x}) AS mid
          FROM {table} JOIN g ON {by} = k GROUP BY ALL),
pts AS (SELECT g.*, i AS grid_no, first + i * ((last - first) / {points - 1}) AS grid_x
        FROM g, generate_series(0, {points - 1}) s(i)),
shape AS (SELECT k, grid_no, grid_x, sum(m * exp(-pow((grid_x - mid) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))
          AS density FROM pts JOIN cells USING (k) GROUP BY ALL)"""


def _kde(table: str, x: str, by: str = "", digits: int = 8) -> str:
    shown = f"k AS {by}, " if by else ""
    return f"""
WITH {_density(table, x, by or "'all'", 200, 1.0, 0, True)}
SELECT {shown}grid_no, {r("grid_x", "grid_x", digits)}, {r("density", "density", digits)} FROM shape"""


@query(_kde("events", "value"), digits=8)
def kde(t: Tables) -> DataFrame:
    return ops.kde(t.events, "value")


@query(_kde("lineitem", "l_quantity", "l_returnflag"), digits=8)
def kde_by_group(t: Tables) -> DataFrame:
    return ops.kde(t.lineitem, "l_quantity", "l_returnflag")


@query(f"""
WITH {_density("orders", "o_totalprice", "o_orderpriority", 100, 0.5, 2, False)},
q AS (SELECT o_orderpriority AS k, {quartiles("o_totalprice")} FROM orders GROUP BY 1)
SELECT k AS "group", grid_no, {r("grid_x", "grid_x", 4)}, {r("density * 1e6", "density_per_million", 4)},
       {r("q1", "q1")}, {r("median", "median")}, {r("q3", "q3")} FROM shape JOIN q USING (k)""")
def violin(t: Tables) -> DataFrame:
    shape = ops.violin(t.orders, "o_orderpriority", "o_totalprice")
    return shape.withColumn("density_per_million", F.col("density") * 1e6).drop("density")


def box_sql(table: str, group: str, y: str, hue: str = "") -> str:
    """``hue`` ends with a comma when given."""
    return f"""
SELECT "group", {hue}n, {r("q1", "q1")}, {r("median", "median")}, {r("q3", "q3")},
       {r(f"min({y}) FILTER (ok)", "whisker_low")}, {r(f"max({y}) FILTER (ok)", "whisker_high")},
       count(*) FILTER (NOT ok) AS n_fliers
FROM (SELECT *, {y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
      FROM (SELECT {group} AS "group", {hue}{y} FROM {table}) JOIN
           (SELECT {group} AS "group", {hue}count({y}) AS n, {quartiles(y)} FROM {table} GROUP BY ALL)
      USING ({hue}"group"))
GROUP BY ALL"""


@query(box_sql("orders", "o_orderpriority", "o_totalprice"))
def box_stats(t: Tables) -> DataFrame:
    return ops.box_stats(t.orders, "o_orderpriority", "o_totalprice")


@query(box_sql(_SQUARED, "event_type", "energy"))
def box_stats_horizontal(t: Tables) -> DataFrame:
    """Numeric x, categorical y: the groups are y."""
    return ops.box_stats(squared(t), "energy", "event_type")


@query(box_sql("lineitem", "l_returnflag", "l_extendedprice", "l_linestatus, "))
def box_stats_by_hue(t: Tables) -> DataFrame:
    return ops.box_stats(t.lineitem, "l_returnflag", "l_extendedprice", "l_linestatus")


# ---------------------------------------------------------------- points, counts, shares


@query("SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def scatter_points(t: Tables) -> DataFrame:
    return ops.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("""
SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag
    ORDER BY md5(l_orderkey || chr(31) || l_linenumber), l_quantity, l_extendedprice) <= 500""")
def scatter_sample_per_color(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_linenumber"]
    return ops.scatter_sample(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag", per_color=500, key=key)


@query(f"""
WITH ends AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                     max(l_extendedprice) AS y1 FROM lineitem),
     cells AS (SELECT l_returnflag, CAST(least(floor((l_quantity - x0) / (x1 - x0) * 40), 39) AS INTEGER) AS x_cell,
                      CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 40), 39) AS INTEGER) AS y_cell, ends.*
               FROM lineitem, ends)
SELECT l_returnflag, x_cell, y_cell, {r("x0 + x_cell * (x1 - x0) / 40", "x_start")},
       {r("x0 + (x_cell + 1) * (x1 - x0) / 40", "x_end")}, {r("y0 + y_cell * (y1 - y0) / 40", "y_start")},
       {r("y0 + (y_cell + 1) * (y1 - y0) / 40", "y_end")}, count(*) AS n
FROM cells GROUP BY ALL""")
def scatter_cells(t: Tables) -> DataFrame:
    return ops.scatter_cells(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag", cells=40)


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def count_plot(t: Tables) -> DataFrame:
    return ops.count_plot(t.part, "p_brand", "p_type")


@query(f"""
SELECT o_orderpriority, count(*) AS n, {r("count(*) / sum(count(*)) OVER () * 100", "pct")}
FROM orders GROUP BY 1""")
def category_share(t: Tables) -> DataFrame:
    return ops.category_share(t.orders, "o_orderpriority")


def _composition(table: str, x: str, segment: str) -> str:
    share = f"count(*) / sum(count(*)) OVER (PARTITION BY {x}) * 100"
    return f"""
SELECT {x} AS x, {segment} AS segment, count(*) AS n, {r(share, "pct")}, {share} > 5 AS show_label
FROM {table} WHERE {x} IS NOT NULL AND {segment} IS NOT NULL GROUP BY {x}, {segment}"""


@query(_composition("lineitem", "l_returnflag", "l_linestatus"))
def composition(t: Tables) -> DataFrame:
    return ops.composition(t.lineitem, "l_returnflag", "l_linestatus")


@query(_composition("lineitem", "l_shipdate", "l_returnflag"))
def composition_over_time(t: Tables) -> DataFrame:
    return ops.composition(t.lineitem, "l_shipdate", "l_returnflag")


@query(f"""
SELECT x, segment, n, {r("n / sum(n) OVER (PARTITION BY x) * 100", "pct")},
       n / sum(n) OVER (PARTITION BY x) * 100 > 5 AS show_label
FROM (SELECT a.x, b.segment, count(p.p_partkey) AS n FROM (SELECT DISTINCT p_name AS x FROM part) a
      CROSS JOIN (SELECT DISTINCT p_brand AS segment FROM part) b
      LEFT JOIN part p ON p.p_name = a.x AND p.p_brand = b.segment GROUP BY ALL)""")
def composition_with_zero_cells(t: Tables) -> DataFrame:
    return ops.composition(t.part, "p_name", "p_brand", zero_cells=True)


@query(f"""
SELECT l_linestatus AS y, l_returnflag AS x, {r("avg(l_extendedprice)", "mean")} FROM lineitem GROUP BY ALL""")
def heatmap(t: Tables) -> DataFrame:
    return ops.heatmap(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice")


@query(f"""
SELECT {r("min(c_acctbal)", "y_min")}, {r("max(c_acctbal)", "y_max")}, {r("min(c_acctbal) * 0.95", "lo")},
       {r("max(c_acctbal) * 1.05", "hi")} FROM customer""")
def axis_limits(t: Tables) -> DataFrame:
    return ops.axis_limits(t.customer, "c_acctbal")


def _scale(table: str, y: str) -> str:
    return f"SELECT CASE WHEN bool_and(coalesce({y} > 0, false)) THEN 'log' ELSE 'symlog' END AS scale FROM {table}"


@query(_scale("orders", "o_totalprice"))
def scale_kind_log(t: Tables) -> DataFrame:
    return ops.scale_kind(t.orders, "o_totalprice")


@query(_scale("customer", "c_acctbal"))
def scale_kind_symlog(t: Tables) -> DataFrame:
    return ops.scale_kind(t.customer, "c_acctbal")


@query(box_sql("orders", "o_orderpriority", "o_totalprice", "o_orderstatus, "))
def facet_boxes(t: Tables) -> DataFrame:
    """Priority is split by status; the boxes are those of each facet."""
    spec = ChartSpec("o_orderpriority", "o_totalprice", "o_orderstatus")
    return battery.chart_data(t.orders, spec, "box")


# ---------------------------------------------------------------- single charts with tweaks


@query(mean_sql("lineitem", "l_shipdate, l_returnflag", "l_extendedprice"))
def run_chart_color_by_segment(t: Tables) -> DataFrame:
    spec, tweak = ChartSpec("l_shipdate", "l_extendedprice"), Tweak("color_by_segment", color_by="l_returnflag")
    return battery.run_chart(t.lineitem, spec, ["l_shipdate"], "l_extendedprice", tweak).data


@query(f"""
WITH m AS (SELECT o_orderstatus, o_orderdate, o_totalprice FROM orders)
SELECT o_orderstatus, o_orderdate, {r("o_totalprice", "o_totalprice")},
       {r("avg(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_totalprice ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", "rolling_y")},
       CAST(30 AS INTEGER) AS "window" FROM m""")
def run_chart_rolling_mean(t: Tables) -> DataFrame:
    spec = ChartSpec("o_orderdate", "o_totalprice", "o_orderstatus")
    return battery.run_chart(t.orders, spec, ["o_orderdate"], "o_totalprice", Tweak("rolling_mean")).data


@query(mean_sql("orders", "o_orderdate, o_orderstatus", "o_totalprice"))
def run_chart_facet_grid(t: Tables) -> DataFrame:
    spec, tweak = ChartSpec("o_orderdate", "o_totalprice"), Tweak("facet_grid", facet_by="o_orderstatus")
    return battery.run_chart(t.orders, spec, ["o_orderdate"], "o_totalprice", tweak).data


@query(f"""
SELECT {r("min(c_acctbal)", "y_min")}, {r("max(c_acctbal)", "y_max")}, {r("min(c_acctbal) * 0.95", "lo")},
       {r("max(c_acctbal) * 1.05", "hi")} FROM customer""")
def run_chart_unpin_y_zero(t: Tables) -> DataFrame:
    spec = ChartSpec("c_mktsegment", "c_acctbal")
    return battery.run_chart(t.customer, spec, [], "c_acctbal", Tweak("unpin_y_zero")).axis


# ---------------------------------------------------------------- explorer queries


@query(f"""
SELECT l_returnflag, l_linestatus, {r("sum(l_quantity)", "sum_l_quantity")},
       {r("sum(l_extendedprice)", "sum_l_extendedprice")} FROM lineitem GROUP BY ALL""")
def run_chart_query_sum(t: Tables) -> DataFrame:
    return battery.run_chart_query(
        t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]
    )


@query(f"SELECT l_returnflag, {r('avg(l_discount)', 'mean_l_discount')} FROM lineitem GROUP BY 1")
def run_chart_query_mean(t: Tables) -> DataFrame:
    return battery.run_chart_query(t.lineitem, ["l_returnflag"], ["l_discount"], "mean")


@query("SELECT o_orderpriority, count(o_orderpriority) AS count_o_orderpriority FROM orders GROUP BY 1")
def explorer_query_pie(t: Tables) -> DataFrame:
    return battery.explorer_query(t.orders, ChartSpec("o_orderpriority"), "pie")


@query("SELECT l_returnflag, l_linestatus, count(l_linestatus) AS count_l_linestatus FROM lineitem GROUP BY ALL")
def explorer_query_stacked_bar(t: Tables) -> DataFrame:
    return battery.explorer_query(t.lineitem, ChartSpec("l_returnflag", "l_linestatus"), "stacked_bar")


@query(f"SELECT l_returnflag, l_linestatus, {r('avg(l_tax)', 'mean_l_tax')} FROM lineitem GROUP BY ALL")
def explorer_query_heatmap(t: Tables) -> DataFrame:
    return battery.explorer_query(t.lineitem, ChartSpec("l_returnflag", "l_linestatus", "l_tax"), "heatmap")


@query(f"""
SELECT l_shipdate, {r("sum(l_quantity)", "sum_l_quantity")}, {r("sum(l_tax)", "sum_l_tax")} FROM lineitem GROUP BY 1""")
def explorer_query_twin_line(t: Tables) -> DataFrame:
    return battery.explorer_query(t.lineitem, ChartSpec("l_shipdate", "l_quantity", "l_tax"), "twin_line")


@query("SELECT o_orderpriority, o_totalprice FROM orders")
def explorer_query_rows(t: Tables) -> DataFrame:
    return battery.explorer_query(t.orders, ChartSpec("o_orderpriority", "o_totalprice"), "box")


# ---------------------------------------------------------------- batteries

BATTERY = [
    ChartSpec("l_returnflag", "l_linestatus", "l_discount", 8),
    ChartSpec("l_returnflag", score=9),
    ChartSpec("l_returnflag", score=7),
    ChartSpec("l_quantity", score=7),
    ChartSpec("l_tax", score=6),
    ChartSpec("l_shipdate", "l_extendedprice", score=10),
    ChartSpec("l_returnflag", "l_linestatus", score=8),
    ChartSpec("l_returnflag", "l_extendedprice", "l_linestatus", 9),
]


def _tidy(no: int, level: str, kind: str, table: str, x: str, series: str, stats: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({no} AS INTEGER) AS chart_no, '{level}' AS level, '{kind}' AS chart_type,
        CAST({x} AS VARCHAR) AS x, CAST({series} AS VARCHAR) AS series, '{s}' AS stat,
        CAST({s} AS DOUBLE) AS value FROM ({table})"""
        for s in stats
    )


BOX = ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_fliers"]
MEAN = ["mean", "ci_low", "ci_high", "n"]


@query(
    " UNION ALL ".join([
        _tidy(1, "univariate", "pie", f"""SELECT l_returnflag, count(*) AS n,
              {r("count(*) / sum(count(*)) OVER () * 100", "pct")} FROM lineitem GROUP BY 1""",
              "l_returnflag", "NULL", ["n", "pct"]),
        _tidy(2, "univariate", "histogram", _histogram("lineitem", "l_quantity"), "bin", "NULL",
              ["bin_start", "bin_end", "n"]),
        _tidy(2, "univariate", "histogram", _kde("lineitem", "l_quantity", digits=4), "grid_no", "NULL",
              ["grid_x", "density"]),
        _tidy(3, "bivariate", "line", mean_sql("lineitem", "l_shipdate", "l_extendedprice"), "l_shipdate", "NULL", MEAN),
        _tidy(4, "bivariate", "stacked_bar", _composition("lineitem", "l_returnflag", "l_linestatus"), "x", "segment",
              ["n", "pct"]),
        _tidy(5, "multivariate", "heatmap", f"""SELECT l_linestatus AS y, l_returnflag AS x,
              {r("avg(l_discount)", "mean")} FROM lineitem GROUP BY ALL""", "x", "y", ["mean"]),
        _tidy(6, "multivariate", "box", box_sql("lineitem", "l_returnflag", "l_extendedprice", "l_linestatus, "),
              '"group"', "l_linestatus", BOX),
    ])
)
def chart_battery(t: Tables) -> DataFrame:
    data, _ = battery.chart_battery(t.lineitem, BATTERY, ["l_shipdate"], "l_extendedprice")
    return data


_CLIPPED = f"""
(SELECT s.* FROM {_SQUARED} s LEFT JOIN (SELECT event_type, quantile_cont(energy, 0.99) AS p99 FROM {_SQUARED}
  GROUP BY 1 HAVING p99 > 0 AND max(energy) > 3 * p99) l ON s.event_type = l.event_type
 WHERE p99 IS NULL OR energy <= p99)"""

_EVENT_SPECS = [
    ChartSpec("event_type", "energy", "event_type", 9),
    ChartSpec("event_type", score=8),
    ChartSpec("user_id", "value", score=7),
]


@query(
    " UNION ALL ".join([
        _tidy(1, "univariate", "pie", f"""SELECT event_type, count(*) AS n,
              {r("count(*) / sum(count(*)) OVER () * 100", "pct")} FROM events GROUP BY 1""",
              "event_type", "NULL", ["n", "pct"]),
        _tidy(2, "bivariate", "scatter", "SELECT user_id, value FROM events", "user_id", "NULL", ["value"]),
        _tidy(3, "multivariate", "box", box_sql(_CLIPPED.replace("s.*", 's.*, s.event_type AS hue'),
              "event_type", "energy", "hue, "), '"group"', "hue", BOX),
    ])
)
def chart_battery_with_clipping(t: Tables) -> DataFrame:
    """Only 'click' has outliers; its box is drawn without them."""
    events = squared(t).withColumn("hue", F.col("event_type"))
    specs = [s if s.color_by is None else ChartSpec(s.x, s.y, "hue", s.score) for s in _EVENT_SPECS]
    data, _ = battery.chart_battery(events, specs, [], "value")
    return data


@query(f"""
SELECT n.chart_no, CASE n.chart_no WHEN 1 THEN 'non_numeric' ELSE 'numeric' END AS data_type,
       summary IS NOT NULL AS outlier_clipped, "group", n, p99, max, outlier_count, outlier_sum, total_sum, impact_pct, original_max, clipped_at,
       hidden_impact_pct, coalesce(summary, 'No significant outliers.') AS summary
FROM (SELECT CAST(i AS INTEGER) AS chart_no FROM generate_series(1, 3) s(i)) n
LEFT JOIN (SELECT CAST(3 AS INTEGER) AS chart_no, * FROM ({_evidence("event_type", _SQUARED, "energy")})) e
  ON n.chart_no = e.chart_no""")
def chart_battery_evidence(t: Tables) -> DataFrame:
    _, evidence = battery.chart_battery(squared(t), _EVENT_SPECS, [], "value")
    return evidence


@query(
    _tidy(1, "univariate", "countplot",
          f"SELECT source, count(*) AS n FROM ({_folded('documents', 'doc_id', 'source', 'n_chars')}) GROUP BY 1",
          "source", "NULL", ["n"])
)
def chart_battery_with_others(t: Tables) -> DataFrame:
    """Twenty sources: the tail is folded before counting."""
    data, _ = battery.chart_battery(t.documents, [ChartSpec("source")], [], "n_chars")
    return data


# ---------------------------------------------------------------- triage

_FINDINGS = """
(SELECT l_orderkey AS run, l_linenumber, l_linenumber + 2 AS quality_score, CAST(floor(l_quantity / 5) AS INTEGER) AS strategic_score,
        l_tax > 0.07 AS is_spurious, CASE WHEN l_returnflag = 'R' THEN 'log_scale' END AS suggested_tweak,
        l_linestatus = 'O' AND l_returnflag = 'R' AS tweak_repeated FROM lineitem)"""


@query(f"""
WITH complete AS (SELECT *, quality_score >= 6 AND strategic_score >= 6 AS good FROM {_FINDINGS}
  WHERE CASE WHEN tweak_repeated THEN strategic_score >= 6 ELSE NOT is_spurious AND suggested_tweak IS NULL END)
SELECT * EXCLUDE (good, any_good) FROM (SELECT *, bool_or(good) OVER (PARTITION BY run) AS any_good FROM complete)
WHERE good OR NOT any_good""")
def triage_findings(t: Tables) -> DataFrame:
    asks = F.col("l_returnflag") == "R"
    findings = t.lineitem.select(
        F.col("l_orderkey").alias("run"),
        "l_linenumber",
        (F.col("l_linenumber") + 2).alias("quality_score"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("strategic_score"),
        (F.col("l_tax") > 0.07).alias("is_spurious"),
        F.when(asks, "log_scale").alias("suggested_tweak"),
        ((F.col("l_linestatus") == "O") & asks).alias("tweak_repeated"),
    )
    return triage.triage_findings(findings, "run")


_ROUNDS = """
(SELECT l_partkey AS chart, l_linenumber AS round, l_orderkey, CAST(l_quantity AS INTEGER) % 10 AS strategic_score,
        l_tax > 0.07 AS is_spurious, CASE WHEN l_returnflag <> 'N' THEN 'log_scale' END AS suggested_tweak FROM lineitem)"""


@query(f"""
WITH plain AS (SELECT *, CASE WHEN is_spurious THEN 'drop' ELSE 'stay' END AS first_look FROM {_ROUNDS}),
first AS (SELECT chart, suggested_tweak, min(round) AS first_round FROM plain WHERE first_look = 'stay' GROUP BY 1, 2)
SELECT p.chart, p.round, p.l_orderkey, coalesce(first_round < p.round, false) AS tweak_repeated
FROM plain p LEFT JOIN first f ON p.chart = f.chart AND p.suggested_tweak IS NOT DISTINCT FROM f.suggested_tweak""")
def triage_findings_with_history(t: Tables) -> DataFrame:
    findings = t.lineitem.select(
        F.col("l_partkey").alias("chart"),
        F.col("l_linenumber").alias("round"),
        "l_orderkey",
        (F.col("l_quantity").cast("int") % 10).alias("strategic_score"),
        (F.col("l_tax") > 0.07).alias("is_spurious"),
        F.when(F.col("l_returnflag") != "N", "log_scale").alias("suggested_tweak"),
    )
    known = triage.with_tweak_history(findings, ["chart"], "round")
    return known.select("chart", "round", "l_orderkey", "tweak_repeated")


@query(f"""
SELECT l_returnflag AS sum_l_quantity, {r("sum(l_quantity)", "_sum_l_quantity")} FROM lineitem GROUP BY ALL""")
def run_chart_query_with_sum_name(t: Tables) -> DataFrame:
    """A measure steps aside for a dimension that has its name."""
    renamed = t.lineitem.withColumnRenamed("l_returnflag", "sum_l_quantity")
    return battery.run_chart_query(renamed, ["sum_l_quantity"], ["l_quantity"])
