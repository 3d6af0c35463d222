"""From chart specs to chart data: single charts, facets, group-by queries, whole batteries."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import (
    col, fresh, is_numeric, is_text, number, quoted, require_columns, without_nan,
)
from dataloupe.operators import charts
from dataloupe.operators.chart_choice import PIE_SLICES, chart_types
from dataloupe.operators.features import day_span
from dataloupe.operators.outliers import clip_outliers, clip_thresholds, outliers_by_group
from dataloupe.operators.shared_scan import Chart, Shared, shared_evidence, shared_limits, shared_tops
from dataloupe.operators.topk import MAX_K, top_k_others
from dataloupe.plans.cardinality import distinct_up_to
from dataloupe.plans.storage import materialize
from dataloupe.specs import ChartSpec, Tweak

log = logging.getLogger(__name__)

# Largest discrete facet, and the score a planned chart must exceed.
FACET_VALUES = 10
MIN_SCORE = 6

# How the explorer queries a chart: its rows, its counts per x, or else sums.
ROW_CHARTS = ("histogram", "line", "rolling_mean", "scatter", "box", "violin")
COUNTING_CHARTS = ("pie",)
# Charts whose bars count rows if y is no number; one of them is coloured by y itself.
BAR_CHARTS = ("bar", "countplot", "stacked_bar")


@dataclass(frozen=True)
class ChartResult:
    """One chart: its type, its table, its outlier evidence (none if there is no numeric y),
    axis advice if asked for, and the density curve of a histogram."""

    chart_type: str
    data: DataFrame
    evidence: DataFrame | None
    axis: DataFrame | None = None
    curve: DataFrame | None = None


def chart_data(
    df: DataFrame, spec: ChartSpec, chart_type: str, span_days: int | None = None
) -> DataFrame:
    """The table behind one chart of a known type."""
    x, y, color = spec.x, spec.y, spec.color_by
    match chart_type:
        case "histogram":
            return charts.histogram(df, x, color)
        case "line" if y is None:
            return charts.events_over_time(df, x)
        case "line":
            return charts.line_mean(df, x, y, color)
        case "bar":
            return charts.bar_mean(df, x, y, color)
        case "twin_line":
            return charts.twin_line(df, x, y, color)
        case "scatter":
            return charts.scatter_points(df, x, y, color)
        case "box":
            return charts.box_stats(df, x, y, color)
        case "violin":
            return charts.violin(df, x, y)
        case "countplot":
            return charts.count_plot(df, x, color)
        case "pie":
            return charts.category_share(df, x)
        case "stacked_bar":
            return charts.composition(df, x, color or y)
        case "heatmap":
            return charts.heatmap(df, x, y, color)
        case "rolling_mean":
            days = day_span(df, [x]) if span_days is None else span_days
            return charts.rolling_mean(df, x, y, color, span_days=days)
    raise ValueError(f"no data for chart type {chart_type!r}")


def facet(
    df: DataFrame,
    x: str,
    y: str | None,
    facet_col: str,
    temporal_columns: list[str] | None = None,
) -> tuple[str, DataFrame]:
    """The same chart for every value of ``facet_col``: its type, chosen without colour, and
    its table with the facet as one more grouping key.

    A numeric facet with more than 10 values, or y itself, gives one coloured scatter.
    """
    require_columns(df, x, y, facet_col)
    continuous = is_numeric(df, facet_col) and (
        distinct_up_to(df, [facet_col], FACET_VALUES)[facet_col] is None
    )
    if continuous or facet_col == y:
        return "scatter", charts.scatter_points(df, x, y, facet_col)
    chart_type = chart_types(df, [ChartSpec(x, y)], temporal_columns)[0]
    match chart_type:
        case "violin":
            return chart_type, charts.violin(df, x, y, facet_col)
        case "line" if y is None:
            return chart_type, charts.count_plot(df, x, facet_col)
        case "pie":
            return chart_type, charts.category_share(df, x, facet_col)
        case "stacked_bar":
            return chart_type, charts.composition(df, x, y, facet=facet_col)
    return chart_type, chart_data(df, ChartSpec(x, y, facet_col), chart_type)


def fold_tail(df: DataFrame, spec: ChartSpec, primary_metric: str | None) -> DataFrame:
    """Turn the tail of the colour column (or else x) into 'Others' if it is text with more
    than 12 values and the primary metric is numeric."""
    targets = long_tails(df, [spec], primary_metric)
    return top_k_others(df, targets[0], primary_metric) if targets else df


def long_tails(
    df: DataFrame,
    specs: list[ChartSpec],
    primary_metric: str | None,
    counts: dict[str, int | None] | None = None,
) -> list[str]:
    """The columns of the specs whose tail is to be folded, found with one distinct count if
    ``counts`` (see ``distinct_up_to``) are not known already."""
    if primary_metric is None or not is_numeric(df, primary_metric):
        return []
    targets = sorted({t for t in (s.color_by or s.x for s in specs) if is_text(df, t)})
    counts = distinct_up_to(df, targets, MAX_K) if counts is None else counts
    return [t for t in targets if counts[t] is None or counts[t] > MAX_K]


def run_chart(
    df: DataFrame,
    spec: ChartSpec,
    temporal_columns: list[str] | None = None,
    primary_metric: str | None = None,
    tweak: Tweak | None = None,
    chart_type: str | None = None,
    span_days: int | None = None,
    shared: dict | None = None,
) -> ChartResult:
    """One chart from a spec: choose its type, fold the tail, find and clip outliers, aggregate.

    The type is chosen on the rows as given, and axis advice is taken from them too. A tweak
    that does not apply, such as axis advice without a numeric y, a rolling mean of a chart
    that is no line, or facets without a column, leaves the chart as it is. Charts of one table
    can share what they find out about it by passing the same ``shared`` dictionary.
    """
    shared = {} if shared is None else shared
    require_columns(df, spec.x, spec.y, spec.color_by)
    axis = None
    if tweak is not None:
        if tweak.kind == "color_by_segment" and spec.color_by is None:
            spec = replace(spec, color_by=tweak.color_by)
        elif tweak.kind in ("unpin_y_zero", "log_scale"):
            if spec.y is not None and is_numeric(df, spec.y):
                advice = charts.axis_limits if tweak.kind == "unpin_y_zero" else charts.scale_kind
                axis = advice(df, spec.y)
            else:
                log.warning("tweak %s skipped: y (%s) is not numeric", tweak.kind, spec.y)
    chart_type = chart_type or chart_types(df, [spec], temporal_columns)[0]
    if tweak is not None and tweak.kind == "rolling_mean" and chart_type == "line":
        chart_type = "rolling_mean"
        if span_days is None and temporal_columns:
            span_days = day_span(df, temporal_columns)
    target = spec.color_by or spec.x
    if ("tail", target, primary_metric) not in shared:
        folds = target in long_tails(df, [spec], primary_metric)
        shared["tail", target, primary_metric] = folds
    if shared["tail", target, primary_metric]:
        df = top_k_others(df, target, primary_metric)
    evidence = None
    if spec.y is not None and is_numeric(df, spec.y):
        # Folding x leaves y alone; what folding the colour gives depends on the metric.
        key = ("limits", spec.y, spec.color_by, spec.color_by and primary_metric)
        if key not in shared:
            shared[key] = materialize(clip_thresholds(df, spec.y, spec.color_by))
        limits = shared[key]
        evidence = outliers_by_group(df, spec.y, spec.color_by, limits)
        df = clip_outliers(df, spec.y, spec.color_by, limits)
    facet_col = None
    if tweak is not None and tweak.kind == "facet_grid":
        facet_col = spec.color_by or tweak.facet_by or spec.y
    if facet_col is not None:
        chart_type, data = facet(df, spec.x, spec.y, facet_col, temporal_columns)
    else:
        data = chart_data(df, spec, chart_type, span_days)
    curve = charts.kde(df, spec.x, facet_col or spec.color_by) if chart_type == "histogram" else None
    return ChartResult(chart_type, data, evidence, axis, curve)


# ---------------------------------------------------------------- explorer queries

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count}


def run_chart_query(
    df: DataFrame, dims: list[str], measures: list[str], agg: str | None = "sum"
) -> DataFrame:
    """Group by the dimensions and aggregate the measures (``sum``, ``mean`` or ``count``).

    Measures come out as ``{agg}_{measure}``. Without ``agg`` the rows are returned as they are.
    """
    require_columns(df, *dims, *measures)
    if agg is None:
        return df.select([without_nan(df, n).alias(n) for n in dict.fromkeys([*dims, *measures])])
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {list(AGGREGATES)} or None")

    def measured(name: str) -> Column:
        value = without_nan(df, name) if agg == "count" else number(df, name)
        return AGGREGATES[agg](value)

    names = list(dict.fromkeys(dims))
    keys, found = [col(d) for d in names], []
    for m in dict.fromkeys(measures):
        names.append(fresh(f"{agg}_{m}", *names))
        found.append(measured(m).alias(names[-1]))
    if not found:
        return df.select(keys).distinct()
    return df.groupBy(*keys).agg(*found) if keys else df.agg(*found)


def explorer_query(df: DataFrame, spec: ChartSpec, chart_type: str) -> DataFrame:
    """The group-by query an interactive explorer runs for a chart.

    Numbers are measures, everything else is a dimension. Pies and bars over a
    non-numeric y count; a heatmap averages its colour; other numbers are summed;
    boxes, points, lines and histograms show rows.
    """
    given = [n for n in (spec.x, spec.y, spec.color_by) if n is not None]
    require_columns(df, *given)
    if chart_type in ROW_CHARTS:
        return run_chart_query(df, given, [], None)
    if chart_type in COUNTING_CHARTS:
        return run_chart_query(df, [spec.x], [spec.x], "count")
    measures = [n for n in given if is_numeric(df, n)]
    dims = [n for n in given if n not in measures]
    if chart_type == "heatmap" and spec.color_by in measures:
        return run_chart_query(df, dims, [spec.color_by], "mean")
    known = chart_type in (*BAR_CHARTS, "heatmap", "twin_line", "facet_grid")
    bars = chart_type in BAR_CHARTS or not known
    if not bars or spec.y is None or spec.y in measures:
        return run_chart_query(df, dims, measures, "sum")
    left = (spec.y,) if chart_type != "stacked_bar" else (spec.color_by,)
    return run_chart_query(df, [n for n in dims if n not in left], [spec.y], "count")


# ---------------------------------------------------------------- batteries

TIDY = ["chart_no", "level", "chart_type", "x", "series", "stat", "value"]


def plan_battery(specs: list[ChartSpec], min_score: int = MIN_SCORE) -> list[ChartSpec]:
    """Specs that score above ``min_score``, each (x, y, colour) once, simplest level first."""
    kept: dict[tuple, ChartSpec] = {}
    for spec in specs:
        if spec.score > min_score:
            kept.setdefault((spec.x, spec.y, spec.color_by), spec)
    levels = ["univariate", "bivariate", "multivariate"]
    return sorted(kept.values(), key=lambda s: levels.index(s.level))


def chart_battery(
    df: DataFrame,
    specs: list[ChartSpec],
    temporal_columns: list[str] | None = None,
    primary_metric: str | None = None,
    min_score: int = MIN_SCORE,
) -> tuple[DataFrame, DataFrame]:
    """All planned charts as one tidy table, and their outlier evidence as another.

    Data: ``(chart_no, level, chart_type, x, series, stat, value)``; histograms also have their
    density curve, under the number of the grid point. Evidence: ``chart_no``, ``data_type`` of
    y ('numeric' or 'non_numeric'), ``outlier_clipped``, and the columns of ``outliers_by_group``;
    a chart without outliers has one row that says so. The table is scanned a fixed number of times,
    reading only the columns that charts use (see ``shared_scan``).
    """
    planned = plan_battery(specs, min_score)
    if not planned:
        raise ValueError(f"no chart scores above {min_score}")
    require_columns(df, *{n for s in planned for n in (s.x, s.color_by)})
    slices = {s.x for s in planned if s.x not in (temporal_columns or []) and not is_numeric(df, s.x)}
    targets = {t for t in (s.color_by or s.x for s in planned) if is_text(df, t)}
    counts = distinct_up_to(df, sorted(slices | targets), max(MAX_K, PIE_SLICES))
    types = chart_types(df, planned, temporal_columns, counts)
    tops = shared_tops(df, long_tails(df, planned, primary_metric, counts), primary_metric)
    pairs: list[tuple[str, str | None]] = []
    plan = []
    for no, (spec, chart_type) in enumerate(zip(planned, types), start=1):
        limit = None
        if spec.y is not None and is_numeric(df, spec.y):
            if (spec.y, spec.color_by) not in pairs:
                pairs.append((spec.y, spec.color_by))
            limit = pairs.index((spec.y, spec.color_by))
        plan.append(Chart(no, spec, chart_type, limit))
    used = {n for s in planned for n in (s.x, s.y, s.color_by) if n is not None}
    narrow = df.select([col(n) for n in df.columns if n in used])
    rows, limits = shared_limits(narrow, pairs, tops) if pairs else (None, None)
    shared = Shared(narrow, plan, pairs, tops, limits)
    tables = [*shared.grouped(), *shared.points(), *shared.spread()]
    marks = df.sparkSession.createDataFrame(
        [(c.no, c.spec.level, c.kind) for c in plan], "no int, level string, chart_type string"
    )
    data = reduce(DataFrame.unionByName, tables).join(F.broadcast(marks), "no")  # one row per chart
    data = data.withColumnRenamed("no", "chart_no").select(TIDY)
    found = [] if rows is None else [shared_evidence(rows, limits, pairs, plan)]
    kinds = [
        (no, "numeric" if s.y is not None and is_numeric(df, s.y) else "non_numeric")
        for no, s in enumerate(planned, start=1)
    ]
    numbers = df.sparkSession.createDataFrame(kinds, "chart_no int, data_type string")
    if not found:
        clipped = F.lit(False).alias("outlier_clipped")
        return data, numbers.select("*", clipped, F.lit(wording.NO_OUTLIERS).alias("summary"))
    evidence = numbers.join(reduce(DataFrame.unionByName, found), "chart_no", "left")
    return data, evidence.withColumn("outlier_clipped", F.col("summary").isNotNull()).withColumn(
        "summary", F.coalesce("summary", F.lit(wording.NO_OUTLIERS))
    )


def tidy_chart(data: DataFrame, spec: ChartSpec, chart_type: str) -> DataFrame:
    """``(x, series, stat, value)`` rows of one chart's table. ``stat`` names a figure without
    the underscores that tell it from a column of the same name."""
    color = spec.color_by
    figures = {n.lstrip("_") for n in data.columns if n not in (spec.x, color)}
    match chart_type:
        case "histogram":
            x, series = fresh("bin" if "n" in figures else "grid_no", color), color
        case "box":
            x, series = fresh("group", color), color
        case "violin":
            x, series = "group", "grid_no"
        case "stacked_bar":
            x, series = "x", "segment"
        case "heatmap":
            x, series = "x", "y"
        case "twin_line" | "pie":
            x, series = spec.x, None
        case _:
            x, series = spec.x, color if spec.y or chart_type == "countplot" else None
    stats = [n for n in data.columns if n not in (x, series, "show_label", "window")]
    cells = F.array(
        *[F.struct(F.lit(n.lstrip("_")).alias("stat"), col(n).cast("double").alias("value")) for n in stats]
    )
    name = col(series).cast("string") if series else F.lit(None).cast("string")
    return data.select(col(x).cast("string").alias("x"), name.alias("series"), F.inline(cells))
