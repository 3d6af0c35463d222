"""The tables behind the charts.

Each function returns the numbers a chart shows as a tidy frame. Rows that lack one of
the plotted columns are left out, as plotting libraries do. Groupings combine on the map
side first, so a category that owns a third of the rows costs one row per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.functions.columns import (
    col, fresh, is_flat, is_numeric, is_temporal, number, present, quoted, require_columns, wall_clock,
)
from dataloupe.plans.joins import lookup_join
from dataloupe.plans.ordering import with_position
from dataloupe.plans.quantiles import PARTS, exact_quantiles
from dataloupe.plans.storage import materialize

# Interval width, whisker length, smallest share that gets a label, bandwidth
# factor and grid of violins, axis margins.
CONFIDENCE = 1.96
WHISKER = 1.5
LABEL_SHARE = 5
PAIR_BLOCK = 512  # values of either side that meet in one task when all pairs are asked for
POINTS = 200  # of a density curve
VIOLIN_BANDWIDTH = 0.5
VIOLIN_POINTS = 100
VIOLIN_CUT = 2
AXIS_LOW, AXIS_HIGH = 0.95, 1.05

# Spans in days below which each smoothing window, in rows, is used.
SMOOTHING = ((14, 3), (91, 7), (366, 14))
LONG_SMOOTHING = 30
DAY_BLOCK = 1024  # days that are put in order together

INFINITY = float("inf")
CELLS_PER_BANDWIDTH = 32
KERNEL_REACH = 8.5  # bandwidths; beyond it a kernel adds less than one part in 10^15


def _known(df: DataFrame, *names: str | None) -> tuple[DataFrame, list[str]]:
    """``df`` without rows that lack one of the columns, and the names that were given."""
    given = [n for n in names if n is not None]
    require_columns(df, *given)
    for n in given:
        df = df.where(present(df, n))
    return df, given


def _group(df: DataFrame, *names: str | None):
    rows, given = _known(df, *names)
    return rows.groupBy(*[quoted(n) for n in dict.fromkeys(given)])


# ---------------------------------------------------------------- distributions


def histogram(
    df: DataFrame, x: str, hue: str | None = None, max_bins: int | None = None
) -> DataFrame:
    """``([hue], bin, bin_start, bin_end, n)``: equal bins shared by all hues, empty ones left out.

    The bin width is the smaller of 2 IQR / n^(1/3) and range / (log2 n + 1), the latter alone
    if the IQR is 0. Outlying values can ask for any number of bins, of which at most one
    per row is not empty; a caller may set ``max_bins``, beyond which they are made wider.
    Infinite values have no bin and are left out. Figures whose name the hue has are underscored.
    """
    rows, _ = _known(df, x, hue)
    value = number(df, x)
    rows = rows.where(F.abs(value) < INFINITY)
    facts = exact_quantiles(rows.select(value.alias("_y")), "_y", [], {"q1": 0.25, "q3": 0.75})
    low, width, bins = bins_of(facts.first(), max_bins)
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    keys = [col(hue).alias("_hue")] if hue else []
    counted = rows.select(*keys, place.alias("_bin")).groupBy(*["_hue"] * bool(hue), "_bin")
    edge = F.lit(low) + F.col("_bin") * F.lit(width)
    return counted.agg(F.count(F.lit(1)).alias("_m")).select(
        *[F.col("_hue").alias(h) for h in [hue] if h],
        F.col("_bin").alias(fresh("bin", hue)),
        edge.alias(fresh("bin_start", hue)),
        (edge + F.lit(width)).alias(fresh("bin_end", hue)),
        F.col("_m").alias(fresh("n", hue)),
    )


def bins_of(facts, max_bins: int | None) -> tuple[float, float, int]:
    n, low, high = facts["n"], facts["min"], facts["max"]
    if not n:
        return 0.0, 1.0, 1
    if high == low:
        return low - 0.5, 1.0, 1
    width = (high - low) / (math.log2(n) + 1)
    if facts["q3"] > facts["q1"]:
        width = min(width, 2 * (facts["q3"] - facts["q1"]) / n ** (1 / 3))
    bins = math.ceil(min((high - low) / width, 2.0**62))
    bins = min(max_bins, bins) if max_bins else bins
    return low, (high - low) / bins, bins


def kde(
    df: DataFrame,
    x: str,
    by: str | list[str] | None = None,
    points: int = POINTS,
    bw_adjust: float = 1.0,
    cut: float = 0.0,
    common_grid: bool = True,
) -> DataFrame:
    """``([by], grid_no, grid_x, density)``: Gaussian density with Scott's bandwidth per group.

    The grid runs from the smallest to the largest value, widened by ``cut`` bandwidths,
    over all groups together or per group. Rows are first counted in cells of 1/32 bandwidth,
    each standing at the mean of its values; a cell is then added only to the grid points
    within its kernel's reach. The work after the first aggregate depends on the spread
    of the data, not on the number of rows. Groups without spread are left out.
    """
    given = [by] if isinstance(by, str) else list(by or [])
    rows, _ = _known(df, x, *given)
    keys = [f"_by{i}" for i in range(len(given))]
    rows = rows.select(*[col(k).alias(i) for k, i in zip(given, keys)], number(df, x).alias("_y"))
    rows = rows.where(F.abs("_y") < INFINITY)  # infinite values have no place on the grid
    if not given:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_y").alias("_low"),
        F.max("_y").alias("_high"),
        F.stddev_samp("_y").alias("_sd"),
    )
    settings = {"_bw": F.lit(bw_adjust), "_cut": F.lit(float(cut)), "_points": F.lit(points)}
    shape = densities(rows, keys, groups.withColumns(settings), [] if common_grid else keys)
    figures = ("grid_no", "grid_x", "density")
    return shape.select(
        *[F.col(i).alias(k) for k, i in zip(given, keys)], *[F.col(f).alias(fresh(f, *given)) for f in figures]
    )


def densities(rows: DataFrame, keys: list[str], groups: DataFrame, grid: list[str]) -> DataFrame:
    """``(keys, grid_no, grid_x, density)`` of the values ``_y`` of groups with bandwidth factor ``_bw``,
    ``_cut`` and ``_points`` of their own. Groups that are alike in ``grid`` share their grid."""
    spread = groups.where(F.col("_sd") > 0).withColumn(
        "_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)) * F.col("_bw")
    )
    margin = F.col("_cut") * F.col("_h")
    start, stop = F.col("_low") - margin, F.col("_high") + margin
    spread = materialize(spread.withColumns({"_start": start, "_stop": stop}))
    if set(grid) < set(keys) or not set(grid) <= set(keys):
        ends = [F.min("_start").alias("_start"), F.max("_stop").alias("_stop")]
        inner = spread.drop("_start", "_stop")
        if grid:
            shared = spread.groupBy(*grid).agg(*ends, F.count(F.lit(1)).alias("_groups"))
            spread = materialize(lookup_join(inner, shared, grid, "_groups").drop("_groups"))
        else:
            told = spread.agg(*ends).select(F.struct("_start", "_stop")).scalar()
            spread = inner.withColumn("_e", told).select("*", "_e.*").drop("_e")
    groups = spread.withColumn("_step", (F.col("_stop") - F.col("_start")) / (F.col("_points") - 1))
    groups = groups.select(*keys, "_n", "_low", "_h", "_start", "_step", "_points")
    cell = F.floor((F.col("_y") - F.col("_low")) / F.col("_h") * CELLS_PER_BANDWIDTH)
    cells = (
        lookup_join(rows.select(*keys, "_y"), groups, keys, "_n")
        .groupBy(*keys, "_h", "_start", "_step", "_points", cell.alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_m"), F.avg("_y").alias("_at"))
    )
    reach = F.lit(KERNEL_REACH) * F.col("_h")
    first = F.greatest(F.ceil((F.col("_at") - reach - F.col("_start")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_at") + reach - F.col("_start")) / F.col("_step")), F.col("_points") - 1)
    near = cells.where(first <= last).withColumn("grid_no", F.explode(F.sequence(first, last)))
    grid_x = F.col("_start") + F.col("grid_no") * F.col("_step")
    offset = (grid_x - F.col("_at")) / F.col("_h")
    sums = near.groupBy(*keys, "grid_no").agg(F.sum(F.col("_m") * F.exp(-offset * offset / 2)).alias("_w"))
    numbers = F.sequence(F.lit(0).cast("long"), (F.col("_points") - 1).cast("long"))
    every = groups.withColumn("grid_no", F.explode(numbers)).join(sums, [*keys, "grid_no"], "left")
    density = F.coalesce("_w", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return every.select(*keys, "grid_no", grid_x.alias("grid_x"), density.alias("density"))


def box_stats(df: DataFrame, x: str, y: str, hue: str | list[str] | None = None) -> DataFrame:
    """``(group, [hue], n, q1, median, q3, whisker_low, whisker_high, n_fliers)``.

    The categorical axis is the group: ``x``, or ``y`` if only ``x`` is numeric. Whiskers
    end at the outermost values within 1.5 IQR of the box. Columns whose name a hue has
    are underscored.
    """
    group, value = (y, x) if is_numeric(df, x) and not is_numeric(df, y) else (x, y)
    hues = [hue] if isinstance(hue, str) else list(hue or [])
    rows, _ = _known(df, group, value, *hues)
    inner = [f"_hue{i}" for i in range(len(hues))]
    rows = rows.select(
        col(group).alias("_group"),
        *[col(h).alias(i) for h, i in zip(hues, inner)],
        number(df, value).alias("_y"),
    )
    keys = ["_group", *inner]
    levels = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    boxes = exact_quantiles(rows, "_y", keys, levels).drop("min", "max", "sum")
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    inside = F.col("_y").between(F.col("q1") - reach, F.col("q3") + reach)
    found = (
        lookup_join(rows, boxes, keys, "n")
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("_y"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
    )
    figures = [fresh(n, *hues) for n in found.columns[len(keys) :]]
    return found.toDF(fresh("group", *hues), *hues, *figures)


def violin(df: DataFrame, x: str, y: str, facet: str | None = None) -> DataFrame:
    """``(group, [facet], grid_no, grid_x, density, q1, median, q3)``: half-bandwidth
    densities per category, each on its own grid, with the quartile lines."""
    rows, given = _known(df, x, y, facet)
    facets = given[2:]
    rows = rows.select(
        col(x).alias("_group"),
        *[col(f).alias("_facet") for f in facets],
        number(df, y).alias("_value"),
    ).where(F.abs("_value") < INFINITY)
    keys = ["_group", *["_facet"] * len(facets)]
    shape = kde(
        rows, "_value", keys, VIOLIN_POINTS, VIOLIN_BANDWIDTH, VIOLIN_CUT, common_grid=False
    )
    levels = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = exact_quantiles(rows, "_value", keys, levels).drop("n", "min", "max", "sum")
    found = shape.join(quartiles, keys)
    figures = [fresh(n, *facets) for n in found.columns[len(keys) :]]
    return found.toDF(fresh("group", *facets), *facets, *figures)


# ---------------------------------------------------------------- means and trends


def _means(df: DataFrame, x: str, y: str, hue: str | None) -> DataFrame:
    rows, given = _known(df, x, y, hue)
    names = list(dict.fromkeys([x, *given[2:]]))
    inner = [f"_key{i}" for i in range(len(names))]
    keys = [col(n).alias(i) for n, i in zip(names, inner)]
    stats = rows.select(*keys, number(df, y).alias("_y")).groupBy(*inner).agg(
        F.avg("_y").alias("_mean"),
        F.stddev_samp("_y").alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
    )
    half = F.lit(CONFIDENCE) * F.col("_sd") / F.sqrt("_n")
    return stats.select(
        *[F.col(i).alias(n) for i, n in zip(inner, names)],
        F.col("_mean").alias(fresh("mean", *names)),
        (F.col("_mean") - half).alias(fresh("ci_low", *names)),
        (F.col("_mean") + half).alias(fresh("ci_high", *names)),
        F.col("_n").alias(fresh("n", *names)),
    )


def bar_mean(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """``(x, [hue], mean, ci_low, ci_high, n)`` with the normal 95 % interval of the mean."""
    return _means(df, x, y, hue)


def line_mean(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """As :func:`bar_mean`, in the order of ``x``."""
    return _means(df, x, y, hue).orderBy(quoted(x))


def twin_line(df: DataFrame, x: str, y: str, y2: str) -> DataFrame:
    """``(x, y_mean, y2_mean)``: two means over the same x."""
    rows, _ = _known(df, x)
    require_columns(df, y, y2)
    picked = rows.select(col(x).alias("_x"), number(df, y).alias("_a"), number(df, y2).alias("_b"))
    means = picked.groupBy("_x").agg(F.avg("_a").alias("_mean_a"), F.avg("_b").alias("_mean_b"))
    return means.orderBy("_x").toDF(x, fresh("y_mean", x), fresh("y2_mean", x))


def rolling_window(span_days: int) -> int:
    """Smoothing window in rows for data that spans so many days."""
    return next((rows for end, rows in SMOOTHING if span_days < end), LONG_SMOOTHING)


def rolling_mean(
    df: DataFrame, x: str, y: str, by: str | None = None, *, span_days: int
) -> DataFrame:
    """``([by], x, y, rolling_y, window)``: mean of y over the current and the preceding rows.

    The window counts rows, starts with whatever is there, and restarts per group; rows
    with equal x are ordered by y. Rows get their global position, are cut into blocks of
    equal length, and each block is handed the last rows of the one before, so that no group
    or table is held by one task.
    """
    require_columns(df, x, y, by)
    rows, _ = _known(df, x, by)
    size = rolling_window(span_days)
    keys = ["_by"] if by else []
    group = [col(by).alias("_by")] if by else []
    picked = rows.select(*group, col(x).alias("_x"), number(df, y).alias("_y"))
    order = [*[F.asc(k) for k in keys], F.asc("_x"), F.asc_nulls_first("_y")]
    block = _block_rows(size)
    placed = with_position(picked, order, "_pos").withColumn(
        "_block", F.floor(F.col("_pos") / block)
    )
    tail = F.col("_pos") % block >= block - (size - 1)
    copies = F.when(tail, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(
        F.array(F.col("_block"))
    )
    spread = placed.withColumn("_home", F.col("_block")).withColumn("_block", F.explode(copies))
    within = W.partitionBy("_block", *keys).orderBy("_pos")
    done = spread.withColumn("_mean", _trailing(within, size)).where(
        F.col("_home") == F.col("_block")
    )
    names = [by, x] if by else [x]
    for figure in (y, "rolling_y", "window"):
        names.append(fresh(figure, *names))
    return done.select(*keys, "_x", "_y", "_mean", F.lit(size)).toDF(*names)


def rolling_mean_by_days(
    df: DataFrame, x: str, y: str, by: str | None = None, *, days: int = 7
) -> DataFrame:
    """``([by], x, y_mean, n, rolling_y, days)``: per day, the mean of its rows and the mean of all
    rows of the ``days`` calendar days that end with it; ``n`` counts the day's rows.

    Days without rows are no rows of the result, but they count as days of the window. Rows
    without a y count in ``n`` only; a mean of none is NULL. ``x`` comes back as midnight of the day.

    Rows are totalled per group and day on the map side first, so that a crowded day is one row
    per task. The days are cut into blocks of fixed length in time, and each block is handed the
    last days of the one before, so that no window holds more than ``DAY_BLOCK + days`` rows.
    """
    require_columns(df, x, y, by)
    if not is_temporal(df, x):
        raise ValueError(f"column {x!r} holds no dates or timestamps")
    if days < 1:
        raise ValueError("days must be at least 1")
    rows, _ = _known(df, x, by)
    keys = ["_by"] if by else []
    group = [col(by).alias("_by")] if by else []
    day = F.unix_date(wall_clock(x).cast("date")).alias("_day")
    totals = rows.select(*group, day, number(df, y).alias("_y")).groupBy(*keys, "_day").agg(
        F.sum("_y").alias("_sum"), F.count("_y").alias("_known"), F.count(F.lit(1)).alias("_n")
    )
    block = max(days, DAY_BLOCK)
    home = F.floor(F.col("_day") / block)
    tail = F.pmod("_day", F.lit(block)) > block - days
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = totals.withColumn("_home", home).withColumn("_block", F.explode(copies))
    within = W.partitionBy("_block", *keys).orderBy("_day").rangeBetween(-(days - 1), 0)
    rolled = F.sum("_sum").over(within) / F.nullif(F.sum("_known").over(within), F.lit(0))
    done = spread.withColumn("_mean", rolled).where(F.col("_home") == F.col("_block"))
    names = [by, x] if by else [x]
    for figure in ("y_mean", "n", "rolling_y", "days"):
        names.append(fresh(figure, *names))
    own = F.col("_sum") / F.nullif(F.col("_known"), F.lit(0))
    midnight = F.date_from_unix_date("_day").cast("timestamp_ntz")
    return done.select(*keys, midnight, own, "_n", "_mean", F.lit(days)).toDF(*names)


def _trailing(within, size: int) -> Column:
    return F.avg("_y").over(within.rowsBetween(-(size - 1), 0))


def _block_rows(size: int, wanted: int = 1_000_000) -> int:
    """Rows per block; at least the window, so that a block only needs its predecessor."""
    return max(size, wanted)


def events_over_time(df: DataFrame, x: str, unit: str | None = None) -> DataFrame:
    """``(x, n)``: rows per time, or per time truncated to ``unit``, in order."""
    if not is_temporal(df, x):
        raise ValueError(f"column {x!r} holds no dates or timestamps")
    rows, _ = _known(df, x)
    when = F.date_trunc(unit, wall_clock(x)).cast("timestamp_ntz") if unit else col(x)
    count = F.count(F.lit(1)).alias(fresh("n", x))
    counted = rows.select(when.alias(x)).groupBy(quoted(x)).agg(count)
    return counted.orderBy(quoted(x))


# ---------------------------------------------------------------- points, counts and shares


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    fraction: float | None = None,
    seed: int | None = None,
) -> DataFrame:
    """``(x, y, [color])``: the points; all of them unless a ``fraction`` is asked for."""
    rows, given = _known(df, x, y, color)
    points = rows.select([col(n) for n in dict.fromkeys(given)])
    return points if fraction is None else points.sample(fraction, seed)


def scatter_sample(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    *,
    per_color: int = 1000,
    key: list[str] | None = None,
) -> DataFrame:
    """``(x, y, [color])``: at most ``per_color`` points of each colour, the same at every run.

    The points with the smallest MD5 of ``key`` are taken, whose columns should tell rows apart;
    without it, of all columns but nested ones. Rows with one key are drawn together, in the
    order of x and y. Colours with fewer points keep all of them.

    Each task keeps the best of each colour, then each of at most 256 parts of the input, so that
    no task meets the choices of all others. Beyond 1000 points per colour (Spark's
    ``windowGroupLimitThreshold``) the tasks keep all, and the parts are sorted as a whole.
    """
    if per_color < 1:
        raise ValueError("per_color must be at least 1")
    require_columns(df, *(key or []))
    rows, given = _known(df, x, y, color)
    key = key or [n for n in df.columns if is_flat(df, n)]
    digest = F.md5(F.concat_ws("\x1f", *[col(n).cast("string") for n in key]))
    names = list(dict.fromkeys(given))
    places = {n: f"_{i}" for i, n in enumerate(names)}
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("_part")
    points = rows.select(*[col(n).alias(places[n]) for n in names], digest.alias("_key"), part)
    order = [F.asc("_key"), F.asc(places[x]), F.asc(places[y])]
    colors = [places[color]] if color else []

    def best(frame: DataFrame, groups: list[str]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
        return frame.withColumn("_rank", rank).where(F.col("_rank") <= per_color).drop("_rank")

    kept = best(points, [*colors, "_part"])
    kept = best(kept, colors) if colors else kept.orderBy(*order).limit(per_color)
    return kept.select(*[places[n] for n in names]).toDF(*names)


def scatter_cells(
    df: DataFrame, x: str, y: str, color: str | None = None, *, cells: int = 50
) -> DataFrame:
    """``([color], x_cell, y_cell, x_start, x_end, y_start, y_end, n)``: points per cell of a grid
    of ``cells`` by ``cells`` between the smallest and the largest values; only filled cells.

    Infinite values are in no cell. An axis with a single value has one cell, of width 0. The
    limits are a one-row subquery, and points are counted on the map side, so that a task sends
    at most ``cells * cells`` rows per colour.
    """
    if cells < 1:
        raise ValueError("cells must be at least 1")
    rows, _ = _known(df, x, y, color)
    keys = ["_color"] if color else []
    group = [col(color).alias("_color")] if color else []
    points = rows.select(*group, number(df, x).alias("_x"), number(df, y).alias("_y"))
    points = points.where((F.abs("_x") < INFINITY) & (F.abs("_y") < INFINITY))
    ends = [f(a).alias(f"{a}{side}") for a in ("_x", "_y") for f, side in ((F.min, 0), (F.max, 1))]
    limits = points.agg(F.struct(*ends).alias("_f")).scalar()
    located = points.withColumn("_f", limits).select(*keys, "_x", "_y", "_f.*")

    def cell(axis: str) -> Column:
        low, width = F.col(f"{axis}0"), F.col(f"{axis}1") - F.col(f"{axis}0")
        place = F.least(F.floor((F.col(axis) - low) / width * cells), F.lit(cells - 1))
        return F.when(width > 0, place).otherwise(0).cast("int").alias(f"{axis}_cell")

    ends = ["_x0", "_x1", "_y0", "_y1"]
    filled = located.select(*keys, cell("_x"), cell("_y"), *ends)
    counted = filled.groupBy(*keys, "_x_cell", "_y_cell", *ends).agg(F.count(F.lit(1)).alias("_n"))

    def edge(axis: str, steps: int) -> Column:
        low, high = F.col(f"{axis}0"), F.col(f"{axis}1")
        return low + (F.col(f"{axis}_cell") + steps) * (high - low) / cells

    figures = ["_x_cell", "_y_cell", *[edge(a, i) for a in ("_x", "_y") for i in (0, 1)], "_n"]
    names = [color] if color else []
    for figure in ("x_cell", "y_cell", "x_start", "x_end", "y_start", "y_end", "n"):
        names.append(fresh(figure, *names))
    return counted.select(*keys, *figures).toDF(*names)


def count_plot(df: DataFrame, x: str, hue: str | None = None) -> DataFrame:
    """``(x, [hue], n)``: rows per category."""
    return _group(df, x, hue).agg(F.count(F.lit(1)).alias(fresh("n", x, hue)))


def category_share(df: DataFrame, x: str, facet: str | None = None) -> DataFrame:
    """``(x, [facet], n, pct)``: rows per category and their share in %, in each facet."""
    counts = count_plot(df, x, facet)
    n = fresh("n", x, facet)
    pct = fresh("pct", x, facet)
    if facet is not None:
        inner = counts.toDF(*["_x", "_f"][: len(counts.columns) - 1], "_n")
        inner = inner if "_f" in inner.columns else inner.withColumn("_f", F.col("_x"))
        totals = inner.groupBy("_f").agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_cells"))
        share = (F.col("_n") / F.col("_total") * 100).alias(pct)
        names = ["_x", "_f"][: len(counts.columns) - 1]
        found = lookup_join(inner, totals, ["_f"], "_cells").select(*names, "_n", share)
        return found.toDF(*counts.columns, pct)
    # The counts are shuffled once: the total reads the same exchange.
    total = counts.agg(F.sum(col(n))).scalar()
    return counts.withColumn(pct, col(n) / total * 100)


def _all_pairs(xs: DataFrame, segments: DataFrame) -> DataFrame:
    """``(x, segment)`` for every two of them, met block by block: values are dealt by hash into
    blocks of about ``PAIR_BLOCK``, and each block goes once to every block of the other side."""
    xs, segments = materialize(xs), materialize(segments)
    n_x, n_s = (max(1, -(-df.count() // PAIR_BLOCK)) for df in (xs, segments))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n).cast("long"))

    left = xs.select("x", dealt("x", n_x).alias("_a"), blocks(n_s).alias("_b"))
    right = segments.select("segment", blocks(n_x).alias("_a"), dealt("segment", n_s).alias("_b"))
    return left.join(right.hint("shuffle_hash"), ["_a", "_b"]).select("x", "segment")


def composition(
    df: DataFrame, x: str, segment: str, zero_cells: bool = False, facet: str | None = None
) -> DataFrame:
    """``([facet], x, segment, n, pct, show_label)``: how each x divides into segments, in % of
    that x.

    ``zero_cells`` adds a row for every segment an x lacks: all pairs of an x and a segment,
    so it is meant for few of either.
    """
    if facet is not None:
        rows, _ = _known(df, x, segment, facet)
        keys = [col(facet).alias("facet"), col(x).alias("x"), col(segment).alias("segment")]
        counts = rows.select(*keys).groupBy("facet", "x", "segment").agg(F.count(F.lit(1)).alias("n"))
        totals = counts.groupBy("facet", "x").agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_cells"))
        share = F.col("n") / F.col("_total") * 100
        label = (share > LABEL_SHARE).alias("show_label")
        return lookup_join(counts, totals, ["facet", "x"], "_cells").select(
            F.col("facet").alias(fresh(facet, "x", "segment")), "x", "segment", "n", share.alias("pct"), label
        )
    require_columns(df, x, segment)
    rows, _ = _known(df, x, segment)
    pairs = rows.select(col(x).alias("x"), col(segment).alias("segment"))
    counts = pairs.groupBy("x", "segment").agg(F.count(F.lit(1)).alias("n"))
    if zero_cells:
        counts = materialize(counts)
        every = _all_pairs(counts.select("x").distinct(), counts.select("segment").distinct())
        counts = every.join(counts, ["x", "segment"], "left").fillna(0, ["n"])
    totals = counts.groupBy("x").agg(F.sum("n").alias("_total"), F.count("n").alias("_segments"))
    share = F.col("n") / F.col("_total") * 100
    joined = lookup_join(counts, totals, ["x"], "_segments")
    return joined.select(
        "x", "segment", "n", share.alias("pct"), (share > LABEL_SHARE).alias("show_label")
    )


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """``(y, x, mean)``: mean of the value per cell; cells without values are left out."""
    rows, _ = _known(df, x, y, value)
    cells = rows.select(col(y).alias("y"), col(x).alias("x"), number(df, value).alias("_v"))
    return cells.groupBy("y", "x").agg(F.avg("_v").alias("mean"))


# ---------------------------------------------------------------- axes


def axis_limits(df: DataFrame, y: str) -> DataFrame:
    """``(y_min, y_max, lo, hi)``: the range with 5 % off the minimum and on the maximum.

    A negative minimum moves inwards, a negative maximum too: the factor is applied as it is.
    """
    ends = df.select(number(df, y).alias("_y")).agg(F.min("_y").alias("y_min"), F.max("_y").alias("y_max"))
    return ends.select(
        "y_min",
        "y_max",
        (F.col("y_min") * AXIS_LOW).alias("lo"),
        (F.col("y_max") * AXIS_HIGH).alias("hi"),
    )


def scale_kind(df: DataFrame, y: str) -> DataFrame:
    """``(scale)``: 'log' if every value is positive, otherwise, also with nulls, 'symlog'."""
    positive = F.coalesce(number(df, y) > 0, F.lit(False))
    every = F.coalesce(F.every(positive), F.lit(True))
    return df.agg(F.when(every, "log").otherwise("symlog").alias("scale"))
