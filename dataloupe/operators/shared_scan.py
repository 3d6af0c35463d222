"""All charts of a battery from a fixed number of scans.

Every row is expanded to one small row per chart: the chart's number, its keys as text and its
values. Charts of a kind are then one aggregate whose first key is the chart's number:

* bars, lines, counts, pies, compositions and heatmaps: one grouped table;
* boxes, violins, histograms: one table of exact quartiles and moments, one of histogram bins, one of
  density cells, one of whiskers;
* scatters: the expanded rows themselves.

Outlier limits, one set per (y, colour), come from one more expansion, and so do the tails that are
folded. How many jobs run does not depend on how many charts there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import col, is_floating, is_numeric, number, present
from dataloupe.operators import charts
from dataloupe.operators.outliers import CLIP_LEVEL, TRIGGER, evidence_columns
from dataloupe.operators.topk import COVERAGE, MAX_K
from dataloupe.plans.joins import lookup_join, written_join
from dataloupe.plans.quantiles import exact_quantiles
from dataloupe.plans.storage import materialize
from dataloupe.specs import ChartSpec

GROUPED = ("line", "bar", "twin_line", "countplot", "pie", "stacked_bar", "heatmap")
SPREAD = ("histogram", "box", "violin")
INFINITY = float("inf")
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
# Entries of a chart in the table of quartiles: as the chart groups them, and as its densities do.
WHOLE, SHAPE = 0, 1


@dataclass(frozen=True)
class Chart:
    """One planned chart: its number, spec and type, and its outlier limits' number if it has any."""

    no: int
    spec: ChartSpec
    kind: str
    limit: int | None

    @property
    def folds(self) -> str:
        """The column whose tail is folded in this chart, and in no other part of it."""
        return self.spec.color_by or self.spec.x


def label(df: DataFrame, name: str, tops: dict[str, list]) -> Column:
    """A key as text, with the tail of a long one folded; equal values give equal texts."""
    c = col(name)
    if name in tops:
        return F.when(c.isin(tops[name]), c).otherwise(wording.OTHERS)
    return (c + F.lit(0.0) if is_floating(df, name) else c).cast("string")  # -0.0 is 0.0


def expanded(df: DataFrame, cells: list[Column]) -> DataFrame:
    """The fields of all structs that are not NULL, one row each. ``unpivot`` is planned as an Expand,
    which stays inside generated code, as no array is built."""
    names = [f"c{i}" for i in range(len(cells))]
    long = df.select(*[c.alias(n) for c, n in zip(cells, names)]).unpivot([], names, "of", "cell")
    return long.where(F.col("cell").isNotNull()).select("cell.*")


def shared_tops(df: DataFrame, names: list[str], metric: str) -> dict[str, list]:
    """The leading categories of each column by the metric's sum, as ``top_categories`` finds them."""
    if not names:
        return {}
    cells = [
        F.struct(F.lit(i).alias("i"), F.when(present(df, n), col(n)).alias("c"), number(df, metric).alias("y"))
        for i, n in enumerate(names)
    ]
    rows = expanded(df, cells).where("c is not null")
    totals = materialize(rows.groupBy("i", "c").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("total")))
    best = W.partitionBy("i").orderBy(F.desc("total"), F.asc("c"))
    # The rank limit is applied inside each partition before the shuffle; MAX_K rows per column.
    ranked = totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MAX_K)
    grand = F.broadcast(totals.groupBy("i").agg(F.sum("total").alias("grand")))
    out: dict[str, list] = {n: [] for n in names}
    reached = dict.fromkeys(names, 0.0)
    for r in ranked.join(grand, "i").orderBy("i", "rank").collect():
        name = names[r["i"]]
        if r["grand"] and reached[name] / r["grand"] >= COVERAGE:
            continue
        out[name].append(r["c"])
        reached[name] += r["total"]
    return out


def shared_limits(df: DataFrame, pairs: list[tuple[str, str | None]], tops: dict[str, list]) -> tuple[DataFrame, DataFrame]:
    """The values of each pair (y, colour) as ``(lim, grp, y)``, and the limits of the groups that
    trigger, ``(lim, grp, n, p99, max, sum)``, written."""
    cells = []
    for i, (y, by) in enumerate(pairs):
        # Folding leaves no row without a group.
        known = present(df, y) if by is None or by in tops else present(df, y) & present(df, by)
        group = F.lit("") if by is None else label(df, by, tops)
        cells.append(F.when(known, F.struct(F.lit(i).alias("lim"), group.alias("grp"), number(df, y).alias("y"))))
    rows = expanded(df, cells)
    found = exact_quantiles(rows, "y", ["lim", "grp"], {"p99": CLIP_LEVEL})
    return rows, materialize(found.where((F.col("p99") > 0) & (F.col("max") > TRIGGER * F.col("p99"))))


def shared_evidence(rows: DataFrame, limits: DataFrame, pairs: list[tuple[str, str | None]], plan: list[Chart]) -> DataFrame:
    """The evidence of every chart with limits, under its number."""
    above = written_join(rows, limits, ["lim", "grp"], "n").where("y > p99")
    hidden = above.groupBy("lim", "grp", "n", "p99", "max", "sum").agg(
        F.count(F.lit(1)).alias("outlier_count"), F.sum("y").alias("outlier_sum")
    )
    whole = [i for i, (_, by) in enumerate(pairs) if by is None]
    named = F.when(F.col("lim").isin(whole), wording.GLOBAL_GROUP).otherwise(F.col("grp"))
    texts = [wording.template(wording.OUTLIER_SUMMARY, y) for y, _ in pairs]
    told = evidence_columns(hidden.withColumn("group", named), lambda *args: _per_limit(texts, args), "lim")
    of = rows.sparkSession.createDataFrame([(c.no, c.limit) for c in plan if c.limit is not None], "chart_no int, lim int")
    return told.join(F.broadcast(of), "lim").drop("lim")  # one row per chart


def _per_limit(texts: list[str], args: tuple) -> Column:
    said = F.lit(None)
    for i, text in enumerate(texts):
        said = F.when(F.col("lim") == i, F.format_string(text, *args)).otherwise(said)
    return said


class Shared:
    """The expanded rows of the planned charts of one table."""

    def __init__(self, df: DataFrame, plan: list[Chart], pairs: list, tops: dict, limits: DataFrame | None):
        self.df, self.plan, self.pairs, self.tops, self.limits = df, plan, pairs, tops, limits

    def rows(self, entries: list[tuple[Chart, int, Column, dict[str, Column]]]) -> DataFrame:
        """``(no, part, k1, k2, v1, v2)``, without what lies above its group's limit."""
        nothing, text = F.lit(None).cast("double"), F.lit("")
        cells = []
        for chart, part, known, values in entries:
            y, by = self.pairs[chart.limit] if chart.limit is not None else (None, None)
            group = F.lit("") if by is None else label(self.df, by, self.tops)
            cells.append(
                F.when(known, F.struct(
                    F.lit(chart.no).alias("no"), F.lit(part).alias("part"),
                    F.lit(chart.limit).cast("int").alias("lim"), group.alias("grp"),
                    (number(self.df, y) if y else nothing).alias("y"),
                    values.get("k1", text).alias("k1"), values.get("k2", text).alias("k2"),
                    values.get("v1", nothing).alias("v1"), values.get("v2", nothing).alias("v2"),
                ))
            )
        rows = expanded(self.df, cells)
        if self.limits is not None:
            bounds = self.limits.select("lim", "grp", "p99", "n")
            rows = written_join(rows, bounds, ["lim", "grp"], "n", "left")
            rows = rows.where("p99 is null or y is null or y <= p99")
        return rows.select("no", "part", "k1", "k2", "v1", "v2")

    def of_kind(self, *kinds: str) -> list[Chart]:
        return [c for c in self.plan if c.kind in kinds]

    def known(self, c: Chart, *names: str | None) -> Column:
        """Whether a row has all these columns; folding leaves no row without a category."""
        needed = [n for n in names if n is not None and not (n == c.folds and n in self.tops)]
        return reduce(lambda a, b: a & b, [present(self.df, n) for n in needed], F.lit(True))

    def text(self, c: Chart, name: str | None) -> Column:
        if name is None:
            return F.lit("")
        return label(self.df, name, self.tops if name == c.folds else {})

    # ------------------------------------------------------------ grouped charts

    def grouped(self) -> list[DataFrame]:
        plan = self.of_kind(*GROUPED)
        if not plan:
            return []
        rows = self.rows([(c, WHOLE, *self._grouped_entry(c)) for c in plan])
        found = materialize(
            rows.groupBy("no", "k1", "k2").agg(
                F.count(F.lit(1)).alias("n"), F.avg("v1").alias("mean"),
                F.stddev_samp("v1").alias("sd"), F.avg("v2").alias("mean2"),
            )
        )
        half = F.lit(charts.CONFIDENCE) * F.col("sd") / F.sqrt("n")
        means = {"mean": F.col("mean"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "n": F.col("n")}
        tables = []
        for kind, chosen, stats in (
            ("mean", [c for c in plan if c.kind in ("line", "bar") and c.spec.y], means),
            ("count", [c for c in plan if c.kind == "countplot" or c.kind == "line" and not c.spec.y], {"n": F.col("n")}),
            ("twin", self.of_kind("twin_line"), {"y_mean": F.col("mean"), "y2_mean": F.col("mean2")}),
            ("heat", self.of_kind("heatmap"), {"mean": F.col("mean")}),
        ):
            if chosen:
                tables.append(_tidy(found.where(_is_one_of(chosen)), stats, _series(chosen)))
        if shares := self.of_kind("pie", "stacked_bar"):
            # A pie is a share of its chart, a composition of its x.
            pies = [c.no for c in shares if c.kind == "pie"]
            whole = F.when(F.col("no").isin(pies), "").otherwise(F.col("k1"))
            counts = found.where(_is_one_of(shares)).withColumn("of", whole)
            totals = counts.groupBy("no", "of").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
            joined = lookup_join(counts, totals, ["no", "of"], "cells")
            tables.append(_tidy(joined, {"n": F.col("n"), "pct": F.col("n") / F.col("total") * 100}, _series(shares)))
        return tables

    def _grouped_entry(self, c: Chart) -> tuple[Column, dict[str, Column]]:
        x, y, color = c.spec.x, c.spec.y, c.spec.color_by
        match c.kind:
            case "line" if y is None:
                return self.known(c, x), {"k1": self.text(c, x)}
            case "line" | "bar":
                values = {"k1": self.text(c, x), "v1": number(self.df, y)}
                # A colour that is x itself does not divide further.
                return self.known(c, x, y, color), values | ({"k2": self.text(c, color)} if color else {})
            case "twin_line":
                return self.known(c, x), {"k1": self.text(c, x), "v1": number(self.df, y), "v2": number(self.df, color)}
            case "countplot":
                return self.known(c, x, color), {"k1": self.text(c, x), "k2": self.text(c, color)}
            case "pie":
                return self.known(c, x), {"k1": self.text(c, x)}
            case "heatmap":
                return self.known(c, x, y, color), {"k1": self.text(c, x), "k2": self.text(c, y), "v1": number(self.df, color)}
        segment = color or y
        return self.known(c, x, segment), {"k1": self.text(c, x), "k2": self.text(c, segment)}

    # ------------------------------------------------------------ points

    def points(self) -> list[DataFrame]:
        plan = self.of_kind("scatter")
        if not plan:
            return []
        entries = [
            (c, WHOLE, self.known(c, c.spec.x, c.spec.y, c.spec.color_by),
             {"k1": self.text(c, c.spec.x), "k2": self.text(c, c.spec.color_by), "v1": number(self.df, c.spec.y)})
            for c in plan
        ]
        stat = F.lit(None)
        for c in plan:
            stat = F.when(F.col("no") == c.no, c.spec.y.lstrip("_")).otherwise(stat)
        series = F.when(F.col("no").isin(_series(plan)), F.col("k2"))
        return [self.rows(entries).select("no", F.col("k1").alias("x"), series.alias("series"), stat.alias("stat"), F.col("v1").alias("value"))]

    # ------------------------------------------------------------ distributions

    def spread(self) -> list[DataFrame]:
        plan = self.of_kind(*SPREAD)
        if not plan:
            return []
        rows = self.rows([e for c in plan for e in self._spread_entries(c)]).drop("v2")
        keys = ["no", "part", "k1", "k2"]
        facts = materialize(exact_quantiles(rows, "v1", keys, QUARTILES, [F.stddev_samp("v1").alias("sd")]))
        tables = []
        if self.of_kind("box"):
            tables.append(self._boxes(rows, facts, keys))
        if histograms := self.of_kind("histogram"):
            tables.append(self._bins(rows, facts, histograms))
        if shaped := self.of_kind("histogram", "violin"):
            tables += self._shapes(rows, facts, keys, shaped)
        return tables

    def _spread_entries(self, c: Chart) -> list[tuple[Chart, int, Column, dict[str, Column]]]:
        x, y, color = c.spec.x, c.spec.y, c.spec.color_by
        if c.kind == "histogram":
            value = number(self.df, x)
            known = self.known(c, x, color) & (F.abs(value) < INFINITY)
            # The colour is on both; bins are shared by all colours, so their facts are of part WHOLE
            # without it.
            return [(c, WHOLE, known, {"v1": value}), (c, SHAPE, known, {"k2": self.text(c, color), "v1": value})]
        if c.kind == "violin":
            value = number(self.df, y)
            return [(c, SHAPE, self.known(c, x, y) & (F.abs(value) < INFINITY), {"k1": self.text(c, x), "v1": value})]
        group, value = (y, x) if is_numeric(self.df, x) and not is_numeric(self.df, y) else (x, y)
        values = {"k1": self.text(c, group), "k2": self.text(c, color), "v1": number(self.df, value)}
        return [(c, WHOLE, self.known(c, group, value, color), values)]

    def _boxes(self, rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
        plan = self.of_kind("box")
        boxes = facts.where(_is_one_of(plan)).drop("min", "max", "sum", "sd")
        reach = F.lit(charts.WHISKER) * (F.col("q3") - F.col("q1"))
        inside = F.col("v1").between(F.col("q1") - reach, F.col("q3") + reach)
        found = written_join(rows.where(_is_one_of(plan)), materialize(boxes), keys, "n").groupBy(*keys, "n", *QUARTILES).agg(
            F.min(F.when(inside, F.col("v1"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v1"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_fliers"),
        )
        stats = {n: F.col(n) for n in ("n", *QUARTILES, "whisker_low", "whisker_high", "n_fliers")}
        return _tidy(found, stats, _series(plan))

    def _bins(self, rows: DataFrame, facts: DataFrame, plan: list[Chart]) -> DataFrame:
        # One row per histogram.
        known = facts.where(_is_one_of(plan) & (F.col("part") == WHOLE)).collect()
        bins = [(r["no"], *charts.bins_of(r, None)) for r in known]
        edges = F.broadcast(rows.sparkSession.createDataFrame(bins, "no int, low double, width double, bins long"))
        place = F.least(F.floor((F.col("v1") - F.col("low")) / F.col("width")), F.col("bins") - 1)
        counted = (
            rows.where(_is_one_of(plan) & (F.col("part") == SHAPE)).join(edges, "no")
            .groupBy("no", "k2", "low", "width", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        )
        start = F.col("low") + F.col("bin") * F.col("width")
        stats = {"bin_start": start, "bin_end": start + F.col("width"), "n": F.col("n")}
        return _tidy(counted.withColumn("k1", F.col("bin").cast("string")), stats, _series(plan))

    def _shapes(self, rows: DataFrame, facts: DataFrame, keys: list[str], plan: list[Chart]) -> list[DataFrame]:
        here = _is_one_of(plan) & (F.col("part") == SHAPE)
        violins = [c.no for c in plan if c.kind == "violin"]
        violin = F.col("no").isin(violins)
        groups = facts.where(here).select(
            *keys, F.col("n").alias("_n"), F.col("min").alias("_low"), F.col("max").alias("_high"), F.col("sd").alias("_sd"),
            F.when(violin, charts.VIOLIN_BANDWIDTH).otherwise(1.0).alias("_bw"),
            F.when(violin, charts.VIOLIN_CUT).otherwise(0).cast("double").alias("_cut"),
            F.when(violin, charts.VIOLIN_POINTS).otherwise(charts.POINTS).alias("_points"),
            # Violins have grids of their own, the colours of a histogram share one.
            F.when(violin, F.col("k1")).otherwise("").alias("_grid"),
        )
        shape = charts.densities(rows.where(here).withColumnRenamed("v1", "_y"), keys, groups, ["no", "_grid"])
        tables = []
        number_of = F.col("grid_no").cast("string")
        curve = {"grid_x": F.col("grid_x"), "density": F.col("density")}
        if histograms := [c for c in plan if c.kind == "histogram"]:
            curves = shape.where(_is_one_of(histograms)).withColumn("k1", number_of)
            tables.append(_tidy(curves, curve, _series(histograms)))
        if violins:
            lines = facts.where(here & violin).select("no", "k1", *QUARTILES)
            curves = shape.where(violin).join(lines, ["no", "k1"]).withColumn("k2", number_of)
            tables.append(_tidy(curves, curve | {n: F.col(n) for n in QUARTILES}, violins))
        return tables


def _is_one_of(plan: list[Chart]) -> Column:
    return F.col("no").isin([c.no for c in plan])


def _series(plan: list[Chart]) -> list[int]:
    """The charts whose second key is a series."""
    return [
        c.no for c in plan
        if c.kind in ("stacked_bar", "heatmap")
        or c.spec.color_by and c.kind not in ("pie", "twin_line") and (c.spec.y or c.kind in ("countplot", "histogram"))
    ]


def _tidy(found: DataFrame, stats: dict[str, Column], series: list[int]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("stat"), c.cast("double").alias("value")) for n, c in stats.items()]
    name = F.when(F.col("no").isin(series), F.col("k2"))
    return found.select("no", F.col("k1").alias("x"), name.alias("series"), F.inline(F.array(*cells)))
