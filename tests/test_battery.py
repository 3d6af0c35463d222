import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

import dataloupe as dl
from dataloupe import ChartSpec, Tweak
from dataloupe.operators import battery


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(1200).select(
        F.timestamp_seconds(F.col("id") * 7200).cast("timestamp_ntz").alias("t"),
        (F.col("id") * 37 % 101).cast("double").alias("num"),
        (F.col("id") * 53 % 97).cast("double").alias("num2"),
        (F.col("id") % 3).alias("few"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("cat"),
        F.concat(F.lit("d"), F.col("id") % 4).alias("cat2"),
        F.concat(F.lit("w"), F.col("id") % 11).alias("wide"),
        F.concat(F.lit("l"), F.col("id") % 40).alias("long"),
        (F.col("id") % 2 == 0).alias("flag"),
    )


CHOICES = [
    (("t", "num", None), "line"),
    (("t", "num", "cat"), "line"),
    (("t", "num", "num2"), "twin_line"),
    (("t", None, None), "line"),
    (("t", "cat", None), "stacked_bar"),
    (("num", None, None), "histogram"),
    (("few", None, None), "histogram"),
    (("cat", None, None), "pie"),
    (("wide", None, None), "countplot"),
    (("flag", None, None), "pie"),
    (("num", "num2", None), "scatter"),
    (("num", "num2", "cat"), "scatter"),
    (("num", "cat", None), "box"),
    (("cat", "num", None), "violin"),
    (("cat", "num", "cat2"), "box"),
    (("cat", "cat2", "num"), "heatmap"),
    (("cat", "cat2", "wide"), "stacked_bar"),
    (("cat", "flag", None), "stacked_bar"),
]


def test_choose_chart(table):
    got = dl.choose_chart(table, [ChartSpec(*c) for c, _ in CHOICES], ["t"]).collect()
    assert [(tuple(r)[:3], r["chart_type"]) for r in got] == CHOICES
    assert dl.chart_types(table.limit(1000), [ChartSpec("cat", "num")]) == ["box"]
    assert dl.chart_types(table.limit(1001), [ChartSpec("cat", "num")]) == ["violin"]
    assert dl.chart_types(table, [ChartSpec("t", "num")]) == ["violin"]  # not declared as time
    with pytest.raises(ValueError, match="unknown"):
        dl.chart_types(table, [ChartSpec("nope")])


@pytest.mark.parametrize("choice, chart_type", CHOICES)
def test_every_type_has_data(table, choice, chart_type):
    spec = ChartSpec(*choice)
    result = dl.run_chart(table, spec, ["t"], "num")
    assert result.chart_type == chart_type
    tidy = dl.tidy_chart(result.data, spec, chart_type)
    assert tidy.columns == ["x", "series", "stat", "value"] and tidy.count() > 0


def test_fold_tail(table):
    folded = dl.fold_tail(table, ChartSpec("long"), "num")
    assert folded.select("long").distinct().count() <= 13
    assert folded.where("long = 'Others'").count() > 0
    assert folded.count() == table.count()
    for spec, metric in ((ChartSpec("wide"), "num"), (ChartSpec("long"), "cat"), (ChartSpec("long"), None),
                         (ChartSpec("long", color_by="cat"), "num")):
        assert dl.fold_tail(table, spec, metric) is table


def test_order_fold_then_outliers_then_chart(spark):
    """A spike in a rare category: after folding it is an outlier of 'Others'."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 2600, F.concat(F.lit("m"), F.col("id") % 10))
        .otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") == 2999, 5000.0).otherwise((F.col("id") % 9 + 1).cast("double")).alias("y"),
        F.lit(1.0).alias("w"),
    )
    result = dl.run_chart(df, ChartSpec("k", "y", "k"), [], "w")
    (row,) = result.evidence.collect()
    assert row["group"] == "Others" and row["outlier_count"] == 1
    data = {r["group"]: r for r in result.data.collect()}
    assert data["Others"]["n"] == 400 - 2 * 8 - 1 and data["Others"]["whisker_high"] == 9.0


def test_tweaks(table, caplog):
    rolled = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("rolling_mean"))
    assert rolled.chart_type == "rolling_mean" and rolled.data.first()["window"] == 14
    kept = dl.run_chart(table, ChartSpec("cat", "num"), ["t"], "num", Tweak("rolling_mean"))
    assert kept.chart_type == "violin"
    limits = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("unpin_y_zero")).axis.first()
    assert tuple(limits) == (0.0, 100.0, 0.0, 105.0)
    scale = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("log_scale")).axis.first()
    assert scale["scale"] == "symlog"
    coloured = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("color_by_segment", color_by="cat"))
    assert "cat" in coloured.data.columns
    already = dl.run_chart(table, ChartSpec("t", "num", "cat2"), ["t"], "num", Tweak("color_by_segment", color_by="cat"))
    assert "cat2" in already.data.columns
    with caplog.at_level(logging.WARNING):
        assert dl.run_chart(table, ChartSpec("cat", "cat2"), [], "num", Tweak("log_scale")).axis is None
        assert dl.run_chart(table, ChartSpec("cat"), [], "num", Tweak("log_scale")).axis is None
    assert "not numeric" in caplog.text
    kept = dl.run_chart(table, ChartSpec("cat"), [], "num", Tweak("rolling_mean"))
    assert kept.chart_type == "pie"
    assert dl.run_chart(table, ChartSpec("cat"), [], "num", Tweak("facet_grid")).chart_type == "pie"
    with pytest.raises(ValueError, match="unknown tweak"):
        Tweak("sparkle")


def test_facets(table):
    kind, data = dl.facet(table, "t", "num", "cat", ["t"])
    assert kind == "line" and data.select("cat").distinct().count() == 3
    kind, data = dl.facet(table, "cat", "num", "cat2")
    assert kind == "violin" and data.select("cat2").distinct().count() == 4
    assert dl.facet(table, "num", "num2", "num")[0] == "scatter"
    assert dl.facet(table, "t", "num", "num2", ["t"])[0] == "scatter"
    assert dl.facet(table, "t", "num", "few", ["t"])[0] == "line"
    assert dl.facet(table, "cat", "num", "num")[0] == "scatter"
    kind, data = dl.facet(table, "cat", "cat2", "few")
    assert kind == "stacked_bar" and data.columns == ["few", "x", "segment", "n", "pct", "show_label"]
    assert data.groupBy("few", "x").agg(F.sum("pct").alias("p")).where("abs(p - 100) > 1e-9").count() == 0
    kind, data = dl.facet(table, "num", None, "cat")
    assert kind == "histogram" and data.select("cat").distinct().count() == 3
    kind, data = dl.facet(table, "cat", None, "cat2")
    assert kind == "pie" and data.groupBy("cat2").agg(F.sum("pct").alias("p")).where("abs(p - 100) > 1e-9").count() == 0
    counted = dl.run_chart(table, ChartSpec("wide"), [], "num", Tweak("facet_grid", facet_by="cat"))
    assert counted.chart_type == "countplot" and counted.data.columns == ["wide", "cat", "n"]
    split = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("facet_grid", facet_by="cat"))
    assert split.chart_type == "line" and "cat" in split.data.columns
    own = dl.run_chart(table, ChartSpec("t", "num"), ["t"], "num", Tweak("facet_grid"))
    assert own.chart_type == "scatter"


def test_chart_queries(table):
    total = dl.run_chart_query(table, ["cat"], ["num", "num2"]).orderBy("cat").collect()
    assert total[0].asDict().keys() == {"cat", "sum_num", "sum_num2"}
    assert dl.run_chart_query(table, [], ["num"], "count").first()[0] == 1200
    assert dl.run_chart_query(table, ["cat"], [], None).count() == 1200
    assert dl.run_chart_query(table, ["cat", "flag"], []).count() == 6
    with pytest.raises(ValueError, match="agg"):
        dl.run_chart_query(table, ["cat"], ["num"], "median")
    with pytest.raises(ValueError, match="not numeric"):
        dl.run_chart_query(table, ["cat"], ["cat2"], "sum")
    cases = {
        "pie": (ChartSpec("cat"), ["cat", "count_cat"]),
        "heatmap": (ChartSpec("cat", "cat2", "num"), ["cat", "cat2", "mean_num"]),
        "stacked_bar": (ChartSpec("cat", "cat2", "wide"), ["cat", "cat2", "count_cat2"]),
        "bar": (ChartSpec("cat", "cat2", "wide"), ["cat", "wide", "count_cat2"]),
        "countplot": (ChartSpec("cat"), ["cat"]),
        "twin_line": (ChartSpec("t", "num", "num2"), ["t", "sum_num", "sum_num2"]),
        "scatter": (ChartSpec("num", "num2", "cat"), ["num", "num2", "cat"]),
        "violin": (ChartSpec("cat", "num"), ["cat", "num"]),
    }
    for chart_type, (spec, names) in cases.items():
        assert dl.explorer_query(table, spec, chart_type).columns == names, chart_type


def test_plan_battery():
    specs = [
        ChartSpec("a", "b", "c", 7), ChartSpec("a", score=6), ChartSpec("a", "b", score=9), ChartSpec("z", score=8),
        ChartSpec("a", "b", "c", 10), ChartSpec("a", None, "c", 7), ChartSpec("y", score=7),
    ]
    planned = dl.plan_battery(specs)
    assert [(s.x, s.y, s.color_by, s.score) for s in planned] == [
        ("z", None, None, 8), ("y", None, None, 7), ("a", "b", None, 9), ("a", None, "c", 7), ("a", "b", "c", 7),
    ]
    assert [s.level for s in planned] == ["univariate"] * 2 + ["bivariate"] * 2 + ["multivariate"]


def test_battery(table, plans, tmp_path, spark):
    specs = [ChartSpec(*c) for c, _ in CHOICES if c[1] != "flag"]
    data, evidence = dl.chart_battery(table, specs, ["t"], "num")
    assert data.columns == ["chart_no", "level", "chart_type", "x", "series", "stat", "value"]
    assert data.select("chart_no").distinct().count() == len(specs)
    assert evidence.count() == len(specs)
    assert evidence.select("summary").distinct().collect()[0][0] == "No significant outliers."
    dl.write_results(data, str(tmp_path / "battery"), "parquet")
    assert spark.read.parquet(str(tmp_path / "battery")).count() == data.count()
    with pytest.raises(ValueError, match="scores above"):
        dl.chart_battery(table, [ChartSpec("cat", score=3)])


FINDINGS = "run int, id int, quality_score int, strategic_score int, is_spurious boolean, suggested_tweak string, tweak_repeated boolean"


def test_triage(frame):
    rows = [
        (1, 1, 6, 6, False, None, None),         # good
        (1, 2, 9, 5, False, None, False),        # not good, and the run has a good one
        (1, 3, 9, 9, True, None, False),         # spurious
        (1, 4, 9, 9, False, "log_scale", False),  # for another round
        (1, 5, 7, 7, True, "log_scale", True),   # had its tweak: stands
        (1, 6, 7, 5, False, "log_scale", True),  # had its tweak: too weak
        (2, 7, 5, 9, False, None, False),        # no good one in this run: all stay
        (2, 8, 1, 1, False, None, False),
        (3, 9, 9, 9, True, None, False),
    ]
    df = frame(FINDINGS, rows)
    assert sorted(r["id"] for r in dl.triage_findings(df, "run").collect()) == [1, 5, 7, 8]
    plain = df.drop("suggested_tweak", "tweak_repeated")
    assert sorted(r["id"] for r in dl.triage_findings(plain, "run").collect()) == [1, 4, 7, 8]
    outcomes = {r[0]: r[1] for r in df.select("id", dl.finding_outcome(df)).collect()}
    assert outcomes == {1: "complete", 2: "complete", 3: "drop", 4: "retry", 5: "complete", 6: "drop",
                        7: "complete", 8: "complete", 9: "drop"}


def test_whole_analysis(spark, tmp_path):
    """From a CSV to chart data, evidence and summary."""
    lines = ["Sold on,Unit price,Units,Kind,Kind"]
    start = dt.date(2022, 1, 1)
    for i in range(400):
        price = "n/a" if i == 7 else 5000 if i == 399 else 10 + i % 13
        lines.append(f"{start + dt.timedelta(days=i)},{price},{1 + i % 5},k{i % 4},s{i % 2}")
    lines.append(lines[1])
    path = tmp_path / "sales.csv"
    path.write_text("\n".join(lines))

    raw = dl.read_table(spark, str(path))
    cleaned, report = dl.clean(raw)
    assert (report.null_cells, report.duplicate_rows, report.rows_after) == (1, 1, 399)
    plan = dl.ProcessingPlan(("Kind_1",), ("Sold_on",), {"Unit_price": "price", "Sold_on": "day"})
    table = dl.apply_processing_plan(cleaned, plan)
    table, added = dl.apply_recipes(
        table,
        [dl.FeatureRecipe("multiplication", "revenue", "price", "Units"), dl.FeatureRecipe("temporal", None, "day")],
        ["day"],
    )
    assert added == ["revenue", "day_month", "day_year"]
    types = {r["column"]: r["semantic_type"] for r in dl.profile(table).collect()}
    assert types["day"] == "TEMPORAL" and types["revenue"] == "NUMERICAL" and types["Units"] == "CATEGORICAL"
    specs = [ChartSpec("day", "revenue"), ChartSpec("Kind", "revenue", "Kind"), ChartSpec("day_month")]
    data, evidence = dl.chart_battery(table, specs, ["day"], "revenue")
    found = {r["chart_no"]: r["group"] for r in evidence.collect()}
    assert found == {1: None, 2: "Global", 3: "k3"}
    assert data.where("chart_type = 'line' AND stat = 'mean'").agg(F.max("value")).first()[0] < 200
    assert dl.forensic_summary(table, "revenue").count() == 3


def test_sharing_changes_no_chart(table):
    """A dictionary shared by charts of other columns and metrics gives what each gives alone."""
    shared = {}
    for spec, metric in (
        (ChartSpec("wide"), "num"), (ChartSpec("long"), "num"), (ChartSpec("cat", "num", "long"), "num"),
        (ChartSpec("cat", "num", "long"), "num2"), (ChartSpec("long"), None),
    ):
        together = dl.run_chart(table, spec, [], metric, shared=shared)
        alone = dl.run_chart(table, spec, [], metric)
        assert sorted(map(str, together.data.collect())) == sorted(map(str, alone.data.collect()))


def test_names_of_figures_and_helpers_may_be_columns(spark):
    """Result columns step aside for key columns of the same name."""
    df = spark.range(60).selectExpr(
        "concat('c', id % 3) AS n", "concat('g', id % 2) AS `group`", "concat('b', id % 2) AS bin",
        "concat('t', id % 4) AS total", "concat('x', id % 2) AS x", "double(id % 7) AS v",
        "timestamp_ntz '2024-01-01' + make_dt_interval(id % 9) AS mean",
    )
    assert dl.count_plot(df, "n").columns == ["n", "_n"]
    assert dl.line_mean(df, "n", "v").columns == ["n", "mean", "ci_low", "ci_high", "_n"]
    assert dl.line_mean(df, "mean", "v", "n").count() == 9 * 1 * 1 * 3 - 18
    assert dl.category_share(df, "n").columns == ["n", "_n", "pct"]
    assert dl.box_stats(df, "x", "v", "group").columns[:2] == ["_group", "group"]
    assert dl.violin(df, "x", "v", "group").columns[:2] == ["_group", "group"]
    assert dl.histogram(df, "v", "bin").columns == ["bin", "_bin", "bin_start", "bin_end", "n"]
    assert dl.category_pareto(df, "total", "v").columns[:2] == ["total", "_total"]
    assert dl.top_k_others(df, "total", "v").count() == 60
    whole = dl.composition(df, "x", "n", zero_cells=True)
    assert whole.count() == 6 and dict(whole.dtypes)["segment"] == "string"
    specs = [ChartSpec("n"), ChartSpec("n", "v"), ChartSpec("v", color_by="bin"), ChartSpec("x", "v", "group"),
             ChartSpec("x", "n", "total")]
    data, _ = dl.chart_battery(df, specs, [], "v")
    assert {"n", "pct", "density", "median"} <= {r[0] for r in data.select("stat").distinct().collect()}


def test_segments_that_differ_by_case(frame):
    df = frame("x int, s string", [(1, "a"), (1, "A"), (2, "x")])
    got = dl.composition(df, "x", "s", zero_cells=True)
    assert got.count() == 6 and got.where("n = 0").count() == 3
    numbers = frame("x int, s int", [(1, 7), (2, 8)])
    assert dict(dl.composition(numbers, "x", "s", zero_cells=True).dtypes)["segment"] == "int"


def test_histograms_carry_their_density(table):
    data, evidence = dl.chart_battery(table, [ChartSpec("num"), ChartSpec("cat", "num"), ChartSpec("cat", "cat2")], [], "num")
    curve = data.where("chart_type = 'histogram' AND stat = 'density'").toPandas()
    want = dl.kde(table, "num").toPandas()
    assert sorted(curve["value"]) == pytest.approx(sorted(want["density"]))
    flags = {r["chart_no"]: (r["data_type"], r["outlier_clipped"]) for r in evidence.collect()}
    assert flags == {1: ("non_numeric", False), 2: ("numeric", False), 3: ("non_numeric", False)}


def test_triage_rules_and_history(frame):
    schema = ("run string, round int, x string, y string, chart_color string, suggested_tweak string, "
              "color_by string, facet_by string, quality_score int, strategic_score int, is_spurious boolean")
    rows = [
        ("r1", 1, "a", "b", None, "log_scale", None, None, 7, 7, False),        # retry
        ("r1", 2, "a", "b", None, "log_scale", None, None, 7, 7, False),        # repeated: complete
        ("r1", 3, "a", "b", None, "log_scale", None, None, 7, 3, False),        # repeated, weak: drop
        ("r1", 1, "c", "d", None, "color_by_segment", "c", None, 7, 7, False),  # already x: drop
        ("r1", 2, "c", "d", None, "color_by_segment", "c", None, 7, 7, False),  # a drop leaves no trace
        ("r2", 1, "e", None, None, "facet_grid", None, "e", 7, 7, False),       # splits by x: drop
        ("r2", 1, "e", None, "z", "facet_grid", None, "e", 7, 7, False),        # coloured: retry
        ("r3", 1, "f", "g", None, None, None, None, 2, 2, False),               # complete
    ]
    findings = frame(schema, rows)
    known = dl.with_tweak_history(findings, ["run", "x", "y", "chart_color"], "round")
    got = known.withColumn("o", dl.finding_outcome(known)).collect()
    outcomes = sorted((r["run"], r["x"], r["round"], r["chart_color"] or "", r["o"]) for r in got)
    assert [o[-1] for o in outcomes] == ["retry", "complete", "drop", "drop", "drop", "drop", "retry", "complete"]
    assert [r[0] for r in dl.unfinished_runs(known, "run").collect()] == ["r2"]


def test_rows_without_a_run_are_one_run(frame):
    schema = "run string, quality_score int, strategic_score int, is_spurious boolean"
    findings = frame(schema, [(None, 9, 9, False), (None, 2, 2, False), ("a", 3, 3, False)])
    got = sorted(map(str, dl.triage_findings(findings, "run").select("run", "quality_score").collect()))
    assert got == ["Row(run='a', quality_score=3)", "Row(run=None, quality_score=9)"]


def _jobs(spark, build):
    """Jobs that building starts, and the result; counted by Spark's own job group."""
    tracker, group = spark.sparkContext.statusTracker(), f"battery-{id(build)}"
    spark.sparkContext.setJobGroup(group, "counted")
    result = build()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group)), result


def test_jobs_and_scans_do_not_grow_with_the_specs(spark, table):
    kinds = [
        ChartSpec("t", "num"), ChartSpec("t"), ChartSpec("cat"), ChartSpec("cat", "cat2"), ChartSpec("num"),
        ChartSpec("cat", "num", "cat2"), ChartSpec("cat", "num"), ChartSpec("num", "num2"),
    ]
    more = [
        ChartSpec("t", "num2"), ChartSpec("t", "num", "cat"), ChartSpec("cat2"), ChartSpec("cat2", "cat"),
        ChartSpec("num2"), ChartSpec("cat2", "num2", "cat"), ChartSpec("num2", "num", "cat"),
    ]
    few, (some, _) = _jobs(spark, lambda: dl.chart_battery(table, kinds, ["t"], "num"))
    many, (all_, _) = _jobs(spark, lambda: dl.chart_battery(table, kinds + more, ["t"], "num"))
    assert abs(few - many) <= 2 and many < 60

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert scans(some) == scans(all_)


def test_battery_equals_its_single_charts(table):
    specs = [ChartSpec(*c) for c, _ in CHOICES if c[1] != "flag"]
    specs += [ChartSpec("long"), ChartSpec("long", "num", "cat"), ChartSpec("cat", "num", "long")]
    data, _ = dl.chart_battery(table, specs, ["t"], "num")
    planned = dl.plan_battery(specs)
    rows = data.collect()
    for no, spec in enumerate(planned, start=1):
        alone = dl.run_chart(table, spec, ["t"], "num")
        tables = [t for t in (alone.data, alone.curve) if t is not None]
        want = [tuple(r) for t in tables for r in battery.tidy_chart(t, spec, alone.chart_type).collect()]
        got = [(r["x"], r["series"], r["stat"], r["value"]) for r in rows if r["chart_no"] == no]
        key = lambda r: tuple(map(str, r[:3]))
        assert sorted(map(key, got)) == sorted(map(key, want)), (spec, alone.chart_type)
        for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
            assert a[3] is None and b[3] is None or a[3] == pytest.approx(b[3], nan_ok=True)
