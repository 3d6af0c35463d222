import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import dataloupe as dl
from dataloupe.operators import profile
from dataloupe.operators import charts
from test_plans import explained

NAN = float("nan")


def normals(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": rng.normal(10, 3, n)})


def test_histogram_matches_numpy(spark, plans):
    data = normals()
    df = spark.createDataFrame(data)
    got = dl.histogram(df, "x").orderBy("bin").toPandas()
    edges = np.histogram_bin_edges(data["x"], "auto")
    counts, _ = np.histogram(data["x"], edges)
    full = np.zeros(len(edges) - 1, dtype=int)
    full[got["bin"]] = got["n"]
    assert list(full) == list(counts)
    np.testing.assert_allclose(got["bin_start"], edges[got["bin"]])
    hued = dl.histogram(df, "x", "g")
    assert hued.agg(F.sum("n")).first()[0] == len(data)
    assert hued.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()["n"].tolist() == got["n"].tolist()


def test_histogram_edge_cases(frame):
    (row,) = dl.histogram(frame("x double", [(4.0,)] * 7), "x").collect()
    assert (row["bin_start"], row["bin_end"], row["n"]) == (3.5, 4.5, 7)
    assert dl.histogram(frame("x double", [(None,)]), "x").count() == 0
    spread = [(float(v),) for v in range(100)] + [(1e9,)]
    capped = dl.histogram(frame("x double", spread), "x", max_bins=50)
    assert capped.agg(F.sum("n"), F.max("bin")).first()[:] == (101, 49)
    mostly = [(1.0,)] * 90 + [(2.0,)] * 10  # IQR 0
    got = dl.histogram(frame("x double", mostly), "x").collect()
    assert max(r["bin"] for r in got) == math.ceil(math.log2(100) + 1) - 1


def direct_density(x, grid, adjust=1.0):
    h = x.std(ddof=1) * len(x) ** -0.2 * adjust
    z = (grid[:, None] - x[None, :]) / h
    return np.exp(-z * z / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))


def test_kde_close_to_the_direct_sum(spark, plans):
    data = normals()
    df = spark.createDataFrame(data)
    got = dl.kde(df, "x").orderBy("grid_no").toPandas()
    x = data["x"].to_numpy()
    np.testing.assert_allclose(got["grid_x"], np.linspace(x.min(), x.max(), 200))
    want = direct_density(x, got["grid_x"].to_numpy())
    assert abs(got["density"] - want).max() < 1e-3 * want.max()
    by = dl.kde(df, "x", "g", points=50, bw_adjust=0.5, cut=2, common_grid=False)
    for g, part in by.toPandas().groupby("g"):
        part = part.sort_values("grid_no")
        xs = data.loc[data["g"] == g, "x"].to_numpy()
        want = direct_density(xs, part["grid_x"].to_numpy(), 0.5)
        assert abs(part["density"] - want).max() < 1e-3 * want.max()
        assert np.trapezoid(part["density"], part["grid_x"]) == pytest.approx(1, abs=0.02)


def test_kde_with_a_far_outlier_keeps_the_whole_grid(spark):
    data = normals(500)
    data.loc[0, "x"] = 1e6
    got = dl.kde(spark.createDataFrame(data), "x").toPandas()
    assert len(got) == 200 and (got["density"] >= 0).all()
    flat = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert dl.kde(flat, "x").count() == 0


def test_box_stats(frame, plans):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 30, -30]] + [("b", 1.0), ("b", None), (None, 3.0)]
    df = frame("g string, y double", rows)
    got = {r["group"]: r for r in dl.box_stats(df, "g", "y").collect()}
    y = pd.Series([v for g, v in rows if g == "a"])
    q1, q3 = y.quantile([0.25, 0.75])
    inside = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
    assert (got["a"]["q1"], got["a"]["median"], got["a"]["q3"]) == (q1, y.median(), q3)
    assert (got["a"]["whisker_low"], got["a"]["whisker_high"]) == (inside.min(), inside.max())
    assert got["a"]["n_fliers"] == len(y) - len(inside) == 2
    assert got["b"]["n"] == 1 and set(got) == {"a", "b"}
    flipped = {r["group"]: r for r in dl.box_stats(df, "y", "g").collect()}
    assert flipped == got


def test_violin(spark, plans):
    data = normals(600)
    got = dl.violin(spark.createDataFrame(data), "g", "x").toPandas()
    assert len(got) == 2 * 100
    for g, part in got.groupby("group"):
        q = data.loc[data["g"] == g, "x"].quantile([0.25, 0.5, 0.75]).to_numpy()
        np.testing.assert_allclose(part[["q1", "median", "q3"]].iloc[0], q)


def test_means(frame):
    df = frame("x int, y double", [(2, 1.0), (2, 3.0), (1, 5.0), (1, NAN), (None, 9.0)])
    one, two = dl.line_mean(df, "x", "y").collect()
    assert (one["x"], one["mean"], one["n"], one["ci_low"]) == (1, 5.0, 1, None)
    half = 1.96 * math.sqrt(2) / math.sqrt(2)
    assert two["ci_high"] - two["mean"] == pytest.approx(half) == pytest.approx(two["mean"] - two["ci_low"])
    same = dl.bar_mean(df, "x", "y", "x").collect()
    assert {r["x"]: r["mean"] for r in same} == {1: 5.0, 2: 2.0}


def test_twin_line(frame):
    df = frame("x int, a double, b double", [(1, 1.0, None), (1, 3.0, NAN), (0, None, 4.0)])
    assert [tuple(r) for r in dl.twin_line(df, "x", "a", "b").collect()] == [(0, None, 4.0), (1, 2.0, None)]


@pytest.mark.parametrize("days, window", [(13, 3), (14, 7), (90, 7), (91, 14), (365, 14), (366, 30)])
def test_rolling_window(days, window):
    assert dl.rolling_window(days) == window


@pytest.mark.parametrize("block", [3, 50, 1_000_000])
def test_rolling_mean_matches_pandas(spark, plans, monkeypatch, block):
    """Blocks as short as the window, with a group that spans many of them."""
    monkeypatch.setattr(charts, "_block_rows", lambda size, wanted=0: max(size, block))
    rng = np.random.default_rng(4)
    n = 700
    data = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 9, n).astype(str)),
        "x": rng.permutation(n),
        "y": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)),
    })
    df = spark.createDataFrame(data).repartition(4)
    for by in (None, "g"):
        got = dl.rolling_mean(df, "x", "y", by, span_days=5).toPandas().sort_values("x")
        ordered = data.sort_values("x")
        y = ordered.groupby("g")["y"] if by else ordered["y"]
        want = y.transform(lambda s: s.rolling(3, min_periods=1).mean())
        np.testing.assert_allclose(got["rolling_y"].astype(float), want, rtol=1e-9)
        assert (got["window"] == 3).all()


@pytest.mark.parametrize("block", [1, 9, 1024])
def test_rolling_mean_by_days(spark, monkeypatch, block):
    """Gaps, a crowded day, days before 1970, and missing values; blocks as short as the window."""
    monkeypatch.setattr(charts, "DAY_BLOCK", block)
    rng = np.random.default_rng(5)
    n = 900
    day = np.where(rng.random(n) < 0.3, 3, rng.integers(-60, 60, n))
    data = pd.DataFrame({
        "n": np.where(rng.random(n) < 0.6, "hot", rng.integers(0, 5, n).astype(str)),
        "t": pd.Timestamp("1970-01-01") + pd.to_timedelta(day, "D") + pd.to_timedelta(rng.integers(0, 86_400, n), "s"),
        "y": np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n)),
    })
    schema = "n string, t timestamp_ntz, y double"
    rows = [(g, t.to_pydatetime(), y) for g, t, y in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = dl.rolling_mean_by_days(df, "t", "y", "n", days=5)
    assert got.columns == ["n", "t", "y_mean", "_n", "rolling_y", "days"]
    data["day"] = data["t"].dt.floor("D")
    groups = {k: g for k, g in data.groupby("n")}
    rows = got.collect()
    assert sorted((r["n"], r["t"]) for r in rows) == sorted(set(zip(data["n"], data["day"])))
    for r in rows:
        mine = groups[r["n"]]
        window = mine[(mine["day"] <= r["t"]) & (mine["day"] > r["t"] - dt.timedelta(days=5))]
        assert r["_n"] == (mine["day"] == r["t"]).sum()
        for value, want in ((r["rolling_y"], window["y"].mean()), (r["y_mean"], mine[mine["day"] == r["t"]]["y"].mean())):
            assert value is None if np.isnan(want) else value == pytest.approx(want, rel=1e-9)


def test_rolling_mean_by_days_holds_blocks_and_no_groups(spark, frame):
    df = spark.range(100).selectExpr("CAST(timestamp_seconds(id * 7200) AS timestamp_ntz) AS t", "double(id) AS y", "'a' AS g")
    plan = explained(dl.rolling_mean_by_days(df, "t", "y", "g"))
    assert "hashpartitioning(_block" in plan and plan.count("Exchange") == 2
    assert dl.rolling_mean_by_days(df.limit(0), "t", "y").collect() == []
    for wrong in ({"x": "y", "y": "y"}, {"x": "t", "y": "y", "days": 0}):
        with pytest.raises(ValueError):
            dl.rolling_mean_by_days(df, **wrong)


def test_scatter_sample(spark):
    rows = spark.range(3000).selectExpr(
        "id", "double(id % 50) AS x", "double(id) AS _key", "IF(id % 3 = 0, 'hot', string(id % 700)) AS `c.c`", "array(id) AS list"
    )
    got = [dl.scatter_sample(df, "x", "_key", "c.c", per_color=100).collect() for df in (rows, rows.repartition(13))]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    sizes = pd.Series([r["c.c"] for r in got[0]]).value_counts()
    assert sizes["hot"] == 100 and (sizes.drop("hot") < 10).all() and len(got[0]) == 2100
    assert 1000 < np.mean([r["_key"] for r in got[0] if r["c.c"] == "hot"]) < 2000
    plain = dl.scatter_sample(rows, "x", "_key", per_color=7, key=["id"])
    assert plain.count() == 7 and plain.columns == ["x", "_key"]
    assert "WindowGroupLimit" in explained(dl.scatter_sample(rows, "x", "_key", "c.c", per_color=100))
    same = spark.range(100).selectExpr("1.0D AS x", "2.0D AS y")
    assert dl.scatter_sample(same, "x", "y", per_color=7).count() == 7
    assert dl.scatter_sample(rows.limit(0), "x", "_key", "c.c").collect() == []
    with pytest.raises(ValueError):
        dl.scatter_sample(rows, "x", "_key", per_color=0)


def test_scatter_cells(spark, frame):
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"x": rng.normal(size=2000), "n": rng.lognormal(size=2000)})
    got = dl.scatter_cells(spark.createDataFrame(data), "x", "n", cells=12).toPandas()
    want, xs, ys = np.histogram2d(data["x"], data["n"], bins=12)
    table = np.zeros((12, 12))
    table[got["x_cell"], got["y_cell"]] = got["n"]
    assert (table == want).all() and (got["n"] > 0).all()
    np.testing.assert_allclose(got["x_start"], xs[got["x_cell"]])
    np.testing.assert_allclose(got["y_end"], ys[got["y_cell"] + 1])
    odd = frame("x double, y double, n string", [(1.0, 2.0, "a"), (1.0, 4.0, "a"), (math.inf, 1.0, "a"), (NAN, 1.0, "b")])
    cells = dl.scatter_cells(odd, "x", "y", "n", cells=2).collect()
    assert cells[0].asDict().keys() >= {"n", "_n"}
    assert sorted((r["x_cell"], r["y_cell"], r["x_start"], r["x_end"]) for r in cells) == [(0, 0, 1.0, 1.0), (0, 1, 1.0, 1.0)]
    assert dl.scatter_cells(odd.limit(0), "x", "y").collect() == []


def test_events_over_time(frame):
    day = dt.datetime(2020, 1, 1)
    df = frame("t timestamp_ntz", [(day,), (day + dt.timedelta(hours=5),), (None,), (day,)])
    assert [tuple(r) for r in dl.events_over_time(df, "t", "day").collect()] == [(day, 3)]
    assert [r["n"] for r in dl.events_over_time(df, "t").collect()] == [2, 1]
    with pytest.raises(ValueError, match="no dates"):
        dl.events_over_time(frame("t int", [(1,)]), "t")


def test_shares_and_composition(frame):
    rows = [("a", "p")] * 30 + [("a", "q")] + [("b", "q")] * 5 + [(None, "p"), ("a", None)]
    df = frame("x string, `s.1` string", rows)
    shares = {r["x"]: r for r in dl.category_share(df, "x").collect()}
    assert shares["a"]["n"] == 32 and sum(r["pct"] for r in shares.values()) == pytest.approx(100)
    cells = {(r["x"], r["segment"]): r for r in dl.composition(df, "x", "s.1").collect()}
    assert set(cells) == {("a", "p"), ("a", "q"), ("b", "q")}
    assert not cells["a", "q"]["show_label"] and cells["b", "q"]["pct"] == 100.0
    full = {(r["x"], r["segment"]): r["n"] for r in dl.composition(df, "x", "s.1", zero_cells=True).collect()}
    assert full == {("a", "p"): 30, ("a", "q"): 1, ("b", "p"): 0, ("b", "q"): 5}


def test_zero_cells_with_awkward_segment_names(frame):
    df = frame("x string, s string", [("a", "p.q"), ("b", "r `s`")])
    assert dl.composition(df, "x", "s", zero_cells=True).count() == 4


def test_axes(frame):
    row = dl.axis_limits(frame("y int", [(-10,), (20,)]), "y").first()
    assert tuple(row) == (-10.0, 20.0, -9.5, 21.0)
    assert dl.scale_kind(frame("y double", [(1.0,), (2.0,)]), "y").first()[0] == "log"
    for bad in (0.0, None, NAN):
        assert dl.scale_kind(frame("y double", [(1.0,), (bad,)]), "y").first()[0] == "symlog"


def test_scatter_and_counts(frame):
    df = frame("x int, y int, c string", [(1, 2, "a"), (1, None, "a"), (2, 2, None)])
    assert dl.scatter_points(df, "x", "y").count() == 2
    assert [tuple(r) for r in dl.scatter_points(df, "x", "y", "c").collect()] == [(1, 2, "a")]
    assert dl.scatter_points(df, "x", "y", "x").columns == ["x", "y"]
    assert {r["x"]: r["n"] for r in dl.count_plot(df, "x").collect()} == {1: 2, 2: 1}


def test_plans_push_down_and_stay_in_the_jvm(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr(
        "cast(id % 7 AS string) AS k", "cast(id AS double) AS y", "id AS other", "uuid() AS text"
    ).write.parquet(path)
    df = spark.read.parquet(path)
    fence = explained(dl.iqr_outliers(df, "y"))
    assert "GreaterThan(y," in fence and "ReadSchema: struct<y:double>" in fence
    assert "ReadSchema: struct<k:string,y:double>" in explained(dl.bar_mean(df, "k", "y"))
    tops = explained(dl.category_totals(df, "k", "y").orderBy(F.desc("total")).limit(12))
    assert "TakeOrderedAndProject" in tops
    assert "SortMergeJoin" not in explained(dl.clip_outliers(df, "y", "k"))
    assert "WindowGroupLimit" in explained(profile._top_values(df, ["k", "text"], 5))
    for table in (dl.box_stats(df, "k", "y"), dl.violin(df, "k", "y"), dl.profile(df), dl.clip_outliers(df, "y", "k")):
        plan = explained(table)
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zero_cells_meet_block_by_block(frame, monkeypatch):
    from dataloupe.operators import charts

    rows = [(f"x{i % 11}", f"s{i % 13}") for i in range(100)]
    df = frame("x string, s string", rows)
    monkeypatch.setattr(charts, "PAIR_BLOCK", 3)
    full = dl.composition(df, "x", "s", zero_cells=True)
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Cross" not in plan
    found = {(r["x"], r["segment"]): r["n"] for r in full.collect()}
    assert full.count() == len(found) == 11 * 13
    assert all(found[f"x{i}", f"s{j}"] == rows.count((f"x{i}", f"s{j}")) for i in range(11) for j in range(13))
    assert dl.composition(df.where("false"), "x", "s", zero_cells=True).count() == 0
