import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import dataloupe as dl
from dataloupe.operators.profile import column_facts
from dataloupe.plans import quantiles
from dataloupe.operators import outliers

NAN = float("nan")


def test_semantic_types(spark):
    df = spark.range(400).select(
        *[(F.col("id") % n).alias(f"n{n}") for n in (1, 10, 11)],
        (F.col("id") % 2 == 0).alias("flag"),
        F.col("id").cast("string").alias("text"),
        F.lit(dt.date(2020, 1, 1)).alias("day"),
        F.lit(None).cast("double").alias("nothing"),
        F.array("id").alias("nested"),
        (F.col("id") / 7).cast("decimal(10,2)").alias("money"),
    )
    got = {r["column"]: r["semantic_type"] for r in dl.semantic_types(df).collect()}
    assert got == {
        "n1": "CATEGORICAL", "n10": "CATEGORICAL", "n11": "NUMERICAL", "flag": "CATEGORICAL",
        "text": "CATEGORICAL", "day": "TEMPORAL", "nothing": "CATEGORICAL", "money": "NUMERICAL",
    }


def test_profile(spark, plans, frame):
    rows = [(float(i), NAN if i % 4 == 0 else i * 1.0, "ab"[i % 2], None, [i]) for i in range(40)]
    df = frame("a double, `b c` double, k string, gone string, list array<int>", rows)
    got = {r["column"]: r for r in dl.profile(df).collect()}
    assert got["a"]["semantic_type"] == "NUMERICAL" and got["a"]["median"] == 19.5
    assert got["b c"]["null_pct"] == 25.0 and got["b c"]["max"] == 39.0
    assert got["k"]["top_values"] == ["a", "b"] and got["k"]["n_unique"] == 2
    assert got["gone"]["n_unique"] == 0 and got["gone"]["null_pct"] == 100.0
    assert got["list"]["note"] == "not profiled: array<int>"
    assert [r["position"] for r in sorted(got.values(), key=lambda r: r["position"])] == list(range(5))


def test_profile_of_an_empty_table(frame):
    got = dl.profile(frame("a double, t timestamp_ntz", [])).collect()
    assert [r["null_pct"] for r in got] == [None, None]


@pytest.mark.parametrize("top, hint", [(499.0, "Normal Range"), (501.0, "High Skew (Consider Log)")])
def test_skew_hint(frame, top, hint):
    """Median 10, so the limit lies at a maximum of 500."""
    rows = [(float(v),) for v in [*range(1, 10), 10, *range(11, 19), top]]
    assert dl.skew_hint(frame("x double", rows)).first()["hint"] == hint


def test_negative_median_gives_no_hint(frame):
    rows = [(float(v),) for v in [*range(-20, 0), 10_000]]
    assert dl.skew_hint(frame("x double", rows)).first()["hint"] == "Normal Range"


def test_ties_are_broken_by_value(frame):
    rows = [(v,) for v in ["c", "a", "b", "a", "b", "c", "f", "e", "d"]]
    got = dl.categorical_profile(frame("k string", rows)).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in got] == [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1)]
    assert dl.concentration(frame("k string", rows), "k").first()["top_class"] == "a"


def test_long_texts_come_back_whole(frame, plans):
    long = "x" * 5000
    rows = [(long,)] * 3 + [("short",)] * 2 + [(long + "y",)]
    df = frame("k string", rows)
    got = dl.categorical_profile(df).orderBy("rank").collect()
    assert [(r["value"], r["n"], r["n_unique"]) for r in got] == [(long, 3, 3), ("short", 2, 3), (long + "y", 1, 3)]
    assert dl.concentration(df, "k").first()["top_class"] == long


def test_cardinality_warning(spark):
    df = spark.range(160).select(*[(F.col("id") % n).cast("string").alias(f"t{n}") for n in (15, 16)])
    assert [tuple(r) for r in dl.cardinality_warning(df).collect()] == [("t16", 16)]


# ---------------------------------------------------------------- outliers


def grouped(seed=5):
    """Group a triggers; b has no extreme value; c has p99 <= 0; NULL group has a huge value."""
    rng = np.random.default_rng(seed)
    a = [("a", float(v)) for v in np.round(rng.uniform(1, 10, 400), 2)] + [("a", 900.0), ("a", 1000.0)]
    b = [("b", float(v)) for v in np.round(rng.uniform(1, 10, 300), 2)]
    c = [("c", -float(v)) for v in range(1, 200)] + [("c", 50.0)]
    return a + b + c + [(None, 1e6), ("a", None), ("b", NAN), (None, None)]


def test_outliers_by_group(frame, plans):
    rows = grouped()
    df = frame("g string, y double", rows)
    y = pd.Series([v for g, v in rows if g == "a" and v is not None])
    p99 = y.quantile(0.99)
    out = y[y > p99]
    (row,) = dl.outliers_by_group(df, "y", "g").collect()
    assert row["group"] == "a" and row["n"] == len(y) and row["outlier_count"] == len(out)
    assert row["p99"] == pytest.approx(p99) and row["max"] == 1000.0
    impact = out.sum() / y.sum() * 100
    assert row["impact_pct"] == pytest.approx(impact)
    assert row["summary"] == (
        f"Stat Alert: {len(out)} extreme outliers (Max: 1000.00) hidden. "
        f"They represent {impact:.1f}% of total y value."
    )


def test_clip_removes_only_values_above_their_own_limit(frame, plans):
    rows = grouped()
    df = frame("g string, y double", rows)
    p99 = pd.Series([v for g, v in rows if g == "a" and v is not None]).quantile(0.99)
    kept = [(g, v) for g, v in rows if not (g == "a" and v is not None and v > p99)]
    clipped = dl.clip_outliers(df, "y", "g")
    assert clipped.columns == ["g", "y"]
    assert sorted(map(str, map(tuple, clipped.collect()))) == sorted(map(str, kept))


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz", "timestamp", "float", "decimal(5,2)", "boolean", "int"])
def test_clip_groups_of_any_type(spark, kind):
    literal = {"date": "date'2020-01-01'", "timestamp": "timestamp'2020-01-01 10:00:00'",
               "timestamp_ntz": "timestamp_ntz'2020-01-01 10:00:00'", "boolean": "true"}.get(kind, "0.1")
    df = spark.range(200).selectExpr(
        f"CAST({literal} AS {kind}) AS g", "CASE WHEN id = 3 THEN 1000.0D ELSE CAST(id % 5 + 1 AS DOUBLE) END AS y"
    )
    assert dl.clip_outliers(df, "y", "g").count() == 199


def test_clip_groups_that_are_structs_and_columns_called_like_helpers(spark):
    """Few and many triggered groups, by a struct and beside columns with the names of helpers."""
    for groups in (3, 50):
        df = spark.range(groups * 100).selectExpr(
            f"named_struct('a', id % {groups}) AS g", f"id % {groups} AS k", "'mine' AS _group", "1 AS _limit", "2 AS _rows",
            f"CASE WHEN id < {groups} THEN 1000.0D ELSE 1.0D END AS y",
        )
        for by in ("g", "k"):
            clipped = dl.clip_outliers(df, "y", by)
            assert clipped.columns == df.columns and clipped.count() == groups * 99
            assert [tuple(r) for r in clipped.select("_group", "_limit", "_rows").distinct().collect()] == [("mine", 1, 2)]


def test_facts_of_a_column_are_lazy(spark):
    df = spark.range(30_000).selectExpr("double(id % 977) AS y", "CAST(NULL AS DOUBLE) AS none")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy-facts", "counted")
    frames = [dl.dispersion(df, n) for n in ("y", "none")]
    assert len(tracker.getJobIdsForGroup("lazy-facts")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = [f.first() for f in frames]
    assert rows[0]["median"] == 483.0 and rows[1] == (None, None, None, None)
    assert dl.iqr_outliers(df, "none").first()[3:] == (0, 0.0)


def test_global_outliers(frame, plans):
    rows = [(float(i % 9 + 1),) for i in range(500)] + [(100.0,), (None,)]
    df = frame("y double", rows)
    (row,) = dl.outliers_global(df, "y").collect()
    assert (row["group"], row["outlier_count"]) == ("Global", 1)
    assert dl.clip_outliers(df, "y").count() == 501
    calm = df.where("y < 100 or y is null")
    assert dl.outliers_global(calm, "y").count() == 0
    assert dl.clip_outliers(calm, "y").count() == 501


def test_text_metric_has_no_evidence(frame):
    df = frame("g string, y string", [("a", "b")])
    assert dl.outliers_by_group(df, "y", "g").count() == 0
    assert dl.clip_outliers(df, "y", "g").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        dl.outliers_by_group(df, "z", "g")


def test_one_hot_group(spark, long_groups):
    """A group with most of the rows, next to many groups of one."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.when(F.col("id") == 1, 10_000.0).otherwise((F.col("id") % 50).cast("double")).alias("y"),
    )
    (row,) = dl.outliers_by_group(df, "y", "g").collect()
    assert (row["group"], row["n"], row["p99"], row["max"]) == ("hot", 20_000, 49.0, 10_000.0)
    assert dl.clip_outliers(df, "y", "g").count() == 30_000 - 1


def test_fence_and_dispersion(frame, plans):
    values = [1.0, 2.0, 2.5, 3.0, 4.0, 4.0, 5.0, 60.0]
    df = frame("y double", [(v,) for v in [*values, None, NAN]])
    y = pd.Series(values)
    q1, q3 = y.quantile([0.25, 0.75])
    row = dl.iqr_outliers(df, "y").first()
    assert (row["q1"], row["q3"]) == (q1, q3)
    assert row["upper_fence"] == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert row["outlier_count"] == 1 and row["outlier_impact_pct"] == pytest.approx(60 / y.sum() * 100)
    spread = dl.dispersion(df, "y").first()
    centred = y - y.mean()
    assert spread["kurtosis"] == pytest.approx((centred**4).mean() / (centred**2).mean() ** 2 - 3)
    assert spread["cv"] == pytest.approx(y.std() / y.mean())


def test_zero_sum_and_zero_mean(frame):
    row = dl.iqr_outliers(frame("y double", [(-1.0,), (1.0,), (-50.0,), (50.0,)]), "y").first()
    assert row["outlier_impact_pct"] == 0.0
    assert dl.dispersion(frame("y double", [(-1.0,), (1.0,)]), "y").first()["cv"] == 0.0


def test_no_values(frame):
    empty = frame("y double, k string", [(None, None)])
    assert dl.iqr_outliers(empty, "y").first()["outlier_count"] == 0
    assert dl.dispersion(empty, "y").first()["median"] is None
    with pytest.raises(ValueError, match="no values"):
        dl.forensic_summary(empty, "y")
    with pytest.raises(ValueError, match="no values"):
        dl.forensic_summary(empty, "k")
    assert dl.concentration(empty, "k").first()["unique_count"] == 0


# ---------------------------------------------------------------- concentration, top-k


def test_entropy(frame):
    one = frame("k string", [("a",)] * 9)
    assert dl.normalized_entropy(one, "k").first()["entropy"] == 0.0
    assert dl.concentration(one, "k").first()["is_imbalanced"]
    even = frame("k string", [("a",), ("b",), ("c",), (None,)])
    assert dl.normalized_entropy(even, "k").first()["entropy"] == pytest.approx(1.0)
    mixed = frame("k string", [("a",)] * 6 + [("b",)] * 2)
    p = np.array([0.75, 0.25])
    row = dl.normalized_entropy(mixed, "k").first()
    assert row["entropy"] == pytest.approx(-(p * np.log2(p)).sum()) and row["unique_count"] == 2


def test_summary_sentences(frame):
    acts = [r["text"] for r in dl.forensic_summary(frame("`100% k` string", [("a%",)] * 3 + [("b",)]), "100% k").collect()]
    assert acts[0] == "BASELINE: '100% k' is dominated by 'a%' (75.0% share)."
    assert "fragmented (Entropy: 0.81) across 2 unique" in acts[1]
    numbers = frame("y double", [(float(v),) for v in (1, 2, 3, 4, 100)])
    acts = [r["text"] for r in dl.forensic_summary(numbers, "y").collect()]
    assert acts[0] == "BASELINE: 'y' shows a median of 3.00 with a CV of 1.98."
    assert acts[1].startswith("DIVERGENCE: We found 1 extreme events representing 90.9% of volume.")
    assert acts[2].endswith("exceeding the 7.00 threshold to stabilize the North Star. \n Alert if y > 7.00")


def pareto_of(rows):
    data = pd.DataFrame(rows, columns=["k", "v"])
    sums = data.groupby("k")["v"].sum().reset_index().sort_values(["v", "k"], ascending=[False, True])
    return sums.reset_index(drop=True)


def test_pareto(spark, frame, plans):
    rng = np.random.default_rng(2)
    rows = [(f"k{int(i)}", float(v)) for i, v in zip(rng.integers(0, 300, 4000), np.round(rng.normal(5, 10, 4000), 2))]
    want = pareto_of(rows)
    got = dl.category_pareto(frame("k string, v double", [*rows, (None, 9.0)]), "k", "v").toPandas()
    got = got.sort_values("rank").reset_index(drop=True)
    assert list(got["rank"]) == list(range(1, len(want) + 1))
    assert list(got["k"]) == list(want["k"])
    np.testing.assert_allclose(got["cum_share"], want["v"].cumsum() / want["v"].sum(), rtol=1e-9)
    np.testing.assert_allclose(got["gap_ratio"][:-1], (want["v"] / want["v"].shift(-1))[:-1], rtol=1e-6)
    assert math.isnan(got["gap_ratio"].iloc[-1]) or got["gap_ratio"].iloc[-1] is None


def test_top_k_stops_at_the_first_crossing(frame):
    """Negative sums make the share fall again after it has passed the limit."""
    rows = [("a", 80.0), ("b", 30.0), ("c", 5.0), ("d", -15.0), (None, 3.0)]
    df = frame("k string, v double", rows)
    assert dl.top_categories(df, "k", "v") == ["a", "b"]
    labels = {r["v"]: r["k"] for r in dl.top_k_others(df, "k", "v").collect()}
    assert labels == {80.0: "a", 30.0: "b", 5.0: "Others", -15.0: "Others", 3.0: "Others"}


def test_top_k_limits(frame):
    rows = [(f"k{i:02d}", 1.0) for i in range(20)]
    df = frame("k string, v double", rows)
    assert dl.top_categories(df, "k", "v") == [f"k{i:02d}" for i in range(12)]
    zero = frame("k string, v double", [("a", 5.0), ("b", -5.0), ("c", 0.0)])
    assert dl.top_categories(zero, "k", "v") == ["a", "c", "b"]
    folded = dl.top_k_others(df, "k", "v")
    assert folded.count() == 20 and folded.select("k").distinct().count() == 13


def wide(spark, rows=20_000):
    rng = np.random.default_rng(8)
    data = pd.DataFrame({
        "long_tail": rng.lognormal(2, 3, rows), "ends": rng.choice([-np.inf, 1.0, 2.5, np.inf], rows),
        "steps": rng.integers(0, 11, rows), "few": rng.integers(0, 10, rows), "sorted": np.arange(rows) // 7,
        "gaps": np.where(rng.random(rows) < 0.7, np.nan, rng.normal(1e9, 1, rows)),
        "word": rng.choice(["a", "b"], rows),
    })
    data.loc[::50, "ends"] = rng.normal(size=len(data.loc[::50]))
    return data, spark.createDataFrame(data).repartition(7)


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_medians_of_all_columns_in_one_plan(spark, monkeypatch, accuracy):
    """With accuracy 40 the sketches are coarse, and the brackets hold many values."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 4 / accuracy)
    data, df = wide(spark)
    got = {r["column"]: r for r in dl.numeric_profile(df).collect()}
    assert set(got) == {"long_tail", "ends", "steps", "sorted", "gaps"}
    for name, row in got.items():
        values = data[name].dropna()
        assert row["median"] == pytest.approx(values.median(), rel=1e-12), name
        assert (row["min"], row["max"]) == (values.min(), values.max())
    assert got["gaps"]["mean"] == pytest.approx(data["gaps"].mean(), rel=1e-12)


def test_profile_starts_few_jobs(spark):
    """They do not grow with the columns, and each column is read once more than its state."""
    _, df = wide(spark, 2000)
    tracker = spark.sparkContext.statusTracker()

    def jobs(frame) -> int:
        group = f"profile {len(frame.columns)}"
        spark.sparkContext.setJobGroup(group, group)
        dl.profile(frame)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    twice = df.select("*", *[(F.col(n) + 1).alias(n + "2") for n in ("long_tail", "steps", "few")])
    assert jobs(df) == jobs(twice) <= 8


def test_sketches_of_parts_settle_classes(spark):
    """Ten values in each part of a column, but many over all of them."""
    df = spark.range(0, 3000, 1, 300).select("id", (F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"))
    assert column_facts(df).classes == {"id": "NUMERICAL", "ten": "CATEGORICAL", "eleven": "NUMERICAL"}
