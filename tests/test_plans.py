"""The scale helpers, against numpy and pandas and on skewed groups."""

import io
import math
import os
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import dataloupe as dl
from dataloupe.plans import joins, quantiles, storage
from dataloupe.plans.cardinality import distinct_up_to, short_key
from dataloupe.plans.ordering import range_parts, with_position
from dataloupe.plans.quantiles import exact_quantiles
from dataloupe.plans.storage import estimated_bytes, materialize, rows_up_to

LEVELS = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


def explained(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def skewed(spark, rows=60_000):
    """One group with a third of the rows, one with repeats only, many small ones."""
    rng = np.random.default_rng(11)
    group = np.where(np.arange(rows) % 3 == 0, "hot", rng.integers(0, 40, rows).astype(str))
    y = np.round(rng.lognormal(3, 2, rows), 3) - 5
    flat = rng.random(rows) < 0.05
    group[flat], y[flat] = "flat", 7.0
    return pd.DataFrame({"g": group, "y": y})


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_exact_quantiles_match_numpy(spark, plans, monkeypatch, accuracy):
    """With accuracy 100 the groups exceed the sketch, so real brackets are at work."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 4 / accuracy)
    monkeypatch.setattr(quantiles, "CELLS", 16)
    data = skewed(spark)
    df = spark.createDataFrame(data).repartition(6)
    got = exact_quantiles(df, "y", ["g"], LEVELS).toPandas().set_index("g").sort_index()
    groups = data.groupby("g")["y"]
    for name, p in LEVELS.items():
        np.testing.assert_allclose(got[name], groups.quantile(p), rtol=1e-12, err_msg=name)
    assert (got["n"] == groups.size()).all()
    np.testing.assert_allclose(got["sum"], groups.sum(), rtol=1e-9)

    whole = exact_quantiles(df.select("y"), "y", [], LEVELS, [F.kurtosis("y").alias("k")]).first()
    for name, p in LEVELS.items():
        assert whole[name] == pytest.approx(data["y"].quantile(p), rel=1e-12)
    assert whole["n"] == len(data) and whole["max"] == data["y"].max()


def test_many_parts_still_enclose_the_quantile(spark, long_groups, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "MARGIN", 4 / 100)
    data = skewed(spark, 20_000).sort_values("y")
    df = spark.createDataFrame(data).repartitionByRange(8, "y")
    got = exact_quantiles(df, "y", ["g"], {"q": 0.5}).toPandas().set_index("g")["q"].sort_index()
    np.testing.assert_allclose(got, data.groupby("g")["y"].quantile(0.5), rtol=1e-12)


def test_quantiles_of_nothing(spark, plans, frame):
    empty = frame("g string, y double", [])
    assert exact_quantiles(empty, "y", ["g"], LEVELS).count() == 0
    row = exact_quantiles(empty.select("y"), "y", [], LEVELS, [F.avg("y").alias("a")]).first()
    assert row["n"] == 0 and row["median"] is None and row["a"] is None


def test_infinite_values_keep_their_place(spark, plans):
    y = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in y], "y double")
    levels = {"low": 0.0, "between": 0.9, "median": 0.5, "q3": 0.75, "high": 1.0}
    row = exact_quantiles(df, "y", [], levels).first()
    assert (row["median"], row["q3"]) == (2.0, 3.0)
    assert (row["low"], row["between"], row["high"]) == (-math.inf, math.inf, math.inf)
    more = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, math.inf, math.inf)], "y double")
    assert exact_quantiles(more, "y", [], {"q3": 0.75}).first()["q3"] == math.inf


@pytest.mark.parametrize("how", ["inner", "left"])
def test_all_lookup_joins_agree(spark, monkeypatch, how):
    """Key 3 has almost all rows, so the shuffle join splits it."""
    key = F.when(F.col("id") % 10 < 8, 3).otherwise(F.col("id") % 7).cast("long")
    big = spark.range(5000).select(key.alias("k"), "id")
    big = big.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("k"), "id"))
    table = big.where("k < 5").groupBy("k").agg(F.count("id").alias("v"))
    want = sorted(big.join(table, "k", how).collect(), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(joins.lookup_join(big, table, ["k"], "v", how).collect(), key=str) == want
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        salted = joins.lookup_join(big, table, ["k"], "v", how)
        assert "SortMergeJoin" in explained(salted)
        assert sorted(salted.collect(), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_keys_are_divided_over_parts(spark):
    df = spark.range(40_000).select(F.lit(1).alias("v")).repartition(16)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        parts = range_parts(df, [F.asc("v")]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset(merging)
    assert sum(r["count"] for r in parts) == 40_000 and max(r["count"] for r in parts) < 20_000


def test_positions_are_the_global_order(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("v")).repartition(5)
    placed = with_position(df, [F.asc("v")], "pos").orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(10_000))
    values = [r["v"] for r in placed]
    assert values == sorted(values)


def test_distinct_counts_are_exact_up_to_the_limit(spark):
    wide = spark.range(20_000).select(
        *[(F.col("id") % n).alias(f"d{n}") for n in (1, 10, 11, 12, 13, 15, 16, 40, 5000)],
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 20).alias("gaps"),
        F.lit(None).cast("string").alias("nothing"),
    )
    got = distinct_up_to(wide, wide.columns, 12)
    assert got == {
        "d1": 1, "d10": 10, "d11": 11, "d12": 12, "d13": None, "d15": None, "d16": None,
        "d40": None, "d5000": None, "gaps": 10, "nothing": 0,
    }


def test_short_keys_separate_texts(spark):
    texts = ["a" * n for n in (1, 63, 64, 65, 5000)] + ["", "b" * 5000]
    df = spark.createDataFrame([(t,) for t in texts * 2], "t string")
    keys = df.select(short_key("t").alias("k"))
    assert keys.distinct().count() == len(texts)
    assert keys.agg(F.max(F.length("k"))).first()[0] == 64


def test_sizes(spark, tmp_path):
    df = materialize(spark.range(1000))
    assert estimated_bytes(df) > 0
    assert rows_up_to(df, 5) == 5 and rows_up_to(df.limit(3), 5) == 3


def test_written_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_written", {})
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    for _ in range(3):
        materialize(spark.range(10))
    assert len(os.listdir(tmp_path)) == 3
    assert storage.release(spark) == 3 and os.listdir(tmp_path) == []
    assert storage.release(spark) == 0


def test_one_sketch_per_group_and_task(spark):
    """All rows of a task belong to one part, so that a group has a sketch per task at most."""
    rows = spark.range(4000).repartition(4).selectExpr("0 AS g", "double(id) AS _y")
    plan = quantiles._brackets(rows, ["g"], [0.5])
    parts = rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(quantiles.PARTS)))
    assert parts.select("_part").distinct().count() == 4
    assert "spark_partition_id" in explained(plan).lower()


def test_no_window_over_all_rows(spark):
    """The only one-partition windows go over one row per range partition."""
    df = spark.range(5000).selectExpr("id % 7 AS k", "id", "double(id % 91) AS v")
    for frame in (
        dl.rolling_mean(df, "id", "v", span_days=20), dl.category_pareto(df, "id", "v"),
        dl.histogram(df, "v"), dl.box_stats(df, "k", "v"), dl.category_share(df, "k"),
    ):
        plan = explained(frame)
        for window in plan.split("Window [")[1:]:
            below = window.split("\n")[1:4]
            single = any("SinglePartition" in line for line in below)
            assert not single or "_part" in window or "_base" in window


def test_rows_of_hot_groups_are_never_dealt_by_the_bare_group(spark, monkeypatch):
    """A third of the rows in one group beside 10^5 short ones: the sizes of the groups are joined
    by a salted key."""
    from dataloupe.plans import joins

    monkeypatch.setattr(quantiles, "SHORT_GROUP", 100)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1000)
    df = spark.range(300_000).selectExpr("IF(id % 3 = 0, -1, id % 100000) AS g", "double(id % 1009) AS y")
    found = quantiles.exact_quantiles(df, "y", ["g"], {"m": 0.5})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("\n") if "Join" in line]
    assert not any("LeftSemi" in line or "LeftAnti" in line for line in joined)
    assert any("_salt" in line for line in joined)
    rows = {r["g"]: (r["n"], r["m"]) for r in found.where("g < 5").collect()}
    assert rows[-1][0] == 100_000 and len(rows) == 6
    hot = sorted(float(i % 1009) for i in range(0, 300_000, 3))
    assert rows[-1][1] == (hot[49_999] + hot[50_000]) / 2
