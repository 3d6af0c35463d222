"""Filling and filtering beside numpy."""

import numpy as np
import pytest

import dataloupe as dl


def test_impute_fills_by_column(frame, plans):
    rows = [(1, 1.5, None, None), (None, float("nan"), 4, None), (4, 9.0, 5, None), (7, None, None, None)]
    df = frame("a int, b double, c long, d double", rows)
    filled, report = dl.impute(df, {"a": "median", "b": "mean", "c": "zero", "d": "median"})
    assert dict(filled.dtypes) == {"a": "double", "b": "double", "c": "bigint", "d": "double"}
    assert sorted(map(tuple, filled.collect()), key=str) == sorted(
        [(1.0, 1.5, 0, None), (4.0, 5.25, 4, None), (4.0, 9.0, 5, None), (7.0, 5.25, 0, None)], key=str
    )
    assert {r["column"]: (r["value"], r["n_filled"]) for r in report.collect()} == {
        "a": (4.0, 1), "b": (5.25, 2), "c": (0.0, 2), "d": (None, 0)
    }
    empty, none = dl.impute(df.where("false"), {"a": "mean", "c": "zero"})
    assert empty.count() == 0 and {r["n_filled"] for r in none.collect()} == {0}
    with pytest.raises(ValueError, match="fills"):
        dl.impute(df, {"a": "mode"})
    with pytest.raises(ValueError):
        dl.impute(df.selectExpr("'x' AS s"), {"s": "mean"})


def test_columns_called_like_helpers(frame):
    df = frame("`column` double, value double, cell int, c0 int", [(1.0, None, 1, 1), (None, 3.0, 2, 2)])
    filled, _ = dl.impute(df, {"column": "mean", "value": "median"})
    assert [tuple(r) for r in filled.orderBy("cell").collect()] == [(1.0, 3.0, 1, 1), (1.0, 3.0, 2, 2)]


def test_zscore_of_a_small_spread_around_a_large_mean(spark):
    df = spark.range(20_000).repartition(13).selectExpr("id", "1e9 + sin(id * 12.9898) * (1 + id % 7) AS y")
    values = df.toPandas().sort_values("id")["y"].to_numpy()
    centred = values - 1e9
    inside = np.abs(centred - centred.mean()) <= 1.5 * centred.std(ddof=1)
    assert dl.zscore_filter(df, "y", 1.5).count() == inside.sum()


def test_zscore_keeps_rows_without_value_or_spread(frame):
    df = frame("y double", [(1.0,)] * 30 + [(100.0,), (None,), (float("nan"),)])
    assert dl.zscore_filter(df, "y").count() == 32
    assert dl.zscore_filter(df.where("y = 1"), "y").count() == 30
    assert dl.zscore_filter(df.where("false"), "y").count() == 0
