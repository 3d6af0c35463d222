import datetime as dt
import logging

import pytest

import dataloupe as dl

NAN = float("nan")


def nan_rows(frame):
    rows = [("a", 1.0), ("a", 1.0), ("b", NAN), ("b", NAN), ("c", None), (None, 2.0), ("d", 4.0),
            ("e", 5.0), ("f", 6.0), ("g", 0.0), ("g", -0.0)]
    return frame("k string, `my v` double", rows)


def test_counts_before_cleaning(frame):
    df = nan_rows(frame)
    assert dl.null_cell_count(df).first()[0] == 4
    assert dl.duplicate_row_count(df).first()[0] == 3
    assert dl.drop_duplicates(df).count() == 8
    assert dl.drop_null_rows(df).count() == 7


def test_clean(frame):
    cleaned, report = dl.clean(nan_rows(frame))
    assert (report.null_cells, report.duplicate_rows) == (4, 3)
    assert (report.rows_before, report.rows_after) == (11, 5)
    assert cleaned.columns == ["k", "my_v"]
    assert sorted(r["k"] for r in cleaned.collect()) == ["a", "d", "e", "f", "g"]


def test_clean_rejects_small_tables(frame):
    with pytest.raises(ValueError, match="2 rows"):
        dl.clean(frame("a int", [(1,), (2,), (None,), (2,)]))
    with pytest.raises(ValueError, match="empty"):
        dl.clean(frame("a int", [(None,)] * 9))


def test_clean_keeps_a_column_called_copies(frame):
    cleaned, report = dl.clean(frame("copies int", [(i,) for i in range(6)] * 2))
    assert cleaned.columns == ["copies"] and report.duplicate_rows == 6


def test_rename_and_drop(frame):
    df = frame("a int, b int", [(1, 2)])
    assert dl.rename_columns(df, {"a": "b", "b": "a", "z": "y"}).columns == ["b", "a"]
    with pytest.raises(ValueError, match="several"):
        dl.rename_columns(df, {"a": "b"})
    assert dl.drop_columns(df, ["a", "zz"]).columns == ["b"]


def test_coerce_timestamp(frame):
    rows = [("2021-03-04",), ("2021-03-04 05:06:07",), ("03/04/2021",), ("junk",), ("",), (None,)]
    df = frame("d string", rows)
    plain = [r[0] for r in dl.coerce_timestamp(df, ["d"]).collect()]
    day = dt.datetime(2021, 3, 4)
    assert plain == [day, dt.datetime(2021, 3, 4, 5, 6, 7), day, None, None, None]
    assert [r[0] for r in dl.coerce_timestamp(df, ["d"], ["MM/dd/yyyy"]).collect()][2] == day
    dates = frame("d date", [(dt.date(2020, 1, 2),)])
    assert dl.coerce_timestamp(dates, ["d"]).dtypes == [("d", "timestamp_ntz")]
    with pytest.raises(ValueError, match="unknown"):
        dl.coerce_timestamp(df, ["nope"])


def test_processing_plan_uses_original_names(frame):
    df = frame("a string, b int, c int", [("2020-01-01", 1, 2)])
    plan = dl.ProcessingPlan(("b",), ("a",), {"a": "When", "b": "Never", "c": "b"})
    assert dl.apply_processing_plan(df, plan).columns == ["When", "b"]
    assert plan.renamed("a") == "When" and plan.renamed("x") == "x"


def test_arithmetic(frame):
    df = frame("a int, b int, x double", [(6, 4, 1.5), (6, 0, NAN), (None, 2, 0.0)])
    got = dl.add_ratio(df, "r", "a", "b").select("r").collect()
    assert [r[0] for r in got] == [1.5, None, None]
    assert [r[0] for r in dl.add_sum(df, "s", "a", "x").select("s").collect()] == [7.5, None, None]
    assert [r[0] for r in dl.add_difference(df, "s", "b", "a").select("s").collect()] == [-2, -6, None]
    assert [r[0] for r in dl.add_product(df, "s", "a", "b").select("s").collect()] == [24, 0, None]
    big = frame("a int, b int", [(2**31 - 1, 2**31 - 1)])
    assert dl.add_product(big, "p", "a", "b").first()["p"] == (2**31 - 1) ** 2
    with pytest.raises(ValueError, match="not numeric"):
        dl.add_sum(frame("a string, b int", [("1", 1)]), "s", "a", "b")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_between_floor(spark, frame, zone):
    base = dt.datetime(1969, 3, 8, 12)
    step = dt.timedelta(days=1, hours=18)
    rows = [(base + step, base), (base, base + step), (base, base), (base + dt.timedelta(days=3), base),
            (dt.datetime(2021, 3, 15, 0), dt.datetime(2021, 3, 13, 0))]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = frame("a timestamp_ntz, b timestamp_ntz", rows)
        got = [r[0] for r in dl.add_days_between(df, "d", "a", "b").select("d").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1, -2, 0, 3, 2]


def spanning(frame, days):
    start = dt.datetime(2020, 1, 1, 6)
    return frame("t timestamp_ntz, v int", [(start, 1), (start + dt.timedelta(days=days, hours=5), 2), (None, 3)])


@pytest.mark.parametrize("days, names", [
    (30, ["t_day"]), (31, ["t_day", "t_month"]), (182, ["t_day", "t_month"]),
    (183, ["t_month"]), (364, ["t_month"]), (365, ["t_month", "t_year"]),
])
def test_calendar_features(frame, days, names):
    df = spanning(frame, days)
    done = dl.add_calendar_features(df, "t")
    assert done.columns == ["t", "v", *names]
    first = done.where("v = 1").first()
    expected = {"t_day": "Wednesday", "t_month": "January", "t_year": 2020}
    assert {n: first[n] for n in names} == {n: expected[n] for n in names}


def test_names_of_all_days_and_months(spark):
    df = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2023-12-31')) AS d")
    named = dl.add_day_name(dl.add_month_name(df, "d"), "d")
    formatted = named.selectExpr("d_day = date_format(d, 'EEEE') AND d_month = date_format(d, 'MMMM') AS same")
    assert formatted.where("same").count() == 365


def test_time_span(frame):
    df = spanning(frame, 29)
    row = dl.time_span(df, ["t", "v"]).first()
    assert row["days"] == 29
    assert row["message"] == "Data spans 29 days (From 2020-01-01 to 2020-01-30)."
    assert dl.time_span(df, []).first()["message"] == "No temporal data identified. Skip temporal features."
    assert dl.time_span(df, ["v"]).first()["message"] == "Column v is not in datetime format."
    empty = dl.time_span(df.where("t is null"), ["t"]).first()
    assert (empty["days"], empty["message"]) == (0, "Temporal column contains only null values.")


def test_recipes_skip_what_does_not_fit(frame, caplog):
    df = spanning(frame, 10).withColumn("w", dl.functions.columns.col("v") * 2)
    recipes = [
        dl.FeatureRecipe("addition", "sum", "v", "w"),
        dl.FeatureRecipe("division", "half", "sum", "w"),
        dl.FeatureRecipe("subtraction", "span", "t", "t"),
        dl.FeatureRecipe("subtraction", "bad", "t", "v"),
        dl.FeatureRecipe("cumulative", "bad", "v", "w"),
        dl.FeatureRecipe("addition", "bad", "v"),
        dl.FeatureRecipe("addition", "bad", "v", "gone"),
        dl.FeatureRecipe("temporal", None, "v"),
        dl.FeatureRecipe("temporal", None, "t"),
    ]
    with caplog.at_level(logging.WARNING):
        done, added = dl.apply_recipes(df, recipes, ["t"])
    assert added == ["sum", "half", "span", "t_day"]
    assert done.columns == ["t", "v", "w", *added]
    assert len(caplog.records) == 5


def test_common_date_layouts(frame):
    def days(values, **options):
        df = dl.coerce_timestamp(frame("d string", [(v,) for v in values]), ["d"], **options)
        return [str(r[0])[:10] if r[0] else None for r in df.collect()]

    assert days(["03/14/2021", "03/04/2021", None, "junk"]) == ["2021-03-14", "2021-03-04", None, None]
    assert days(["14/03/2021", "04/03/2021"]) == ["2021-03-14", "2021-03-04"]  # other cells decide
    assert days(["14 March 2021", "2021-03-05"]) == ["2021-03-14", "2021-03-05"]
    assert days(["14.03.2021 10:30", "Mar 5, 2021"]) == [None, "2021-03-05"]  # one layout per column
    assert days(["03/14/2021"], formats=["d/M/yyyy"]) == [None]


def test_overflow_is_null(frame):
    df = frame("a bigint, b bigint", [(2**62, 4), (3, 5)])
    got = dl.add_product(dl.add_sum(dl.add_difference(df, "d", "b", "a"), "s", "a", "a"), "p", "a", "b")
    rows = [tuple(r)[2:] for r in got.orderBy("a").collect()]
    assert rows == [(2, 6, 15), (4 - 2**62, None, None)]


def test_names_that_differ_by_case_collide(frame):
    import pytest

    with pytest.raises(ValueError, match="several"):
        dl.rename_columns(frame("a int, b int", [(1, 2)]), {"b": "A"})
