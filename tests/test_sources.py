import time

import pytest
from pyspark.sql import functions as F

import dataloupe as dl


def test_clean_names():
    assert dl.clean_names([" a", "a ", "a.b", "a b", "a"]) == ["a", "a_1", "a_b", "a_b_1", "a_2"]
    assert dl.clean_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    assert dl.clean_names(["a_1", "a", "a"]) == ["a_1", "a", "a_2"]
    assert dl.clean_names([]) == []
    assert dl.clean_names(["a", "A", "a_1", "B"]) == ["a", "A_1", "a_1_1", "B"]


def test_sanitize_columns_only_renames(frame):
    df = dl.sanitize_columns(frame("`x y` int, `x.y` int, `x_y` int", [(1, 2, 3)]))
    assert df.columns == ["x_y", "x_y_1", "x_y_2"]
    assert tuple(df.first()) == (1, 2, 3)


CSV = (
    "﻿a,a,when,n,mixed,flag,late,empty, big ,text\r\n"
    "1,1.5,2021-03-04,NA,1,True,7,,9223372036854775808,\"x, \"\"y\"\"\"\r\n"
    "2,-2e3,2021-03-05,4,b,False,,NaN,1,NULL\r\n"
    "3,inf,2021-03-06,5,3,True,9,N/A,2,plain\r\n"
)


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(CSV.encode("utf-8"))
    df = dl.read_table(spark, str(path))
    assert dict(df.dtypes) == {
        "a": "bigint", "a_1": "double", "when": "string", "n": "bigint", "mixed": "string",
        "flag": "boolean", "late": "bigint", "empty": "double", "big": "double", "text": "string",
    }
    rows = df.orderBy("a").collect()
    assert [r["n"] for r in rows] == [None, 4, 5]
    assert rows[0]["a_1"] == 1.5 and rows[1]["a_1"] == -2000.0 and rows[2]["a_1"] == float("inf")
    assert [r["text"] for r in rows] == ['x, "y"', None, "plain"]
    assert [r["empty"] for r in rows] == [None] * 3
    assert rows[0]["big"] == float(2**63)


def test_csv_with_schema_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,v\n"two\nlines",1\nplain,NA\n')
    df = dl.read_table(spark, str(path), schema="k string, v int", multiline=True)
    assert sorted(map(tuple, df.collect())) == [("plain", None), ("two\nlines", 1)]


def test_read_table_rejects(spark, tmp_path):
    with pytest.raises(ValueError, match="fmt"):
        dl.read_table(spark, "x", "xlsx")
    empty = tmp_path / "e.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="empty"):
        dl.read_table(spark, str(empty))


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(path)
    assert dl.read_table(spark, path, "parquet").where("v is null").count() == 1


def test_minimum_rows(frame):
    rows = [("k", float(i)) for i in range(5)]
    schema = "k string, v double"
    assert dl.require_min_rows(frame(schema, rows)).count() == 5
    with pytest.raises(ValueError, match="4 rows"):
        dl.require_min_rows(frame(schema, rows[:4]))
    with pytest.raises(ValueError, match="empty"):
        dl.require_min_rows(frame(schema, []))


def test_sample_and_preview(spark):
    df = spark.range(1000)
    drawn = dl.sample_rows(df, 20, seed=3).collect()
    assert len(drawn) == 20 and len(set(drawn)) == 20
    assert drawn == dl.sample_rows(df, 20, seed=3).collect()
    assert dl.sample_rows(spark.range(3), 5).count() == 3
    assert dl.preview(df).count() == 5


def test_write_results(spark, tmp_path):
    df = spark.range(3).select("id", (F.col("id") * 0.5).alias("v"))
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        dl.write_results(df, path, fmt)
        back = spark.read.format(fmt).load(path).select("id", "v")
        assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        dl.write_results(df, str(tmp_path / "x"), "xml")


def test_headers_that_differ_by_case(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,A\n1,x\n2,y\n")
    df = dl.read_table(spark, str(path))
    assert df.columns == ["a", "A_1"] and sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y")]


def test_lost_cells_are_refused(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="1 rows have more than 2 cells"):
        dl.read_table(spark, str(path))
    with pytest.raises(ValueError, match="more than 2"):
        dl.read_table(spark, str(path), schema="a int, b int")
    path.write_text("a,b\n1,2\n3,x\nNA,9\n")
    with pytest.raises(ValueError, match=r"\{'b': 1\}"):
        dl.read_table(spark, str(path), schema="a int, b int")


def test_folders_need_one_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("a,b\n3,4\n")
    assert sorted(map(tuple, dl.read_table(spark, str(folder)).collect())) == [(1, 2), (3, 4)]
    (folder / "3.csv").write_text("b,a\n5,6\n")
    with pytest.raises(ValueError, match="different headers"):
        dl.read_table(spark, str(folder))


def test_header_stops_at_the_first_line(spark, tmp_path):
    """The bytes read for the header do not follow the size of the files."""
    from dataloupe.sources import tables

    def read_so_far():
        time.sleep(0.5)  # figures of executors arrive late
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalInputBytes() for i in range(found.size()))

    for name in ("1.csv", "2.csv"):
        (tmp_path / name).write_text('"a b",c\n' + "some text,1\n" * 2_000_000)
    (tmp_path / "3.csv").write_text("")
    for i in range(12):
        (tmp_path / f"small{i}.csv").write_text('"a b",c\nx,1\n')
    before = read_so_far()
    assert tables._header(spark, str(tmp_path)) == ["a b", "c"]
    assert 0 < read_so_far() - before < 1_000_000
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) < 1 << 40
    with pytest.raises(ValueError, match="empty"):
        tables._header(spark, str(tmp_path / "3.csv"))


def test_headers_of_files_with_odd_names(spark, tmp_path, monkeypatch):
    from dataloupe.sources import tables

    monkeypatch.setattr(tables, "FILES_A_JOB", 2)
    for name in ("a b.csv", "c%20d.csv", "e[1].csv", "f+g=h.csv", "é.csv"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    assert tables._header(spark, str(tmp_path)) == ["a", "b"]
    for name in ("a b.csv", "c%20d.csv", "e[1].csv", "f+g=h.csv", "é.csv"):
        (tmp_path / name).write_text("a,c\n1,2\n")
        with pytest.raises(ValueError, match="different"):
            tables._header(spark, str(tmp_path))
        (tmp_path / name).write_text("a,b\n1,2\n")
