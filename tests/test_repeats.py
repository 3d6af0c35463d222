"""Rows that repeat: digests, forced collisions, odd types, and what is shuffled."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import dataloupe as dl
from dataloupe.plans import repeats

NAN = float("nan")


def shuffled_bytes(df) -> int:
    """Bytes written to shuffles while ``df`` is run, from the metrics of its executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        found = node.metrics().get("shuffleBytesWritten")
        if found.isDefined():
            total += found.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def wide(spark, rows, every):
    """A table of 31 columns in which each ``every``-th row repeats row 0 of its thousand."""
    key = F.when(F.col("id") % every == 0, F.col("id") - F.col("id") % 1000).otherwise(F.col("id"))
    base = spark.range(0, rows, 1, 8).withColumn("k", key)
    return base.select("k", *[F.sha2((F.col("k") + i).cast("string"), 256).alias(f"t{i}") for i in range(30)])


def test_unique_rows_are_not_shuffled(spark):
    rows = 6_000
    df = wide(spark, rows, 100)
    distinct = rows - rows // 1000 * 9
    assert dl.drop_duplicates(df).count() == distinct
    assert dl.duplicate_row_count(df).first()[0] == rows - distinct
    assert 0 < shuffled_bytes(dl.duplicate_row_count(df)) < 40 * distinct
    single, again = repeats.split_by_repeats(df)
    assert single.count() + again.count() == rows and again.count() < 100


@pytest.fixture(params=["as it is", "one digest", "few digests", "one word"])
def digests(request, monkeypatch):
    """Runs a test with real digests and with ones that collide."""
    real = repeats.row_digest
    if request.param == "one digest":
        monkeypatch.setattr(repeats, "row_digest", lambda df: F.lit(-7).cast("long"))
    elif request.param == "few digests":
        monkeypatch.setattr(repeats, "row_digest", lambda df: F.pmod(real(df), F.lit(3)))
    elif request.param == "one word":
        monkeypatch.setattr(repeats, "MARK_BITS", 6)
    return request.param


def test_collisions_change_nothing(spark, digests):
    rows = [(i % 7, None if i % 3 else "x", float(i % 2) if i % 5 else NAN) for i in range(200)]
    rows += [(i, "single", 0.5) for i in range(1000, 1100)]
    rows += [(None, None, None)] * 5 + [(1, "", -0.0), (1, "", 0.0)] + [(9, "y" * 100, 1.0)] * 3
    df = spark.createDataFrame(rows, "d long, w string, bits double")

    def key(row):
        return tuple("nan" if v != v else v for v in row)

    counts = Counter(map(key, rows))
    assert dl.duplicate_row_count(df).first()[0] == len(rows) - len(counts)
    kept = dl.drop_duplicates(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert Counter(map(key, kept.collect())) == Counter(set(counts))
    cleaned, report = dl.clean(df)
    assert report.rows_before == len(rows) and report.duplicate_rows == len(rows) - len(counts)
    assert report.null_cells == sum((v is None or v == "nan") * n for r, n in counts.items() for v in r)
    assert report.rows_after == cleaned.count() == sum(None not in r and "nan" not in r for r in counts)


def test_odd_types(spark):
    rows = spark.range(40).select(
        F.array(F.lit(0.0) * F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0)).alias("a"),
        F.struct((F.col("id") % 2).alias("x"), F.lit(None).cast("int").alias("y")).alias("s"),
        F.lit("e").alias("d"), F.encode(F.lit("b"), "utf-8").alias("w"),
    )
    assert rows.distinct().count() == dl.drop_duplicates(rows).count() == 2
    assert dl.duplicate_row_count(rows).first()[0] == 38
    maps = spark.range(6).select(F.create_map(F.lit("k"), F.col("id") % 2).alias("m"), F.lit(1).alias("o"))
    assert dl.duplicate_row_count(maps).first()[0] == 4
    words = spark.sql("SELECT x COLLATE UTF8_LCASE AS x FROM VALUES ('a'), ('A'), ('b') AS t(x)")
    assert dl.duplicate_row_count(words).first()[0] == words.count() - words.distinct().count() == 1
    assert dl.drop_duplicates(words).count() == 2


def test_empty_and_equal_names(spark):
    df = spark.createDataFrame([(1, 2)] * 3 + [(1, 3)], "a int, b int")
    assert dl.drop_duplicates(df.where("false")).count() == 0
    assert dl.duplicate_row_count(df.where("false")).first()[0] == 0
    both = dl.drop_duplicates(df.toDF("a", "a"))
    assert both.columns == ["a", "a"] and both.count() == 2


def test_marks_have_a_bound(spark, monkeypatch):
    """The broadcast has at most one row per word of the field, however many rows repeat."""
    monkeypatch.setattr(repeats, "MARK_BITS", 10)
    df = spark.range(5000).union(spark.range(4000))
    single, again = repeats.split_by_repeats(df)
    assert single.count() + again.count() == 9000 and again.count() >= 8000
    assert dl.drop_duplicates(df).count() == 5000
    assert re.search("BroadcastHashJoin", dl.drop_duplicates(df)._jdf.queryExecution().toString())
