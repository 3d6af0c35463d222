"""Cleaning."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators import clean as ops
from dataloupe.specs import ProcessingPlan

_HOLES = "(SELECT * REPLACE (nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax) FROM lineitem)"


def holes(t: Tables) -> DataFrame:
    """lineitem with its zero discounts and taxes taken out."""
    zero = F.lit(0.0)
    return t.lineitem.withColumns(
        {n: F.nullif(F.col(n), zero) for n in ("l_discount", "l_tax")}
    )


@query(f"""
SELECT count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL) AS null_cells
FROM {_HOLES}""")
def null_cell_count(t: Tables) -> DataFrame:
    return ops.null_cell_count(holes(t))


@query("""
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows
FROM documents""")
def duplicate_row_count(t: Tables) -> DataFrame:
    return ops.duplicate_row_count(t.documents.select("text", "lang"))


@query("SELECT DISTINCT text, lang FROM documents")
def drop_duplicates(t: Tables) -> DataFrame:
    return ops.drop_duplicates(t.documents.select("text", "lang"))


_RETURNED_TWICE = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')"


def returned_twice(t: Tables) -> DataFrame:
    """lineitem with its returned lines a second time."""
    return t.lineitem.union(t.lineitem.where("l_returnflag = 'R'"))


@query(f"""
SELECT (SELECT count(*) FROM {_RETURNED_TWICE}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))
  AS duplicate_rows""")
def duplicate_row_count_wide(t: Tables) -> DataFrame:
    return ops.duplicate_row_count(returned_twice(t))


@query("SELECT DISTINCT * FROM lineitem")
def drop_duplicates_wide(t: Tables) -> DataFrame:
    return ops.drop_duplicates(returned_twice(t))


@query(f"SELECT * FROM {_HOLES} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def drop_null_rows(t: Tables) -> DataFrame:
    return ops.drop_null_rows(holes(t))


@query("SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def drop_columns(t: Tables) -> DataFrame:
    return ops.drop_columns(t.lineitem, ["l_tax", "l_discount", "not_there"])


@query("""
SELECT * RENAME (o_orderkey AS "Order", o_totalprice AS "Total price", o_orderstatus AS status)
FROM orders""")
def rename_columns(t: Tables) -> DataFrame:
    names = {"o_orderkey": "Order", "o_totalprice": "Total price", "o_orderstatus": "status", "gone": "x"}
    return ops.rename_columns(t.orders, names)


_TEXT_DATES = """
(SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
   WHEN 1 THEN strftime(ts, '%m/%d/%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
   ELSE 'on ' || strftime(ts, '%Y') END AS seen FROM events)"""


@query(f"""
SELECT event_id, coalesce(try_cast(seen AS TIMESTAMP), try_strptime(seen, '%m/%d/%Y')) AS seen
FROM {_TEXT_DATES}""")
def coerce_timestamp(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    seen = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "MM/dd/yyyy"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("on "), F.date_format("ts", "yyyy")))
    )
    texts = t.events.select("event_id", seen.alias("seen"))
    return ops.coerce_timestamp(texts, ["seen"], ["MM/dd/yyyy"])


@query("""
SELECT o_orderkey, try_strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS dotted,
       try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS slashed, o_orderdate AS mixed
FROM orders""")
def coerce_timestamp_common_formats(t: Tables) -> DataFrame:
    """No format is given; the cells tell day first from month first."""
    texts = t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("slashed"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("mixed"),
    )
    return ops.coerce_timestamp(texts, ["dotted", "slashed", "mixed"])


@query("""
SELECT o_orderkey AS "Order", o_totalprice AS price, o_orderstatus, o_orderdate AS placed, o_orderpriority
FROM orders""")
def apply_processing_plan(t: Tables) -> DataFrame:
    texts = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy/MM/dd"))
    plan = ProcessingPlan(
        drop_columns=("o_custkey",),
        temporal_columns=("o_orderdate",),
        column_mapping={"o_orderkey": "Order", "o_totalprice": "price", "o_orderdate": "placed"},
        time_formats=("yyyy/MM/dd",),
    )
    return ops.apply_processing_plan(texts, plan)


_NARROW = "(SELECT l_quantity, l_returnflag, nullif(l_discount, 0) AS l_discount FROM lineitem)"


@query(f"""
SELECT count(*) FILTER (l_discount IS NULL) AS null_cells,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_NARROW})) AS duplicate_rows,
       count(*) AS rows_before,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM {_NARROW} WHERE l_discount IS NOT NULL)) AS rows_after
FROM {_NARROW}""")
def clean_report(t: Tables) -> DataFrame:
    _, report = ops.clean(holes(t).select("l_quantity", "l_returnflag", "l_discount"))
    return t.spark.createDataFrame([report])


@query(f"SELECT DISTINCT l_quantity, l_returnflag, {r('l_discount', 'l_discount')} FROM {_NARROW} WHERE l_discount IS NOT NULL")
def clean_rows(t: Tables) -> DataFrame:
    cleaned, _ = ops.clean(holes(t).select("l_quantity", "l_returnflag", "l_discount"))
    return cleaned
