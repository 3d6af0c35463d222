"""Reading, sampling and writing."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators.charts import bar_mean
from dataloupe.operators.clean import coerce_timestamp
from dataloupe.plans.storage import scratch_path
from dataloupe.sources import (
    preview, read_table, require_min_rows, sample_rows, sanitize_columns, write_results,
)


@query("SELECT * FROM orders")
def read_table_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    t.orders.write.option("header", True).csv(path)
    return coerce_timestamp(read_table(t.spark, path), ["o_orderdate"])


@query(f"""
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity,
       {r("nullif(l_discount, 0)", "l_discount")}, l_returnflag, l_linestatus = 'O' AS is_open
FROM lineitem""")
def read_table_csv_missing_markers(t: Tables) -> DataFrame:
    """Markers for missing cells, whole numbers and booleans, as text in a CSV."""
    path = scratch_path(t.spark, "csv")
    text = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("long").alias("l_quantity"),
        F.when(F.col("l_discount") != 0, F.col("l_discount").cast("string"))
        .when(F.col("l_linenumber") % 2 == 0, "NA").otherwise("n/a").alias("l_discount"),
        "l_returnflag",
        F.when(F.col("l_linestatus") == "O", "True").otherwise("False").alias("is_open"),
    )
    text.write.option("header", True).csv(path)
    return read_table(t.spark, path).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("SELECT * FROM customer")
def read_table_parquet(t: Tables) -> DataFrame:
    return read_table(t.spark, f"{t.folder}/customer.parquet", "parquet")


@query("""
SELECT s_suppkey AS s_key, s_name, s_nationkey AS s_name_1, s_acctbal AS s_name_2 FROM supplier""")
def sanitize_column_names(t: Tables) -> DataFrame:
    return sanitize_columns(t.supplier.toDF("s key", "s.name", " s_name", "s name "))


def _found(drawn: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """How many rows were drawn, how many differ, how many are rows of the table."""
    rows = drawn.select(F.col(key).alias("drawn"))
    known = table.select(F.col(key).alias("known")).distinct()
    # The drawn side is a handful of rows by construction.
    matched = known.join(rows, F.col("known") == F.col("drawn"), "right")
    return matched.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("drawn").alias("n_distinct"),
        F.count("known").alias("n_found"),
    )


_FIVE = "SELECT least(5, count(*)) AS n_rows, least(5, count(*)) AS n_distinct, least(5, count(*)) AS n_found FROM "


@query(_FIVE + "events")
def preview_rows(t: Tables) -> DataFrame:
    return _found(preview(t.events), t.events, "event_id")


@query(_FIVE + "documents")
def random_sample(t: Tables) -> DataFrame:
    return _found(sample_rows(t.documents, 5, seed=7), t.documents, "doc_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def minimum_rows_guard(t: Tables) -> DataFrame:
    kept = require_min_rows(t.orders, 5)
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_MEANS = f"""
SELECT flag_status, {r("avg(y)", "mean")}, {r("avg(y) - 1.96 * stddev_samp(y) / sqrt(count(*))", "ci_low")},
       {r("avg(y) + 1.96 * stddev_samp(y) / sqrt(count(*))", "ci_high")}, count(*) AS n
FROM (SELECT l_returnflag || l_linestatus AS flag_status, l_extendedprice AS y FROM lineitem)
GROUP BY 1"""


@query(_MEANS)
def write_results_json(t: Tables) -> DataFrame:
    return _written(t, "json")


@query(_MEANS)
def write_results_parquet(t: Tables) -> DataFrame:
    return _written(t, "parquet")


def _written(t: Tables, fmt: str) -> DataFrame:
    key = F.concat("l_returnflag", "l_linestatus").alias("flag_status")
    means = bar_mean(t.lineitem.select(key, "l_extendedprice"), "flag_status", "l_extendedprice")
    path = scratch_path(t.spark, "results")
    write_results(means, path, fmt)
    return t.spark.read.schema(means.schema).format(fmt).load(path)
