"""Derived columns and time spans."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators import features as ops
from dataloupe.specs import FeatureRecipe


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )


_LINES = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax"


@query(f"{_LINES}, {r('l_tax / nullif(l_discount, 0)', 'tax_per_discount')} FROM lineitem")
def add_ratio(t: Tables) -> DataFrame:
    return ops.add_ratio(lines(t), "tax_per_discount", "l_tax", "l_discount")


@query(f"{_LINES}, {r('l_tax + l_discount', 'rates')} FROM lineitem")
def add_sum(t: Tables) -> DataFrame:
    return ops.add_sum(lines(t), "rates", "l_tax", "l_discount")


@query(f"{_LINES}, {r('l_extendedprice - l_quantity', 'difference')} FROM lineitem")
def add_difference(t: Tables) -> DataFrame:
    return ops.add_difference(lines(t), "difference", "l_extendedprice", "l_quantity")


@query(f"{_LINES}, {r('l_extendedprice * l_discount', 'rebate')} FROM lineitem")
def add_product(t: Tables) -> DataFrame:
    return ops.add_product(lines(t), "rebate", "l_extendedprice", "l_discount")


@query("""
SELECT l_orderkey, l_linenumber, CAST(floor(epoch_us(l_shipdate) / 86400e6 - epoch_us(o_orderdate) / 86400e6) AS BIGINT) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def add_days_between(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dated = ops.add_days_between(joined, "days", "l_shipdate", "o_orderdate")
    return dated.select("l_orderkey", "l_linenumber", "days")


@query("""
SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400e6) AS BIGINT) AS days
FROM events""")
def add_days_between_partial_days(t: Tables) -> DataFrame:
    noon = t.events.withColumn("noon", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return ops.add_days_between(noon, "days", "ts", "noon").select("event_id", "days")


@query("SELECT o_orderkey, o_orderdate, dayname(o_orderdate) AS o_orderdate_day FROM orders")
def add_day_name(t: Tables) -> DataFrame:
    return ops.add_day_name(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("SELECT o_orderkey, o_orderdate, monthname(o_orderdate) AS o_orderdate_month FROM orders")
def add_month_name(t: Tables) -> DataFrame:
    return ops.add_month_name(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year FROM orders")
def add_year(t: Tables) -> DataFrame:
    return ops.add_year(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


# The order dates span 2404 days; dividing their distance from the epoch by 16 and by 10
# gives whole tables that span about 150 and 240 days.
_SQUEEZED = "(SELECT o_orderkey, make_timestamp(CAST(epoch(o_orderdate) AS BIGINT) // {k} * 1000000) AS placed FROM orders)"


def squeezed(t: Tables, k: int) -> DataFrame:
    seconds = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / k)
    return t.orders.select(
        "o_orderkey", F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("placed")
    )


@query("""
SELECT o_orderkey, o_orderdate, monthname(o_orderdate) AS o_orderdate_month,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year FROM orders""")
def calendar_features_long_span(t: Tables) -> DataFrame:
    return ops.add_calendar_features(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate")


@query(f"""
SELECT o_orderkey, placed, dayname(placed) AS placed_day, monthname(placed) AS placed_month
FROM {_SQUEEZED.format(k=16)}""")
def calendar_features_half_year(t: Tables) -> DataFrame:
    return ops.add_calendar_features(squeezed(t, 16), "placed")


@query(f"SELECT o_orderkey, placed, monthname(placed) AS placed_month FROM {_SQUEEZED.format(k=10)}")
def calendar_features_year(t: Tables) -> DataFrame:
    return ops.add_calendar_features(squeezed(t, 10), "placed")


@query("SELECT event_id, ts, dayname(ts) AS ts_day FROM events")
def calendar_features_month(t: Tables) -> DataFrame:
    return ops.add_calendar_features(t.events.select("event_id", "ts"), "ts")


@query(f"""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_shipdate,
       {r('l_extendedprice * l_discount', 'rebate')},
       {r('l_extendedprice - l_extendedprice * l_discount', 'net')},
       {r('(l_extendedprice - l_extendedprice * l_discount) / nullif(l_tax, 0)', 'net_per_tax')},
       {r('l_tax + l_discount', 'rates')},
       monthname(l_shipdate) AS l_shipdate_month, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_year
FROM lineitem""")
def apply_recipes(t: Tables) -> DataFrame:
    """Recipes in order; the second uses the first, the last two do not fit and are skipped."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"
    )
    recipes = [
        FeatureRecipe("multiplication", "rebate", "l_extendedprice", "l_discount"),
        FeatureRecipe("subtraction", "net", "l_extendedprice", "rebate"),
        FeatureRecipe("division", "net_per_tax", "net", "l_tax"),
        FeatureRecipe("addition", "rates", "l_tax", "l_discount"),
        FeatureRecipe("temporal", None, "l_shipdate"),
        FeatureRecipe("subtraction", "mixed", "l_shipdate", "l_tax"),
        FeatureRecipe("division", "no_operand", "l_tax"),
    ]
    done, _ = ops.apply_recipes(rows, recipes, ["l_shipdate"])
    return done


@query("""
SELECT 'o_orderdate' AS "column", min(o_orderdate) AS min_ts, max(o_orderdate) AS max_ts,
       CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400e6) AS BIGINT) AS days,
       printf('Data spans %d days (From %s to %s).',
              CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400e6) AS BIGINT),
              strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d')) AS message
FROM orders""")
def time_span(t: Tables) -> DataFrame:
    return ops.time_span(t.orders, ["o_orderdate"])


@query("""
SELECT 'ts' AS "column", min(ts) AS min_ts, max(ts) AS max_ts,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT) AS days,
       printf('Data spans %d days (From %s to %s).',
              CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6) AS BIGINT),
              strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d')) AS message
FROM events""")
def time_span_with_clock(t: Tables) -> DataFrame:
    return ops.time_span(t.events, ["ts", "event_id"])
