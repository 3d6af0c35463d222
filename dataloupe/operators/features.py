"""Derived columns and the time span of a table."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dataloupe.functions import wording
from dataloupe.functions.columns import (
    col, is_numeric, is_temporal, require_columns, wall_clock, whole_days, without_nan,
)
from dataloupe.specs import RECIPE_KINDS, FeatureRecipe

log = logging.getLogger(__name__)


def _operands(df: DataFrame, *names: str) -> list[Column]:
    """Numeric columns, NaN as NULL, whole numbers widened to bigint."""
    require_columns(df, *names)
    wrong = [n for n in names if not is_numeric(df, n)]
    if wrong:
        raise ValueError(f"columns {wrong} are not numeric")
    whole = [isinstance(df.schema[n].dataType, T.IntegralType) for n in names]
    return [col(n).cast("long") if w else without_nan(df, n) for n, w in zip(names, whole)]


def add_ratio(df: DataFrame, new: str, num: str, den: str) -> DataFrame:
    """num / den as double; NULL where the denominator is zero."""
    top, bottom = (c.cast("double") for c in _operands(df, num, den))
    return df.withColumn(new, top / F.nullif(bottom, F.lit(0.0)))


def add_sum(df: DataFrame, new: str, a: str, b: str) -> DataFrame:
    """a + b; NULL where the sum does not fit its type. The same holds for the next two."""
    left, right = _operands(df, a, b)
    return df.withColumn(new, F.try_add(left, right))


def add_difference(df: DataFrame, new: str, a: str, b: str) -> DataFrame:
    left, right = _operands(df, a, b)
    return df.withColumn(new, F.try_subtract(left, right))


def add_product(df: DataFrame, new: str, a: str, b: str) -> DataFrame:
    left, right = _operands(df, a, b)
    return df.withColumn(new, F.try_multiply(left, right))


def add_days_between(df: DataFrame, new: str, a: str, b: str) -> DataFrame:
    """Whole days from b to a, rounded down also for negative spans."""
    _need_time(df, a, b)
    return df.withColumn(new, whole_days(wall_clock(a), wall_clock(b)))


def _need_time(df: DataFrame, *names: str) -> None:
    wrong = [n for n in names if not is_temporal(df, n)]
    if wrong:
        raise ValueError(f"columns {wrong} hold no dates or timestamps")


# Calendar names in the order of dayofweek() and month().
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
)


def _named(names: tuple[str, ...], number: Column) -> Column:
    """A lookup in a constant array: many times cheaper than formatting each date."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), number)


def add_day_name(df: DataFrame, name: str) -> DataFrame:
    _need_time(df, name)
    return df.withColumn(f"{name}_day", _named(DAYS, F.dayofweek(wall_clock(name))))


def add_month_name(df: DataFrame, name: str) -> DataFrame:
    _need_time(df, name)
    return df.withColumn(f"{name}_month", _named(MONTHS, F.month(wall_clock(name))))


def add_year(df: DataFrame, name: str) -> DataFrame:
    _need_time(df, name)
    return df.withColumn(f"{name}_year", F.year(wall_clock(name)))


def time_span(df: DataFrame, temporal_columns: list[str]) -> DataFrame:
    """One row ``(column, min_ts, max_ts, days, message)`` for the first temporal column."""
    spark = df.sparkSession
    if not temporal_columns:
        return _no_span(spark, None, wording.NO_TEMPORAL)
    name = temporal_columns[0]
    require_columns(df, name)
    if not is_temporal(df, name):
        return _no_span(spark, name, wording.NOT_TEMPORAL.format(column=name))
    ends = df.select(wall_clock(name).alias("t")).agg(
        F.min("t").alias("min_ts"), F.max("t").alias("max_ts")
    )
    days = F.coalesce(whole_days(F.col("max_ts"), F.col("min_ts")), F.lit(0).cast("long"))
    message = F.when(
        F.col("min_ts").isNotNull(),
        F.format_string(
            wording.SPAN_MESSAGE,
            days,
            F.date_format("min_ts", "yyyy-MM-dd"),
            F.date_format("max_ts", "yyyy-MM-dd"),
        ),
    ).otherwise(wording.ALL_NULL_TEMPORAL)
    return ends.select(
        F.lit(name).alias("column"), "min_ts", "max_ts", days.alias("days"), message.alias("message")
    )


def _no_span(spark, name: str | None, reason: str) -> DataFrame:
    nothing = F.lit(None).cast("timestamp_ntz")
    return spark.range(1).select(
        F.lit(name).cast("string").alias("column"),
        nothing.alias("min_ts"),
        nothing.alias("max_ts"),
        F.lit(0).cast("long").alias("days"),
        F.lit(reason).alias("message"),
    )


def day_span(df: DataFrame, temporal_columns: list[str]) -> int:
    return time_span(df, temporal_columns).first()["days"]


# First span in days at which each set of calendar columns ends.
CALENDAR_SPANS = ((31, ("day",)), (183, ("day", "month")), (365, ("month",)))
LONG_CALENDAR = ("month", "year")
PARTS = {"day": add_day_name, "month": add_month_name, "year": add_year}


def add_calendar_features(
    df: DataFrame, name: str, span_days: int | None = None
) -> DataFrame:
    """Weekday, month and year columns that suit the span of the data.

    ``span_days`` is the span of the table's primary time column; by default that of
    ``name`` itself.
    """
    _need_time(df, name)
    if span_days is None:
        span_days = day_span(df, [name])
    for part in calendar_parts(span_days):
        df = PARTS[part](df, name)
    return df


def calendar_parts(span_days: int) -> tuple[str, ...]:
    return next((parts for end, parts in CALENDAR_SPANS if span_days < end), LONG_CALENDAR)


def apply_recipes(
    df: DataFrame, recipes: list[FeatureRecipe], temporal_columns: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Apply recipes in order; returns the frame and the names of the new columns.

    A later recipe may use an earlier column. One that does not fit the schema is
    skipped with a warning.
    """
    added: list[str] = []
    span: int | None = None
    for recipe in recipes:
        try:
            _check(df, recipe)
            if recipe.kind == "temporal":
                if span is None:
                    span = day_span(df, list(temporal_columns or [recipe.left]))
                df = add_calendar_features(df, recipe.left, span)
                added += [f"{recipe.left}_{p}" for p in calendar_parts(span)]
                continue
            df = _arithmetic(df, recipe)
        except ValueError as reason:
            log.warning("recipe %s skipped: %s", recipe, reason)
            continue
        added.append(recipe.new_name)
    return df, added


def _check(df: DataFrame, recipe: FeatureRecipe) -> None:
    if recipe.kind not in RECIPE_KINDS:
        raise ValueError(f"unknown kind {recipe.kind!r}")
    operands = [recipe.left] if recipe.kind == "temporal" else [recipe.left, recipe.right, recipe.new_name]
    if None in operands:
        raise ValueError("an operand is missing")
    require_columns(df, recipe.left, recipe.right)


def _arithmetic(df: DataFrame, recipe: FeatureRecipe) -> DataFrame:
    if recipe.kind == "subtraction" and is_temporal(df, recipe.left) and is_temporal(df, recipe.right):
        step = add_days_between
    else:
        step = {
            "division": add_ratio,
            "addition": add_sum,
            "subtraction": add_difference,
            "multiplication": add_product,
        }[recipe.kind]
    return step(df, recipe.new_name, recipe.left, recipe.right)
