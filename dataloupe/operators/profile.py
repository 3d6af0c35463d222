"""Column profile: semantic class, nulls, ranges, medians, top values.

The work is done for all columns together. One scan keeps a small state per column and part of the
input: counts, ends, sums, a distinct sketch and a quantile sketch. Merged, they settle most
classes and enclose every median; an exact count over the few small columns settles the rest. The
exact medians and the value counts are two lazy plans: one reads the numbers, one the categories.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.functions import wording
from dataloupe.functions.columns import (
    col, is_flat, is_numeric, is_temporal, is_text, number, present, quoted, wall_clock, without_nan,
)
from dataloupe.plans.cardinality import distinct_up_to, merged_estimate, part_sketch, short_key
from dataloupe.plans.joins import lookup_join
from dataloupe.plans.quantiles import PARTS, bracket_sketch, merged_sketches, quantiles_in_brackets
from dataloupe.plans.storage import materialize

# Class names and the limits between them.
TEMPORAL, NUMERICAL, CATEGORICAL = "TEMPORAL", "NUMERICAL", "CATEGORICAL"
FEW_DISTINCT = 10
MANY_DISTINCT = 15
TOP_VALUES = 5
SKEW_RATIO = 50
SKEW_GUARD = 1e-6
MEDIAN = 0.5
LONG_TEXT = 64  # characters, from which a text is counted by its digest


@dataclass(frozen=True)
class NumberFacts:
    """Exact figures of a numeric column, and two values that enclose its median."""

    n: int
    min: float
    max: float
    sum: float
    low: float
    high: float


@dataclass(frozen=True)
class ColumnFacts:
    """What one scan tells about every column; ``numbers`` only if they were asked for."""

    rows: int
    nulls: dict[str, int]
    classes: dict[str, str]
    dates: dict[str, tuple[str | None, str | None]]
    skipped: list[str]
    longest: dict[str, int]
    numbers: dict[str, NumberFacts] | None = field(default=None)

    def of_class(self, wanted: str) -> list[str]:
        return [n for n, c in self.classes.items() if c == wanted]


def column_facts(df: DataFrame, numbers: bool = False) -> ColumnFacts:
    """Rows, nulls, classes and, if asked for, ``numbers``.

    One scan, in which each of at most 256 parts of the input merges the states of its tasks, so
    that no task is handed the sketches of all others. One more reads the numeric columns
    that may have ten values or fewer. Two rows reach the driver.
    """
    flat = [n for n in df.columns if is_flat(df, n)]
    numeric = [n for n in flat if is_numeric(df, n)]
    times = [n for n in flat if is_temporal(df, n)]
    texts = [n for n in flat if is_text(df, n)]
    # The aggregate of a part, and how the parts are merged.
    asked = [(F.count(F.lit(1)), _total)]
    asked += [(F.count_if(~present(df, n)), _total) for n in df.columns]
    asked += [(part_sketch(df, n), merged_estimate) for n in numeric]
    asked += [(f(wall_clock(n)).cast("date").cast("string"), f) for n in times for f in (F.min, F.max)]
    asked += [(F.max(F.length(col(n))), F.max) for n in texts]
    for n in numeric if numbers else ():
        y = number(df, n)
        asked += [(F.count(y), _total), (F.min(y), F.min), (F.max(y), F.max), (F.sum(y), F.sum)]
        asked.append((bracket_sketch(y, [MEDIAN]), lambda c: F.array(*merged_sketches(c, [MEDIAN]))))
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    parts = df.groupBy(part).agg(*[a.alias(f"c{i}") for i, (a, _) in enumerate(asked)])
    values = iter(parts.agg(*[merge(F.col(f"c{i}")) for i, (_, merge) in enumerate(asked)]).first())
    rows = next(values)
    nulls = {n: next(values) for n in df.columns}
    sketches = {n: next(values) for n in numeric}
    dates = {n: (next(values), next(values)) for n in times}
    longest = {n: next(values) or 0 for n in texts}
    facts = {n: NumberFacts(*[next(values) for _ in range(4)], *next(values)) for n in numeric} if numbers else None
    few = distinct_up_to(df, numeric, FEW_DISTINCT, sketches)
    classes = {}
    for n in flat:
        if n in times:
            classes[n] = TEMPORAL
        else:
            classes[n] = NUMERICAL if n in numeric and few[n] is None else CATEGORICAL
    return ColumnFacts(rows, nulls, classes, dates, [n for n in df.columns if n not in flat], longest, facts)


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def semantic_types(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    """``(column, semantic_type)``; nested columns are left out."""
    facts = facts or column_facts(df)
    return _table(df, list(facts.classes.items()), "`column` string, semantic_type string")


def null_percent(df: DataFrame) -> DataFrame:
    """``(column, null_pct)`` for every column, in one aggregate."""
    share = [
        F.struct(
            F.lit(n).alias("column"),
            (F.count_if(~present(df, n)) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100).alias("null_pct"),
        )
        for n in df.columns
    ]
    return df.agg(F.array(*share).alias("a")).select(F.inline("a"))


def numeric_profile(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    """``(column, min, max, median, mean)`` of the NUMERICAL columns, medians exact.

    Lazy once the facts with their ``numbers`` are known: one scan of these columns, of which
    only the values near the median are shuffled.
    """
    if facts is None or facts.numbers is None:
        facts = column_facts(df, numbers=True)
    names = facts.of_class(NUMERICAL)
    if not names:
        return _table(df, [], "`column` string, min double, max double, median double, mean double")
    known = [facts.numbers[n] for n in names]
    # The brackets are one constant, which a row finds by the number of its column.
    brackets = F.array(
        *[F.array(F.struct(F.lit(k.low).alias("lo"), F.lit(k.high).alias("hi"))) for k in known]
    )
    values = [(i, number(df, n), k) for i, (n, k) in enumerate(zip(names, known))]
    cells = [F.struct(F.lit(i).alias("_i"), F.when(y <= k.high, y).alias("_y")) for i, y, k in values]
    placed = df.select(F.inline(F.array(*cells))).where(F.col("_y").isNotNull())
    sizes = F.array(*[F.lit(k.n).cast("long") for k in known])
    placed = placed.withColumns({"_n": F.get(sizes, F.col("_i")), "_b": F.get(brackets, F.col("_i"))})
    figures = [(i, n, k.n, k.min, k.max, k.sum / k.n) for i, (n, k) in enumerate(zip(names, known))]
    table = _table(df, figures, "_i int, `column` string, n long, min double, max double, mean double")
    # One row per column of the profiled table.
    medians = quantiles_in_brackets(placed, F.broadcast(table), ["_i"], {"median": MEDIAN})
    return medians.select("column", "min", "max", "median", "mean")


def _unpivot(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(column, value)`` rows of the non-null cells."""
    cells = [F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in values.items()]
    return df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def skew_hint(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    """``(column, hint)`` of the NUMERICAL columns."""
    return numeric_profile(df, facts).select("column", _hint().alias("hint"))


def _hint() -> Column:
    skewed = (F.col("median") > 0) & (F.col("max") / (F.col("median") + SKEW_GUARD) > SKEW_RATIO)
    return F.when(skewed, wording.HIGH_SKEW).otherwise(wording.NORMAL_RANGE)


def _value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, key, n)``: rows per distinct value; long texts are counted by digest."""
    keys = {n: short_key(n) if is_text(df, n) else without_nan(df, n).cast("string") for n in names}
    cells = _unpivot(df, keys)
    return cells.groupBy("column", F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(
    df: DataFrame, facts: ColumnFacts | None = None, top: int = TOP_VALUES
) -> DataFrame:
    """``(column, value, n, rank, n_unique)``: the most frequent values of each CATEGORICAL column.

    Ties are broken by value; values of 64 and more characters by their digest, and they
    are looked up in full only for the ranks reported.
    """
    facts = facts or column_facts(df)
    names = facts.of_class(CATEGORICAL)
    if not names:
        return _table(df, [], "`column` string, value string, n long, rank int, n_unique long")
    found = _top_values(df, names, top)
    long_names = [n for n in names if facts.longest.get(n, 0) >= LONG_TEXT]
    if not long_names:
        return found.withColumnRenamed("key", "value").select(*TOP_COLUMNS)
    return _full_values(df, materialize(found), long_names)


TOP_COLUMNS = ("column", "value", "n", "rank", "n_unique")


def _top_values(df: DataFrame, names: list[str], top: int) -> DataFrame:
    counts = _value_counts(df, names)
    # The rank limit is applied inside each partition before the shuffle.
    best = W.partitionBy("column").orderBy(F.desc("n"), F.asc("key"))
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # Reading n here too keeps both branches equal up to their shuffle, which is then shared.
    sizes = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
    # At most one row per column on one side, `top` per column on the other.
    return ranked.join(F.broadcast(sizes), "column")


def _full_values(df: DataFrame, found: DataFrame, long_names: list[str]) -> DataFrame:
    """With the texts behind the digests; ``found`` has few rows per column."""
    pairs = [
        F.struct(F.lit(n).alias("column"), short_key(n).alias("key"), col(n).alias("_text"))
        for n in long_names
    ]
    cells = df.select(F.inline(F.array(*pairs))).where(F.length("_text") >= LONG_TEXT)
    winners = found.where(F.col("column").isin(long_names)).select("column", "key", "n")
    texts_of = lookup_join(cells, winners, ["column", "key"], "n").drop("n").dropDuplicates(["column", "key"])
    # Whole texts have no size bound, so that they are broadcast only if found to be small.
    full = found.join(texts_of, ["column", "key"], "left")
    return full.withColumn("value", F.coalesce("_text", "key")).select(*TOP_COLUMNS)


def distinct_counts(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    """``(column, n_unique)``: exact distinct values of each CATEGORICAL column."""
    facts = facts or column_facts(df)
    names = facts.of_class(CATEGORICAL)
    if not names:
        return _table(df, [], "`column` string, n_unique long")
    counts = _value_counts(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    labels = F.explode(F.array(*[F.lit(n) for n in names])).alias("column")
    every = df.sparkSession.range(1).select(labels)
    joined = every.join(counts, "column", "left")
    return joined.select("column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def cardinality_warning(df: DataFrame, facts: ColumnFacts | None = None) -> DataFrame:
    """``(column, n_unique)`` of the CATEGORICAL columns with more than 15 values."""
    return distinct_counts(df, facts).where(F.col("n_unique") > MANY_DISTINCT)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: class, nulls, and what that class reports.

    ``(position, column, semantic_type, null_pct, min, max, median, mean, hint, n_unique,
    top_values, high_cardinality, min_date, max_date, note)``
    """
    facts = column_facts(df, numbers=True)
    base = []
    for i, n in enumerate(df.columns):
        share = facts.nulls[n] / facts.rows * 100 if facts.rows else None
        note = f"not profiled: {df.schema[n].dataType.simpleString()}" if n in facts.skipped else None
        base.append((i, n, facts.classes.get(n), share, *facts.dates.get(n, (None, None)), note))
    columns = _table(
        df,
        base,
        "position int, `column` string, semantic_type string, null_pct double, "
        "min_date string, max_date string, note string",
    )
    numbers = numeric_profile(df, facts).withColumn("hint", _hint())
    tops = categorical_profile(df, facts)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda r: r["value"])
    # TOP_VALUES rows per column.
    tops = tops.groupBy("column").agg(F.max("n_unique").alias("n_unique"), in_order.alias("top_values"))
    # Each side has at most one row per column of the profiled table.
    wide = columns.join(F.broadcast(numbers), "column", "left").join(F.broadcast(tops), "column", "left")
    categorical = F.col("semantic_type") == CATEGORICAL
    unique = F.when(categorical, F.coalesce("n_unique", F.lit(0)))
    return wide.select(
        "position", "column", "semantic_type", "null_pct", "min", "max", "median", "mean", "hint",
        unique.alias("n_unique"), "top_values", (unique > MANY_DISTINCT).alias("high_cardinality"),
        "min_date", "max_date", "note",
    )
