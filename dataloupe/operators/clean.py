"""Cleaning: nulls, duplicates, dropping, renaming and time parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import (
    col, fresh, is_temporal, is_text, present, require_columns, type_of,
)
from dataloupe.plans.cardinality import short_key
from dataloupe.plans.repeats import split_by_repeats
from dataloupe.plans.storage import materialize
from dataloupe.sources.names import sanitize_columns
from dataloupe.sources.tables import require_min_rows
from dataloupe.specs import ProcessingPlan


def null_cell_count(df: DataFrame) -> DataFrame:
    """One row ``(null_cells)``: empty cells over all columns, NaN counted as empty."""
    empty = (F.count_if(~present(df, n)) for n in df.columns)
    return df.agg(sum(empty, F.lit(0).cast("long")).alias("null_cells"))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row ``(duplicate_rows)``: rows that repeat another one in every column.

    Only rows whose digest occurs again are compared cell by cell. Copies are combined
    before the shuffle, and long texts travel as digests.
    """
    _, again = split_by_repeats(df)
    keys = [short_key(n) if _exact_text(again, n) else F.col(n) for n in again.columns]
    copies = again.select([k.alias(n) for k, n in zip(keys, again.columns)])
    counted = copies.groupBy(*copies.columns).agg((F.count(F.lit(1)) - 1).alias("repeats"))
    return counted.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_rows"))


def _exact_text(df: DataFrame, name: str) -> bool:
    return is_text(df, name) and "collate" not in type_of(df, name).simpleString()


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of equal rows. Rows that equal no other one are not shuffled."""
    if not df.columns:
        return df.dropDuplicates()
    single, again = split_by_repeats(df)
    return single.union(again.dropDuplicates()).toDF(*df.columns)


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the listed columns; names the frame lacks are ignored."""
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename all at once, so names may be swapped. Names the frame lacks are ignored,
    colliding results are rejected."""
    names = [mapping.get(n, n) for n in df.columns]
    plain = [n.lower() for n in names]  # Spark looks columns up without case
    repeated = sorted({n for n in names if plain.count(n.lower()) > 1})
    if repeated:
        raise ValueError(f"renaming gives several columns the names {repeated}")
    return df.toDF(*names)


# Public date layouts, tried per column where no format is given. Month first comes before day
# first, as the usual reader of the surveyed files has it.
COMMON_FORMATS = (
    "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "d MMMM yyyy", "MMMM d, yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMM-yyyy", "M/d/yy", "d/M/yy",
    "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm:ss", "M/d/yyyy h:mm a",
    "d.M.yyyy H:mm", "d MMMM yyyy H:mm", "yyyy/M/d H:mm:ss",
)


def coerce_timestamp(
    df: DataFrame, columns: list[str], formats: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Parse columns to wall-clock timestamps; what does not parse becomes NULL.

    ISO texts parse without a format; further ``formats`` are tried in order. Without
    ``formats``, each text column is given the layout of ``COMMON_FORMATS`` that parses most of
    its cells that are not ISO, the earlier one in a tie (so 03/04/2021 is the 4th of March
    unless other cells speak against it); one aggregate decides for all columns. Columns
    that already hold dates or timestamps are only converted.
    """
    require_columns(df, *columns)
    texts = [n for n in columns if not is_temporal(df, n)]
    chosen = {n: tuple(formats) for n in columns} if formats else _likely_formats(df, texts)

    def parsed(name: str) -> Column:
        if is_temporal(df, name):
            return col(name).cast("timestamp_ntz")
        text = F.trim(col(name).cast("string"))
        tries = [_tried(text, f) for f in chosen[name]]
        return F.coalesce(text.try_cast("timestamp_ntz"), *tries)

    return df.withColumns({n: parsed(n) for n in columns}) if columns else df


def _tried(text: Column, layout: str) -> Column:
    return F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")


def _likely_formats(df: DataFrame, names: list[str]) -> dict[str, tuple[str, ...]]:
    if not names:
        return {}
    counts = []
    for i, n in enumerate(names):
        text = F.trim(col(n).cast("string"))
        rest = F.when(text.try_cast("timestamp_ntz").isNull(), text)
        counts += [F.count(_tried(rest, f)).alias(f"c{i}_{j}") for j, f in enumerate(COMMON_FORMATS)]
    row = df.agg(*counts).first()
    found = {}
    for i, n in enumerate(names):
        mine = row[i * len(COMMON_FORMATS) : (i + 1) * len(COMMON_FORMATS)]
        best = max(range(len(mine)), key=lambda j: (mine[j], -j))
        found[n] = (COMMON_FORMATS[best],) if mine[best] else ()
    return found


def apply_processing_plan(df: DataFrame, plan: ProcessingPlan) -> DataFrame:
    """Parse times, drop, rename: in this order, all by original names."""
    timed = coerce_timestamp(df, list(plan.temporal_columns), plan.time_formats)
    return rename_columns(drop_columns(timed, list(plan.drop_columns)), plan.column_mapping)


@dataclass(frozen=True)
class CleanReport:
    null_cells: int
    duplicate_rows: int
    rows_before: int
    rows_after: int


def clean(df: DataFrame, min_rows: int = 5) -> tuple[DataFrame, CleanReport]:
    """Count nulls and repeats, drop both, check the size and tidy the column names.

    Rows that equal no other one are not shuffled; of the others, one shuffle groups equal rows and
    counts the copies. The result is written once, and everything else, the report
    too, is read from there: nulls and repeats of the raw table are sums weighted by the copies.
    """
    copies = fresh("copies", *df.columns)
    single, again = split_by_repeats(df)
    counted = again.groupBy(*again.columns).agg(F.count(F.lit(1)).alias("n"))
    grouped = single.withColumn("n", F.lit(1).cast("long")).union(counted)
    written = materialize(grouped.toDF(*df.columns, copies))
    empty = sum((F.when(present(df, n), 0).otherwise(1) for n in df.columns), F.lit(0))
    figures = written.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0).cast("long"))
            for c in (empty * col(copies), col(copies) - 1, col(copies), (empty == 0).cast("long"))
        ]
    ).first()
    cleaned = sanitize_columns(drop_null_rows(written.drop(copies)))
    report = CleanReport(*figures)
    if report.rows_after < min_rows:
        require_min_rows(cleaned, min_rows)
    return cleaned, report
