"""How many distinct values: exact where it is small, 'more than the limit' elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, without_nan


def sketch(df: DataFrame, name: str) -> Column:
    return F.approx_count_distinct(without_nan(df, name))


def part_sketch(df: DataFrame, name: str) -> Column:
    """A distinct sketch of one part of the input, to be merged by :func:`merged_estimate`.

    Few values are kept as a plain list of hashes, so the estimate for up to 40 of them is never
    above their number by one or more, which is what ``distinct_up_to`` needs.
    """
    value = without_nan(df, name)
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), F.lit(9))


def merged_estimate(sketches: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketches)), F.lit(0))


def sketch_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Estimated distinct counts of several columns, in one scan."""
    if not names:
        return {}
    row = df.agg(*[sketch(df, n).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return dict(zip(names, row))


def distinct_up_to(
    df: DataFrame, names: list[str], limit: int, sketches: dict[str, int] | None = None
) -> dict[str, int | None]:
    """Exact distinct count (nulls left out) of each column, or None if it exceeds ``limit``.

    A HyperLogLog register is only set by a value that hashes to it, so d values set at
    most d of its 512 registers and the estimate at that size, ``512 ln(512 / (512 - d))``,
    stays below 1.3 d for d <= 200. An estimate above twice the limit therefore proves
    the column larger; only the others need an exact count, over few values.
    """
    if not 0 < limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if not names:
        return {}
    sketches = sketch_counts(df, names) if sketches is None else sketches
    unsure = [n for n in names if sketches[n] <= 2 * limit]
    found: dict[str, int | None] = {n: None for n in names}
    if unsure:
        row = df.agg(
            *[F.count_distinct(without_nan(df, n)).alias(f"c{i}") for i, n in enumerate(unsure)]
        ).first()
        found.update({n: c if c <= limit else None for n, c in zip(unsure, row)})
    return found


def short_key(name: str) -> Column:
    """A column that is equal exactly when ``name`` is, and never longer than 64 characters.

    Texts shorter than 64 characters stand for themselves, longer ones for their 64-digit
    SHA-256, so counting long texts does not shuffle them.
    """
    c = col(name)
    return F.when(F.length(c) < 64, c).otherwise(F.sha2(c, 256))
