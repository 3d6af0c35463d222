"""Schema-only type tests and safe column access.

Every operator takes column names as text. They are checked here against the
frame's schema, and always back-quoted, because real headers hold blanks,
colons and plus signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def require_columns(df: DataFrame, *names: str | None) -> None:
    """Raise ``ValueError`` for names that are not columns of ``df`` (None is skipped)."""
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the frame has {df.columns}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, name)
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str | None) -> bool:
    """Numbers; booleans are categorical everywhere."""
    return name is not None and isinstance(type_of(df, name), T.NumericType)


def is_temporal(df: DataFrame, name: str | None) -> bool:
    return name is not None and isinstance(type_of(df, name), TEMPORAL)


def is_text(df: DataFrame, name: str | None) -> bool:
    return name is not None and isinstance(
        type_of(df, name), (T.StringType, T.CharType, T.VarcharType)
    )


def is_flat(df: DataFrame, name: str) -> bool:
    """False for arrays, maps, structs, variants and raw bytes."""
    return not isinstance(type_of(df, name), NESTED)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value: neither NULL nor NaN."""
    c = col(name)
    return c.isNotNull() & ~F.isnan(c) if is_floating(df, name) else c.isNotNull()


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(df, name) else c


def number(df: DataFrame, name: str) -> Column:
    """The column as double, NaN as NULL; raises for non-numeric columns."""
    if not is_numeric(df, name):
        raise ValueError(f"column {name!r} is {type_of(df, name).simpleString()}, not numeric")
    return without_nan(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, keeping the column order."""
    floats = [n for n in df.columns if is_floating(df, n)]
    return df.withColumns({n: without_nan(df, n) for n in floats}) if floats else df


def wall_clock(name: str) -> Column:
    """A date or timestamp as zone-free wall-clock time."""
    return col(name).cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of ``later - earlier`` in days, for wall-clock columns.

    The calendar-day distance is one too large whenever the later value's time of
    day comes first, so it is corrected; no session time zone is involved.
    """

    def time_of_day(c: Column) -> Column:
        return c - c.cast("date").cast("timestamp_ntz")

    early_clock = time_of_day(later) < time_of_day(earlier)
    return (F.datediff(later, earlier) - F.when(early_clock, 1).otherwise(0)).cast("long")


def fresh(name: str, *taken: str | None) -> str:
    """``name``, underscored until it clashes with none of ``taken``; Spark looks names up
    without case. Helpers are named by it, and figures of a result beside the key columns."""
    used = {t.lower() for t in taken if t is not None}
    while name.lower() in used:
        name = "_" + name
    return name
