"""Column names that are unique and free of blanks and dots."""

from __future__ import annotations

from pyspark.sql import DataFrame


def clean_names(names: list[str]) -> list[str]:
    """Strip, turn blanks and dots into underscores, number repeats from _1 in order.

    Spark looks columns up without case, so names that differ by case only are repeats too.
    """
    taken: dict[str, str] = {}
    for raw in names:
        base = raw.strip().translate(str.maketrans(" .", "__"))
        numbered = (base if not i else f"{base}_{i}" for i in range(len(names) + 1))
        name = next(n for n in numbered if n.lower() not in taken)
        taken[name.lower()] = name
    return list(taken.values())


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))
