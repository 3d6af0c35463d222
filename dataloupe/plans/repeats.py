"""Rows that equal another row, found by digests, so that only rows that may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Repeated digests are marked in a field of this many bits, at most 2^(MARK_BITS - 6) rows of 16 bytes.
MARK_BITS = 26


def row_digest(df: DataFrame) -> Column:
    """64 bits that are equal for all rows that a grouping by every column puts together.

    The reverse need not hold: different rows of one digest are told apart by their cells later.
    Types that have no hash, or are compared by other rules than by value, are left out.
    """
    plain = [f.name for f in df.schema if not _unhashed(f.dataType.simpleString())]
    return F.xxhash64(F.lit(0), *[c for n in plain for c in (F.col(n), F.col(n).isNull())])


def _unhashed(kind: str) -> bool:
    return any(word in kind for word in ("map<", "variant", "collate", "interval"))


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ..., so that no helper can clash with one."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def split_by_repeats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that equal no other one, and the rest, columns as in :func:`by_position`.

    Lazy. The first of three scans shuffles one digest and one count per distinct row. Digests
    that occur again set one bit each in a field of ``2^MARK_BITS``, whose filled words are
    broadcast: 16 MB of them at most, whatever the table. A row without a set bit is single. The rest holds
    all repeated rows, and single ones that share a bit with a repeated one: few while
    there are fewer repeated rows than bits, all of them in a table with far more.
    """
    rows = by_position(df)
    digests = rows.select(row_digest(rows).alias("d"))
    again = digests.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    word, bit = _place(F.col("d"))
    marks = again.groupBy(word.alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
    )
    placed = rows.withColumn("d", row_digest(rows))
    word, bit = _place(F.col("d"))
    tested = placed.withColumn("w", word).join(F.broadcast(marks), "w", "left")
    marked = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    return tested.where(~marked).select(rows.columns), tested.where(marked).select(rows.columns)


def _place(digest: Column) -> tuple[Column, Column]:
    """The word of the field and the bit in it that stand for a digest."""
    place = digest.bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    return F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
