"""Joining a large frame to a per-group table without trusting the group sizes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dataloupe.functions.columns import col, quoted
from dataloupe.plans.storage import estimated_bytes, materialize

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20  # of the written files


def lookup_join(
    big: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join ``big`` to ``table``, which has one row per key of ``on``.

    ``weight`` is the column of ``table`` that tells how many rows of ``big`` have the key.

    * A table whose plan is already estimated below Spark's own broadcast limit is
      joined plainly: Catalyst broadcasts it.
    * Otherwise the table is written once, and rows and file size are known. Within
      ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` it is broadcast.
    * Beyond that both sides are shuffled, and heavy keys are split, see ``salted_join``.
    """
    limit = _broadcast_limit(big)
    size = estimated_bytes(table)
    if size is not None and size <= limit:
        return big.join(table, on, how)
    return written_join(big, materialize(table), on, weight, how)


def written_join(
    big: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """The same for a table that is read from files, whose size is a fact."""
    size = estimated_bytes(table)
    if size is not None and size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(table), on, how)
    return salted_join(big, table, on, weight, how)


def salted_join(
    big: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Shuffle join in which a key with k shuffle partitions' worth of rows goes to k of them.

    Fewer keys than there are shuffle partitions can each hold more than one partition's
    share, so the list of heavy keys is short whatever the table, and is broadcast. Rows
    without a key match nothing and are spread evenly; a heavy key that the table lacks is
    left to the skew join of adaptive execution.
    """
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(col(weight))).first()[0] or 1
    splits = F.ceil(col(weight) / F.lit(total) * F.lit(partitions)).cast("long")
    heavy = table.where(splits > 1).select(*map(quoted, on), splits.alias("_splits"))
    one = F.lit(1).cast("long")
    no_key = reduce(lambda a, b: a | b, [col(k).isNull() for k in on])
    splits_here = F.when(no_key, F.lit(partitions)).otherwise(F.coalesce("_splits", one))
    spread = big.join(F.broadcast(heavy), on, "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), splits_here)
    )
    copies = table.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(splits, one) - 1))
    )
    return spread.drop("_splits").join(copies, [*on, "_salt"], how).drop("_salt")


def _broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", text.strip().lower())
    if found is None:
        return 0
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ")
