"""Global row positions and running totals without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.plans.storage import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def range_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted on ``order``, written once, with the part
    number ``_part`` and the 0-based row number inside the part ``_row``.

    Parts follow each other in the order. Rows that are equal in all of ``order`` are told
    apart by the input partition they come from, so that even a third of the table in one
    key is divided over many parts.
    """
    came_from = df.withColumn("_from", F.spark_partition_id())
    full_order = [*order, F.asc("_from")]
    sorted_parts = came_from.repartitionByRange(*full_order).sortWithinPartitions(*full_order)
    written = materialize(sorted_parts.withColumn("_id", F.monotonically_increasing_id()))
    return written.select(
        *df.columns,
        F.shiftright("_id", ROW_BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )


def part_offsets(parts: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """For each part, what all earlier parts add up to. One row per shuffle partition."""
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    earlier = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals]
    )


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` plus its 0-based position in the global order: the row number inside the part
    plus the rows of the earlier parts. One shuffle, the range partitioning itself."""
    parts = range_parts(df, order)
    offsets = part_offsets(parts, {"_base": F.lit(1).cast("long")})
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    numbered = parts.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_base") + F.col("_row")).drop("_part", "_row", "_base")
