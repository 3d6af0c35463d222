"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloupe.llm.frames import forget, written

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)``: for each node of an edge its smallest reachable node.

    Alternates large-star and small-star steps (Kiveris and others, 2014) until every node
    points to its root, in a number of rounds that is logarithmic in practice. Each round is
    written to the shared folder, so no lineage grows and lost executors repeat one round at
    most. Per node only a minimum is aggregated, which is combined before the shuffle; joins
    that meet a node with very many neighbours are split by adaptive execution. Loops,
    repeated edges, either direction and null ends (ignored) are allowed; no edges give an
    empty result.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = written(pairs.select(high.alias("u"), low.alias("v")).distinct())
    seen = _state(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        later = written(_small_star(_large_star(now)))
        forget(now)
        now, before, seen = later, seen, _state(later)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple:
    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashes).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m"))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
