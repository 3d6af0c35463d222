"""SimHash fingerprints and near copies by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import ship, trim, unused, written
from dataloupe.llm.graph import components

BITS = 64
SEED = 42
BLOCK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """The SimHash of a text as a signed 64-bit integer.

    A-Z are lower-cased and words are what ASCII white space separates. Shingles are runs of
    words, repeats included, joined by a space; a shorter text is one shingle of all its
    words, and no word at all gives 0. A bit is set if it is set in more than half of the
    XXH64 hashes (seed 42) of the shingles.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1))
    shingles = map(line.__getitem__, map(slice, starts.tolist(), ends[width - 1 :].tolist()))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    n = len(starts)
    hashed = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = hashed[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(
    docs: DataFrame, text: str = "text", words_per_shingle: int = 3, name: str = "fingerprint"
) -> DataFrame:
    """``docs`` with the SimHash of each whole text as a bigint ``name``, which replaces a
    column of that name; see ``fingerprint``."""
    require_columns(docs, text)
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = partial(fingerprint, words_per_shingle=words_per_shingle)
        for texts in batches:
            yield pd.Series(list(map(one, texts)), dtype="int64")
        trim()

    return docs.withColumn(name, simhash(col(text)))


def covering_masks(radius: int) -> list[int]:
    """Masks of which any ``radius`` differing bits miss at least one.

    Bit i gets the non-zero vector m(i) of radius + 1 bits, dealt round, and the mask of each
    non-zero v keeps the bits with odd <m(i), v>. The vectors of radius differing bits do not
    span the space, so some v is orthogonal to them all, and its mask keeps none of them:
    two fingerprints within the radius agree under that mask (Pagh, 2016). For radius 2
    there are 7 masks of 36 or 37 bits.
    """
    vectors = (1 << radius + 1) - 1
    kind = [1 + i % vectors for i in range(BITS)]
    odd = [[i for i in range(BITS) if (kind[i] & v).bit_count() % 2] for v in range(1, vectors + 1)]
    return [sum(1 << i for i in bits) for bits in odd]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> BITS - 1 else value


def near_fingerprints(prints: DataFrame, name: str, radius: int) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints at ``radius`` or fewer differing bits,
    enough of them to connect all that are linked.

    ``prints`` has one row per distinct value of ``name``. A table per covering mask puts
    those that agree under the mask together. Values alone in all their buckets are done. The
    pairs of a bucket are never listed: its members write down the points within half the
    radius, changing only bits that the mask drops. Two fingerprints with a point in common
    are within the radius and the other way round, and at most as many distinct
    fingerprints as a ball holds (29 for radius 2) share a point in a bucket, so that a
    bucket of any size costs its members times the ball.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    if radius == 0:
        empty = F.lit(False)
        return prints.select(col(name).alias("a"), col(name).alias("b")).where(empty)
    masks = covering_masks(radius)
    table = F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t", "mask")
    keyed = prints.select(col(name).alias("f"), table).select(
        "f", "t", F.col("f").bitwiseAND(F.col("mask")).alias("key")
    )
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(shared.select("t", "key"), ["t", "key"])
    points = members.select("f", F.explode(_ball("f", "t", masks, radius // 2)).alias("point"))
    met = points.groupBy("point").agg(F.collect_set("f").alias("near")).where(F.size("near") > 1)
    pairs = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return pairs.where("a != b").distinct()


def _ball(f: str, t: str, masks: list[int], reach: int) -> Column:
    """All values that differ from ``f`` in up to ``reach`` bits outside the mask of ``t``."""

    def flips(mask: int) -> Column:
        free = [i for i in range(BITS) if not mask >> i & 1]
        changes = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(free, n)]
        return F.array(*[F.lit(_signed(c)) for c in changes])

    chosen = reduce(
        lambda rest, k: F.when(F.col(t) == k, flips(masks[k])).otherwise(rest),
        range(1, len(masks)),
        flips(masks[0]),
    )
    return F.transform(chosen, lambda c: F.col(f).bitwiseXOR(c))


def simhash_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``(key, fingerprint bigint, component_id)`` for every row of ``docs``.

    Rows whose fingerprints differ in ``radius`` or fewer bits are linked, and a component has
    the smallest key that links reach. Texts without words, nulls included, have fingerprint
    0 and are linked like any others. Rows with a null key keep their place and get the
    component of the others; a component of null keys only has a null id. Repeated keys give
    repeated rows. An empty table gives an empty result.

    Texts are read once. After that only keys and fingerprints move: equal fingerprints are
    merged first, combined before the shuffle, so that a third of all rows in one group of
    copies is one node.
    """
    require_columns(docs, key, text)
    rows = docs.select(col(key).alias("key"), col(text).alias("text"))
    prints = written(
        with_fingerprint(rows, "text", words_per_shingle, "f").select("key", "f")
    )
    distinct = written(prints.groupBy("f").agg(F.min("key").alias("first")))
    roots = written(components(near_fingerprints(distinct, "f", radius), "a", "b"))
    linked = distinct.join(roots.withColumnRenamed("node", "f"), "f")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = linked.join(least, "component").select("f", "least")
    ids = distinct.join(moved, "f", "left").select("f", F.coalesce("least", "first").alias("c"))
    return prints.join(ids, "f").select(
        F.col("key").alias(key), F.col("f").alias("fingerprint"), F.col("c").alias("component_id")
    )


def first_of_groups(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that carry the smallest key of their component in ``groups``.

    Rows with a null key are kept if their whole component has no other key. Several rows of one
    key are all kept; ``one_of_each_group`` tells them apart.
    """
    name = unused(docs, "kept")
    kept = groups.where(col(key).eqNullSafe(F.col("component_id")))
    kept = kept.select(col(key).alias(name)).distinct()
    return docs.join(kept, col(key).eqNullSafe(col(name)), "left_semi")


def one_of_each_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest key, nulls last, and of those the
    smallest by a digest of key and text. Rows that are equal in both are copies, of which any one stays.

    Components are those of ``simhash_groups``. A row is known by its digest and not by its key, so a
    key on rows with different texts, or no key, belongs to several components. An empty
    table gives an empty one. Equal rows are put together before the shuffle, task by task.
    """
    require_columns(docs, key, text)
    mark = unused(docs, "mark")
    owner = F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(owner, F.lit(":"), F.coalesce(col(text), F.lit(""))), 256))
    rows = docs.select(col(key).alias("key"), col(text).alias("text"), digest.alias("mark"))
    rank = F.struct(F.col("key").isNull().alias("last"), "key", "mark")
    prints = with_fingerprint(rows, "text", words_per_shingle, "f")
    distinct = written(prints.groupBy("f").agg(F.min(rank).alias("first")))
    roots = components(near_fingerprints(distinct.select("f"), "f", radius), "a", "b")
    linked = distinct.join(roots.withColumnRenamed("node", "f"), "f", "left")
    component = F.coalesce("component", "f").alias("component")  # without links: its own
    kept = linked.groupBy(component).agg(F.min("first").alias("first")).select(F.col("first.mark").alias(mark))
    alone = docs.withColumn(mark, digest).dropDuplicates([mark])
    return alone.join(kept, mark, "left_semi").drop(mark)


def hexadecimal(fingerprint_column: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))
