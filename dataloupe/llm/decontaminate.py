"""Benchmark passages in a corpus, found by greedy string tiling."""

from __future__ import annotations

import functools
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import input_bytes, ship, trim, unused
from dataloupe.llm.words import gram_hashes, word_hashes, words

BLOCK_BYTES = 16 << 20  # benchmark texts that one scan of the corpus looks for
FILTER_BITS = 22
NAMES = ["key", "item", "item_words", "covered_words", "coverage", "tiles"]
PLACE = ("item_start", "text_start", "length")


class Items:
    """Benchmark items with the hashes of their seeds, runs of ``seed`` words.

    An item of fewer words is a single seed of all its words. Items without words have none.
    """

    def __init__(self, rows: list[tuple[object, str | None]], seed: int):
        self.keys = [key for key, _ in rows]
        self.tokens = [word_hashes(words(text)) for _, text in rows]
        by_size = defaultdict(list)
        for number, tokens in enumerate(self.tokens):
            if size := min(seed, len(tokens)):
                by_size[size].append(number)
        self.seeds = {size: self._seeds(size, numbers) for size, numbers in by_size.items()}

    def _seeds(self, size: int, numbers: list[int]) -> tuple[np.ndarray, ...]:
        grams = [gram_hashes(self.tokens[i], size) for i in numbers]
        owners = np.repeat(numbers, [len(g) for g in grams])
        hashes = np.concatenate(grams)
        pairs = np.unique(np.stack([hashes, owners.astype(np.uint64)]), axis=1)
        there = np.zeros(1 << FILTER_BITS, bool)
        there[(pairs[0] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return pairs[0], pairs[1].astype(np.int64), there

    def candidates(self, tokens: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item that shares a seed with a text, the stretches ``[from, to)`` of
        the text's words that seeds of the item cover."""
        spans = defaultdict(list)
        for size, (hashes, owners, there) in self.seeds.items():
            grams = gram_hashes(tokens, size)
            maybe = np.flatnonzero(there[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(hashes, grams[maybe], "left")
            high = np.searchsorted(hashes, grams[maybe], "right")
            for at, a, b in zip(maybe.tolist(), low.tolist(), high.tolist()):
                for item in owners[a:b].tolist():
                    known = spans[item]
                    if known and at <= known[-1][1]:
                        known[-1] = (known[-1][0], at + size)
                    else:
                        known.append((at, at + size))
        return spans


def tiles(
    item: np.ndarray, text: np.ndarray, spans: list[tuple[int, int]], least: int
) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: ``(item_start, text_start, length)``.

    Unmarked runs of the search length are hashed on both sides; equal ones are compared word
    by word and extended. The longest matches are marked first, ties by their place in the
    item and then in the text, and no word is marked twice. The search length starts at the
    longest stretch, is halved, and ends at ``least``. A match far longer than the search
    length restarts the round there, so that it cannot be cut up. ``spans`` are the
    stretches of the text in which a match can lie.
    """
    found: list[tuple[int, int, int]] = []
    free_item, free_text = np.ones(len(item), bool), np.zeros(len(text), bool)
    for a, b in spans:
        free_text[a:b] = True
    length = max(least, min(len(item), max(b - a for a, b in spans)))
    while True:
        matches = _matches(item, text, free_item, free_text, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, i, t) for i, t, n in matches]
        heapq.heapify(queue)
        while queue:
            n, i, t = heapq.heappop(queue)
            free = free_item[i : i - n] & free_text[t : t - n]
            if free.all():
                free_item[i : i - n] = free_text[t : t - n] = False
                found.append((i, t, -n))
            else:  # what longer matches have left of it
                edges = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]]))).tolist()
                for a, b in zip(edges[::2], edges[1::2]):
                    if b - a >= length:
                        heapq.heappush(queue, (a - b, i + a, t + a))
        if length == least:
            return sorted(found)
        length = max(least, length // 2)


def _matches(
    item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, length: int
) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``length`` unmarked words, each once."""
    places = defaultdict(list)
    starts, hashes = _windows(item, free_item, length)
    for at, value in zip(starts, hashes):
        places[value].append(at)
    out = []
    reached: dict[int, int] = {}  # for each diagonal, where its last match ends in the text
    starts, hashes = _windows(text, free_text, length)
    for t, value in zip(starts, hashes):
        for i in places.get(value, ()):
            if reached.get(t - i, -1) > t or (item[i : i + length] != text[t : t + length]).any():
                continue
            n, most = length, min(len(item) - i, len(text) - t)
            while n < most and free_item[i + n] and free_text[t + n] and item[i + n] == text[t + n]:
                n += 1
            reached[t - i] = t + n
            out.append((i, t, n))
    return out


def _windows(tokens: np.ndarray, free: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Where ``length`` unmarked words in a row begin, and their hashes."""
    if len(tokens) < length:
        return [], []
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:-length])
    if not len(starts):
        return [], []
    return starts.tolist(), _rolling(tokens, length)[starts].tolist()


def _rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows, modulo 2^64, from the hashes of all prefixes."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.full(len(tokens), base, np.uint64))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * powers, dtype=np.uint64)])
    back = np.cumprod(np.full(len(tokens), inverse, np.uint64))
    return (prefix[length:] - prefix[:-length]) * back[: len(tokens) - length + 1]


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seed_words: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """Documents that hold a benchmark item, in one piece or in several, in any order.

    Result: ``(key, item_key, item_words, covered_words, coverage, tiles)`` for each row of
    ``docs`` and item of which at least ``threshold`` of the words are covered by tiles:
    matches of ``seed_words`` or more words (all words of shorter items) that overlap
    neither in the item nor in the text. ``tiles`` has their places ``(item_start, text_start,
    length)`` in words. Words are compared without case and ASCII punctuation,
    by 32-bit hashes of which five or more must agree in a row.

    The words of the corpus stay where they are: the seeds of the benchmark are broadcast and
    joined to those of each text in its own task, and only rows that match are returned. A
    broadcast holds ``BLOCK_BYTES`` of items; a larger benchmark is dealt into blocks by its
    key, one scan each, so none is left out. Null and empty texts and items match nothing, null
    keys are carried, repeated rows give repeated results, empty tables give an empty one.
    """
    require_columns(docs, key, text)
    require_columns(benchmark, item_key, item_text)
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(col(key).alias("key"), col(text).alias("text"))
    items = benchmark.select(col(item_key).alias("item"), col(item_text).alias("text"))
    blocks = 1 + input_bytes(items, "text") // BLOCK_BYTES
    place = T.StructType([T.StructField(n, T.IntegerType()) for n in PLACE])
    schema = T.StructType(
        [
            rows.schema["key"],
            items.schema["item"],
            T.StructField("item_words", T.LongType()),
            T.StructField("covered_words", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("tiles", T.ArrayType(place)),
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    found = []
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        here = here.where(F.col("text").isNotNull()).orderBy("item", "text")
        # About BLOCK_BYTES of text.
        sent = spark.sparkContext.broadcast([tuple(r) for r in here.collect()])
        found.append(rows.mapInArrow(_search(sent, seed_words, threshold, kinds), schema))
    every = functools.reduce(DataFrame.union, found)
    return every.withColumnsRenamed({"key": key, "item": item_key})


def _search(sent, seed: int, threshold: float, kinds: list[pa.DataType]):
    """The task that looks for the broadcast items in every text."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, seed)
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key"), batch.column("text")):
                tokens = word_hashes(words(text.as_py()))
                for item, spans in items.candidates(tokens).items():
                    mine = items.tokens[item]
                    if sum(b - a for a, b in spans) < threshold * len(mine):
                        continue  # more cannot be covered
                    marked = tiles(mine, tokens, spans, min(seed, len(mine)))
                    covered = sum(n for *_, n in marked)
                    if covered >= threshold * len(mine):
                        places = [dict(zip(PLACE, t)) for t in marked]
                        share = covered / len(mine)
                        out.append((key.as_py(), items.keys[item], len(mine), covered, share, places))
            columns = zip(*out) if out else [()] * len(kinds)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)
        trim()

    return search


def without_benchmark(docs: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is in none of ``matches``; null keys match each other."""
    hit = unused(docs, "hit")
    hits = matches.select(col(key).alias(hit)).distinct()
    return docs.join(hits, col(key).eqNullSafe(col(hit)), "left_anti")
