"""Token counts of a byte-level BPE, by merging with a heap and a linked list."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.chunks import ChunkTable
from dataloupe.llm.frames import model_file, ship

SYMBOL_BITS = 20
FEW = 256  # texts counted together
NEXT_TO_SPACE = re.compile(r"(?<=\S) (?=\S)")
# The pre-tokenizer's pattern for characters below U+0250, whose classes no Unicode version
# changes; other words go through the library's own pre-tokenizer.
LATIN_END = "\u0250"
_L = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_N = r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_S = r" \t\n\x0b\x0c\r\x85\xa0"
LATIN_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


class BpeCounter:
    """Counts what a byte-level BPE of a ``tokenizers`` file makes of a text.

    The file's own pre-tokenizer cuts a chunk into words and its special tokens count as one
    each. Of a word only the number of tokens is found: its bytes less the merges done.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normalizer is needed")
        if before.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("add_prefix_space, ignore_merges and dropout are not supported")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must match exactly as written")
        vocabulary = model["vocab"]
        if len(vocabulary) >= 1 << SYMBOL_BITS:
            raise ValueError("the vocabulary is too large")
        self.symbol = vocabulary
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            joined = vocabulary[left + right]
            self.merge[vocabulary[left] << SYMBOL_BITS | vocabulary[right]] = (rank, joined)
        letters = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        self.cut = lambda text: [word for word, _ in letters(text)]
        # The symbol of a byte is what the pre-tokenizer writes for it; probed with the
        # two-byte characters, and the bytes that UTF-8 never has are not needed.
        self.of_byte = [0] * 256
        for code in range(0x250):
            char = chr(code)
            for byte, mark in zip(char.encode(), "".join(self.cut(char)), strict=True):
                self.of_byte[byte] = vocabulary[mark]
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, longest_first))) if added else None
        self.table = ChunkTable(self._of_chunks, NEXT_TO_SPACE.split, stands_alone)
        if any(" " in t["content"] for t in added):  # such a token spans chunks
            self.table.cuts, self.table.plain = (lambda text: [text]), (lambda chunk: False)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [sum(v) for v in self.table.all_values([t or "" for t in texts])]

    def _of_chunks(self, chunks: list[str], first: bool) -> list[int]:
        return [self._of_chunk(c if first else " " + c) for c in chunks]

    def _of_chunk(self, chunk: str) -> int:
        plain = self.added.split(chunk) if self.added else [chunk]
        return len(plain) - 1 + sum(self.merged(w) for p in plain if p for w in self._words(p))

    def _words(self, text: str) -> list[list[int]]:
        if max(text) < LATIN_END:
            of_byte = self.of_byte
            return [[of_byte[b] for b in w.encode()] for w in LATIN_WORDS.findall(text)]
        symbol = self.symbol
        return [[symbol[c] for c in w] for w in self.cut(text)]

    def merged(self, symbols: list[int]) -> int:
        """Tokens of one word, given as the ids of its bytes; the list is used up."""
        size = len(symbols)
        if size == 1:
            return 1
        merge = self.merge
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            if found := merge.get(symbols[i] << SYMBOL_BITS | symbols[i + 1]):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= size:
                continue
            now = merge.get(symbols[i] << SYMBOL_BITS | symbols[j])
            if now is None or now[0] != rank:  # a neighbour was merged meanwhile
                continue
            merges += 1
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if found := merge.get(joined << SYMBOL_BITS | symbols[k]):
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := merge.get(symbols[h] << SYMBOL_BITS | joined)):
                heapq.heappush(heap, (found[0], h, found[1]))
        return size - merges


def stands_alone(chunk: str) -> bool:
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


@functools.lru_cache(maxsize=2)
def _counter(definition: str) -> BpeCounter:
    return BpeCounter(definition)


def token_counts(
    docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of each text as a long column ``name``.

    ``tokenizer`` is the path of a ``tokenizers`` file with a byte-level BPE. Counts are those
    of its library without added begin or end tokens. A null or empty text has 0 tokens. One
    scan, no shuffle; the file (a few MB, checked) travels as a broadcast. Texts of any
    length are counted whole. An existing column ``name`` is replaced.
    """
    require_columns(docs, text)
    ship(docs.sparkSession)
    return docs.withColumn(name, _count_udf(docs, tokenizer)(col(text)))


def _count_udf(docs: DataFrame, tokenizer: str):
    definition = docs.sparkSession.sparkContext.broadcast(model_file(tokenizer).decode())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(definition.value)
        for texts in batches:
            listed = texts.tolist()
            parts = (counter.counts(listed[i : i + FEW]) for i in range(0, len(listed), FEW))
            yield pd.Series([n for part in parts for n in part], dtype="int64")

    return count


def over_limit(n_tokens: Column, limit: int) -> Column:
    return n_tokens > F.lit(limit)
