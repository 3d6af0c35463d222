"""Tokens of two tokenizers of one text, aligned by their bytes, with counts of the pairs.

A byte-level BPE (A) gets a space and the text, a SentencePiece model (B) the text, before which it puts
a space itself. Tokens of A and B that share a byte are linked. How many documents hold a pair of ids
linked is counted in dense vectors, one place per distinct pair by a minimal perfect hash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dataloupe.functions.columns import col, fresh, require_columns
from dataloupe.llm.chunks import ChunkTable
from dataloupe.llm.frames import model_file, others, ship, slices, trim, unused, written
from dataloupe.llm.perfect_hash import Hash, build, segment_of

MARKER = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
CROSSING = re.compile(f"[^{MARKER}]{MARKER}")
NEXT_TO_SPACE = re.compile(r"(?<=\S) (?=\S)")
TEXT_BYTES, ID_BYTES = 1 << 20, 1 << 19  # texts and ids of A in a task at a time
MOST_CHUNKS = 400_000
MOST_PAIRS = 1 << 18  # kept in a task before they are handed on
SEGMENT = 1 << 15  # pairs per segment, about
MOST_KEYS = 1 << 22  # pairs that are hashed and broadcast at a time: 20 MB and 32 MB of counts
FAN = 32  # vectors added up at a time


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes in order for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others_ = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others_)}


class PairTable:
    """Both tokenizers, with the aligned tokens of each distinct chunk of texts.

    Neither has tokens across a single space between two other characters (checked on the files),
    so both end a token there and a text's alignment is that of its chunks in a row. With files
    that have such tokens the whole text is one chunk.
    """

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        before = spec["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("a byte-level BPE that adds no space is needed")
        self.first = Tokenizer.from_str(definition)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        self.first_bytes: list[bytes] = [b""] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            known = all(c in letters for c in token)
            self.first_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        pieces = list(map(self.second.id_to_piece, range(self.second.get_piece_size())))
        self.second_bytes = [_piece_bytes(p) for p in pieces]
        for kind in (self.first_bytes, self.second_bytes):
            if len(kind) > 1 << 16:
                raise ValueError("more than 65536 ids")
        kept = [self.second.encode(t, out_type=str) for t in ("  ", "ﬁ", "²")]
        plain = kept[0] == [MARKER * 3] and all(k[0] == MARKER for k in kept[1:])
        by_chunk = plain and not spec["normalizer"] and not any(CROSSING.search(p) for p in pieces)
        cuts = NEXT_TO_SPACE.split if by_chunk else lambda text: [text]
        alone = _stands_alone if by_chunk else lambda chunk: False
        self.table = ChunkTable(self._of_chunks, cuts, alone, MOST_CHUNKS)

    def _of_chunks(self, chunks: list[str], first: bool) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and of B as 16-bit integers; None if the tokens do not give the chunk."""
        spaced = [" " + c for c in chunks]
        found = self.first.encode_batch_fast(spaced, add_special_tokens=False)
        a = [array("H", e.ids).tobytes() for e in found]
        b = [array("H", ids).tobytes() for ids in self.second.encode(chunks, num_threads=1)]
        want = [c.encode() for c in spaced]
        pairs = list(zip(a, b))
        if self._give(want, a, self.first_bytes) and self._give(want, b, self.second_bytes):
            return pairs
        return [
            p if self._give([w], p[:1], self.first_bytes) and self._give([w], p[1:], self.second_bytes) else None
            for w, p in zip(want, pairs)
        ]

    def _give(self, want: list[bytes], ids: list[bytes] | tuple[bytes], tokens: list[bytes]) -> bool:
        """Whether the bytes of the tokens are the texts, each for its own."""
        parts = list(map(tokens.__getitem__, np.frombuffer(b"".join(ids), np.uint16).tolist()))
        ends = np.cumsum([0, *map(len, parts)])[np.cumsum([len(i) // 2 for i in ids])]
        return b"".join(parts) == b"".join(want) and bool((ends == np.cumsum(list(map(len, want)))).all())

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids of each text; none if the tokens do not give it back, as with the marker itself."""
        out = []
        for chunks in self.table.all_values([t if t and MARKER not in t else "" for t in texts]):
            if not chunks or None in chunks:
                out.append((b"", b""))
            else:
                a, b = zip(*chunks)
                out.append((b"".join(a), b"".join(b)))
        return out


def _stands_alone(chunk: str) -> bool:
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


def _piece_bytes(piece: str) -> bytes:
    if found := BYTE_PIECE.fullmatch(piece):
        return bytes([int(found[1], 16)])
    return piece.replace(MARKER, " ").encode()


@functools.lru_cache(maxsize=1)
def _table(definition: str, model: bytes) -> PairTable:
    return PairTable(definition, model)


class Links:
    """The tokens of the texts of a batch, and their links, all texts at once.

    The ends of the tokens of A and B cut a text into pieces, and each piece is what one token of A
    and one of B have in common, so pieces and links are the same in number.
    """

    def __init__(self, a: pa.Array, b: pa.Array, sizes: tuple[np.ndarray, np.ndarray]):
        (self.a, self.rows_a), (self.b, self.rows_b) = _ids(a), _ids(b)
        ends_a, ends_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        length = int(ends_a[-1]) if len(ends_a) else 0
        marks = np.zeros(length + 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        cuts = np.flatnonzero(marks)
        self.marks = marks[cuts]
        is_a, is_b = self.marks & 1, self.marks >> 1
        self.of_a = np.cumsum(is_a, dtype=np.int64) - is_a
        self.of_b = np.cumsum(is_b, dtype=np.int64) - is_b
        last = np.concatenate([[0], ends_a])[self.rows_a]
        self.ends = np.searchsorted(cuts, last, "right")  # links up to the end of each row

    def pairs(self) -> np.ndarray:
        """A's id * 2^16 + B's id of each link."""
        return self.a[self.of_a].astype(np.uint32) << np.uint32(16) | self.b[self.of_b]

    def groups(self, letters: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each row, a group ending where tokens of both end."""
        both = self.marks == 3
        group = np.cumsum(both) - both
        size = len(self.a) + len(self.b)
        codes = np.empty(size, np.int64)
        # A token of A stands behind the tokens of B of all groups before, one of B behind those of
        # A of its own group too.
        before_b = np.concatenate([[0], self.of_b[both] + 1])
        upto_a = self.of_a[both] + 1
        at_a, at_b = self.marks & 1 == 1, self.marks & 2 == 2
        here_a = np.arange(len(self.a)) + before_b[group[at_a]]
        here_b = np.arange(len(self.b)) + upto_a[group[at_b]]
        codes[here_a] = self.a + np.where(both[at_a], 1 << 16, 0)
        codes[here_b] = self.b + np.where(both[at_b], 3 << 16, 2 << 16)
        said, ends = list(map(letters.__getitem__, codes.tolist())), (self.rows_a + self.rows_b).tolist()
        return ["".join(said[x:y])[:-1] for x, y in zip([0, *ends], ends)]

    def n_groups(self) -> np.ndarray:
        return _by_row(self.marks == 3, self.ends)


def letters_of(ids: int = 1 << 16) -> list[str]:
    """What stands in ``Links.groups`` for a token of A inside and at the end of a group, and of B."""
    return [f"{i}{mark}" for mark in (",", "|", ",", ";") for i in range(ids)]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of 16-bit integers, without a copy, and the ids up to each row's end."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint16), np.zeros(len(column), np.int64)
    ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint16)
    return ids, (ends[1:] - ends[0]) // 2


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[ends], prepend=0)


@functools.lru_cache(maxsize=1)
def _sizes(definition: str, model: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = _table(definition, model)
    return tuple(np.array([len(t) for t in k], np.int64) for k in (table.first_bytes, table.second_bytes))


@dataclass
class Aligned:
    """Texts as ids, written: the columns of ``docs`` but the text, ``RESULT`` and a number ``row``."""

    rows: DataFrame
    row: str
    pairs: DataFrame  # distinct (pair)
    sizes: object  # broadcast: bytes of the ids of A and B


RESULT = "a binary, b binary, n_a long, n_b long, n_groups long, groups_sha256 string"


def align(docs: DataFrame, first: str, second: str, text: str = "text") -> Aligned:
    """Tokenize whole texts with both tokenizers and write the ids, once.

    ``first`` is the path of a byte-level BPE of ``tokenizers``, ``second`` that of a SentencePiece model,
    each of at most 2^16 ids. Special tokens' strings in texts are ordinary text. Null and empty
    texts, and those that the tokens' bytes do not give back, have no tokens. Each task hands on
    the pairs of ids that it has linked, each once per ``MOST_PAIRS`` of them, so that finding
    the distinct ones moves little.
    """
    require_columns(docs, text)
    spark = docs.sparkSession
    ship(spark)
    files = spark.sparkContext.broadcast((model_file(first).decode(), model_file(second)))
    place = docs.columns.index(text)
    results = T.StructType.fromDDL(RESULT)
    kept = [docs.columns.index(n) for n in others(docs, text, *results.names, *COUNTS)]
    known = T.StructType([*[docs.schema[i] for i in kept], *results])
    handed = fresh("pairs", *map(str.lower, known.names))
    row = fresh("row", *map(str.lower, known.names), handed)
    schema = T.StructType([*known, T.StructField(handed, T.BinaryType())])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes, letters = _table(*files.value), _sizes(*files.value), letters_of()
        seen, last = np.zeros(0, np.uint32), None
        for batch in slices(batches, text, TEXT_BYTES):
            a, b = (pa.array(x, pa.binary()) for x in zip(*table.encode(batch.column(place).to_pylist())))
            links = Links(a, b, sizes)
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in links.groups(letters)]
            counts = (np.diff(links.rows_a, prepend=0), np.diff(links.rows_b, prepend=0), links.n_groups())
            seen = np.union1d(seen, links.pairs())
            pairs = [None] * batch.num_rows
            if len(seen) > MOST_PAIRS:
                pairs[0], seen = seen.astype("<u4").tobytes(), seen[:0]
            columns = [a, b, *map(pa.array, counts), pa.array(groups), pa.array(pairs, pa.binary())]
            last = pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], schema.names)
            yield last
        if len(seen):
            yield _only_pairs(last, seen)
        table.table.clear()
        trim()

    done = docs.mapInArrow(tokenize, schema)
    table = written(done.withColumn(row, F.monotonically_increasing_id()))
    lists = table.where(col(handed).isNotNull()).select(col(handed).alias("pairs"))
    distinct = lists.mapInArrow(_pair_rows, "pair long").distinct()
    rows = table.where(F.col("a").isNotNull()).drop(handed)
    return Aligned(rows, row, distinct, spark.sparkContext.broadcast(_sizes(*files.value)))


def _only_pairs(batch: pa.RecordBatch, seen: np.ndarray) -> pa.RecordBatch:
    """A row that is no document: without ids, with the pairs of a task."""
    columns = [pa.nulls(1, f.type) for f in batch.schema]
    columns[-1] = pa.array([seen.astype("<u4").tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("pairs"):
            pairs = np.frombuffer(data.as_buffer(), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs)], ["pair"])


def hash_pairs(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``(segment, n, sizes, words, stored)``, one perfect hash per segment, and the number of segments.

    Pairs are dealt by their segment, of about ``SEGMENT`` pairs whatever their number.
    """
    pairs = written(pairs)
    segments = -(-pairs.count() // SEGMENT) or 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = segment_of(batch.column("pair").to_numpy(), segments)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("pair")], ["segment", "pair"])

    def hashed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes, words, stored = build(rows["pair"].to_numpy(np.uint32))
        parts = [x.tobytes() for x in (sizes, words, stored)]
        return pd.DataFrame([(int(key[0]), len(stored), *parts)], columns=["segment", "n", "sizes", "words", "stored"])

    dealt = pairs.mapInArrow(numbered, "segment long, pair long").groupBy("segment")
    schema = "segment long, n long, sizes binary, words binary, stored binary"
    return written(dealt.applyInPandas(hashed, schema)), segments


def _group_of(table: DataFrame, chosen: list[int], segments: int) -> Hash:
    """The hash of some segments; at most about ``MOST_KEYS`` pairs."""
    rows = table.where(F.col("segment").isin(chosen)).orderBy("segment").toArrow().to_pylist()
    kinds = (("sizes", np.int64), ("words", np.uint64), ("stored", np.uint32))
    return Hash.of(segments, [(r["segment"], *[np.frombuffer(r[n], k) for n, k in kinds]) for r in rows])


def pair_counts(aligned: Aligned, hashed: DataFrame, segments: int) -> DataFrame:
    """``(segment, counts)``: how many documents hold each pair of a segment, in order of the numbers.

    Each task counts the distinct pairs of its documents in one dense vector and hands on the parts of
    it that are not zero, one per segment. They are added up ``FAN`` at a time, level by level.
    """
    spark = aligned.rows.sparkSession
    found = []
    for chosen in _groups(hashed):
        hash_ = _group_of(hashed, chosen, segments)
        held = hashed.where(F.col("segment").isin(chosen)).orderBy("segment").select("n").toArrow()
        ends = np.cumsum(held.column("n").to_numpy())
        sent = spark.sparkContext.broadcast((hash_, chosen, ends))
        vectors = written(aligned.rows.select("a", "b").mapInArrow(_counting(sent, aligned.sizes), _VECTOR))
        tasks = vectors.agg(F.max("task")).first()[0]
        while tasks:  # the number of the last task
            level = vectors.groupBy("segment", F.expr(f"task div {FAN}").alias("task"))
            vectors, tasks = written(level.applyInPandas(_added, _VECTOR)), tasks // FAN
        found.append(vectors.select("segment", "counts"))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, found)


_VECTOR = "segment long, task long, counts binary"


def _groups(hashed: DataFrame) -> list[list[int]]:
    """Segments in groups of at most ``MOST_KEYS`` pairs; one number per segment is read."""
    out: list[list[int]] = [[]]
    size = 0
    for segment, n in hashed.select("segment", "n").orderBy("segment").toLocalIterator():
        if out[-1] and size + n > MOST_KEYS:
            out.append([])
            size = 0
        out[-1].append(segment)
        size += n
    return out


def _counting(sent, sizes):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hash_, chosen, ends = sent.value
        counts = np.zeros(len(hash_.stored), np.int64)
        for batch in slices(batches, "a", ID_BYTES):
            links = Links(batch.column("a"), batch.column("b"), sizes.value)
            of_row = np.repeat(np.arange(len(links.ends), dtype=np.uint64), np.diff(links.ends, prepend=0))
            once = np.unique(of_row << np.uint64(32) | links.pairs())
            numbers = hash_.numbers(once.astype(np.uint32))
            numbers = numbers[numbers >= 0]
            counts += np.bincount(numbers, minlength=len(counts))
        task = TaskContext.get().partitionId()
        for segment, part in zip(chosen, np.split(counts, ends[:-1])):
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), pa.array([task], pa.int64()), pa.array([part.tobytes()], pa.binary())],
                    ["segment", "task", "counts"],
                )
        trim()

    return count


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame([(int(key[0]), int(key[1]), total.tobytes())], columns=["segment", "task", "counts"])


def _highest(counts: DataFrame, hashed: DataFrame) -> np.ndarray:
    """The greatest count of each id of A, by id: at most 2^16 numbers."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for stored, n in zip(batch.column("stored"), batch.column("counts")):
                first = np.frombuffer(stored.as_buffer(), np.uint32) >> np.uint32(16)
                np.maximum.at(best, first, np.frombuffer(n.as_buffer(), np.int64))
        used = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(best[used])], ["id", "n"])

    together = counts.join(hashed.select("segment", "stored"), "segment").select("stored", "counts")
    found = together.mapInArrow(most, "id long, n long").groupBy("id").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return best


COUNTS = {"n_links": "long", "n_best": "long", "count_sum": "long"}


def with_alignment(docs: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the alignment of each text and its counts.

    Added: ``a`` and ``b`` (ids as little-endian 16-bit integers), ``n_a``, ``n_b``, ``n_groups``,
    ``groups_sha256`` (of ``a1,a2|b1;...``; '' without tokens), ``n_links``, ``n_best`` (links whose pair is in
    as many documents as any pair of its A id), ``count_sum`` (documents of the pair, over all links). See
    ``align`` for nulls and odd texts. Columns of these names are replaced. Repeated rows count as
    documents of their own; an empty table has no rows. A text is aligned as a whole, in memory.

    Three passes: texts become ids, which are written with the distinct pairs; documents are
    counted by pair; documents are aligned again from their ids and the counts looked up. Hash,
    keys and counts are broadcast for up to ``MOST_KEYS`` pairs at a time. More pairs take more passes
    of the last two kinds, so that memory does not grow with the corpus.
    """
    aligned = align(docs, first, second, text)
    hashed, segments = hash_pairs(aligned.pairs)
    links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    rows = aligned.rows.withColumn("n_links", links)
    if hashed.isEmpty():
        zero = F.lit(0).cast("long")
        return rows.withColumns({"n_best": zero, "count_sum": zero}).drop(aligned.row)
    counts = pair_counts(aligned, hashed, segments)
    best = docs.sparkSession.sparkContext.broadcast(_highest(counts, hashed))
    groups = _groups(hashed)
    sent = [_hash_with_counts(hashed, segments, counts, chosen) for chosen in groups]
    if len(sent) == 1:  # one pass, which keeps all columns
        totals = _look_up(rows, aligned, sent[0], best)
    else:
        narrow = rows.select(aligned.row, "a", "b")
        each = [_look_up(narrow, aligned, s, best).drop("a", "b") for s in sent]
        sums = [F.sum(n).alias(n) for n in (*_SUMS, _known(narrow))]
        totals = rows.join(functools.reduce(DataFrame.unionByName, each).groupBy(aligned.row).agg(*sums), aligned.row)
    return _checked(totals, _known(rows)).drop(aligned.row)


_SUMS = ("n_best", "count_sum")


def _known(rows: DataFrame) -> str:
    return unused(rows, "known")


def _hash_with_counts(hashed: DataFrame, segments: int, counts: DataFrame, chosen: list[int]):
    hash_ = _group_of(hashed, chosen, segments)
    rows = counts.where(F.col("segment").isin(chosen)).orderBy("segment").toArrow().column("counts")
    listed = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows])
    if len(listed) != len(hash_.stored):
        raise RuntimeError("pairs without a count")
    return hashed.sparkSession.sparkContext.broadcast((hash_, listed))


def _look_up(rows: DataFrame, aligned: Aligned, sent, best) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` over the links that the hash knows, and their number."""
    at = [rows.columns.index(n) for n in ("a", "b")]
    added = [T.StructField(n, T.LongType()) for n in (*_SUMS, _known(rows))]
    schema = T.StructType([*rows.schema, *added])
    sizes = aligned.sizes

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, counts = sent.value
        for batch in slices(batches, "a", ID_BYTES):
            links = Links(*map(batch.column, at), sizes.value)
            pairs = links.pairs()
            numbers = hash_.numbers(pairs)
            known = numbers >= 0
            count = np.where(known, counts[np.where(known, numbers, 0)], 0)
            top = known & (count == best.value[pairs >> np.uint32(16)])
            sums = [_by_row(x, links.ends) for x in (top, count, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], schema.names)
        trim()

    return rows.mapInArrow(look_up, schema)


def _checked(rows: DataFrame, known: str) -> DataFrame:
    """Without the number of known links, which must be all of them."""
    lost = F.raise_error(F.lit("links without a count: the input has changed between two passes"))
    return rows.withColumn("count_sum", F.when(col(known) == F.col("n_links"), F.col("count_sum")).otherwise(lost)).drop(known)
