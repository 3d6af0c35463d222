"""SentencePiece ids of every text, with one segmentation per distinct word, and back."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from dataloupe.functions.columns import require_columns
from dataloupe.llm.chunks import ChunkTable
from dataloupe.llm.frames import model_file, others, ship, slices, trim

MARKER = "▁"
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256  # texts or id lists in a task at a time
MOST_WORDS = 200_000
SINGLE_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")
CROSSING = re.compile(f"[^{MARKER}]{MARKER}")


class PieceTable:
    """A SentencePiece model with a table of its distinct words.

    A word is a run of white space markers with what follows up to the next marker. If no
    piece holds a marker after another character, no piece can cross from one word into the
    next, so that words are segmented alone and their ids joined in order. Models with
    crossing pieces, with a normalizer, or without the marker before a text are given the
    whole text instead.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        plain = all(self.model.encode(t, out_type=str)[:1] == [e] for t, e in _PROBES)
        self.by_word = plain and not any(CROSSING.search(p) for p in pieces)
        self.table = ChunkTable(self._of_words, SINGLE_SPACE.split, bool, MOST_WORDS)

    def _of_words(self, words: list[str], first: bool) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.model.encode(words, num_threads=1)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as 32-bit integers."""
        if not self.by_word:
            return [np.asarray(self.model.encode(t or ""), np.int32) for t in texts]
        spaced = [t.replace(MARKER, " ") if t and MARKER in t else t or "" for t in texts]
        found = self.table.all_values(spaced)
        return [np.frombuffer(b"".join(v), np.int32) for v in found]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


# What a model with a marker before each text and no normalizer makes of these texts: it
# keeps double spaces and compatibility characters.
_PROBES = (("  ", MARKER * 3), ("ﬁ", MARKER), ("²", MARKER))


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> PieceTable:
    return PieceTable(model)


def encode_pieces(
    docs: DataFrame,
    model: str,
    text: str = "text",
    ids: str = "piece_ids",
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the piece ids of each text as an array of ints ``ids``.

    ``model`` is the path of a SentencePiece model. The ids are those of its library without
    begin and end ids and without sampling. With ``decoded``, the text that the library makes
    of the ids is a further column. A null or empty text has the empty array and ''. Columns
    of these names are replaced. One scan without a shuffle: the table of distinct words is kept per task and bounded, as
    joining 10^13 words with a distributed table would move the corpus several times.
    """
    require_columns(docs, text)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))
    place = docs.columns.index(text)

    def encode(table: PieceTable, batch: pa.RecordBatch) -> list[pa.Array]:
        found = table.encode(batch.column(place).to_pylist())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *found])
        columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        if decoded:
            columns.append(pa.array([table.decode(x.tolist()) for x in found], pa.string()))
        return columns

    return _in_slices(docs, model, place, encode, added)


def decode_pieces(
    docs: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded"
) -> DataFrame:
    """``docs`` with the text of the array ``ids`` as ``text``; null or no ids give ''."""
    require_columns(docs, ids)
    place = docs.columns.index(ids)

    def decode(table: PieceTable, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [table.decode(x or []) for x in batch.column(place).to_pylist()]
        return [pa.array(texts, pa.string())]

    return _in_slices(docs, model, place, decode, [T.StructField(text, T.StringType())])


def _in_slices(docs: DataFrame, model: str, place: int, work, added: list) -> DataFrame:
    """``docs`` with columns that ``work`` makes of small pieces of the Arrow batches."""
    ship(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(model_file(model))
    kept = [docs.columns.index(n) for n in others(docs, *[f.name for f in added])]
    schema = T.StructType([*[docs.schema[i] for i in kept], *added])
    is_text = isinstance(docs.schema[place].dataType, T.StringType)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(file.value)
        column = docs_names[place]
        few = slices(batches, column, SLICE_BYTES) if is_text else _rows(batches)
        for batch in few:
            columns = [*map(batch.column, kept), *work(table, batch)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])
        table.table.clear()  # the worker stays, for tasks of other stages
        trim()

    docs_names = docs.columns
    return docs.mapInArrow(pieces, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
