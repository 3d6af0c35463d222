"""Token ids of a corpus in a compressed binary format, in the order of the keys."""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.chunks import ChunkTable
from dataloupe.llm.frames import model_file, ship, slices
from dataloupe.llm.huffman import Codebook, code_lengths
from dataloupe.llm.token_counts import NEXT_TO_SPACE, stands_alone
from dataloupe.plans.ordering import part_offsets
from dataloupe.plans.storage import scratch_path

BLOCK_IDS = 1 << 18
SLICE_BYTES = 1 << 20  # texts tokenized at a time
MOST_CHUNKS = 1_600_000
JOINED = 512  # chunks that the library is given as one text
SPACE = "\u0120"  # fixed value: how a byte-level vocabulary writes the space


def id_code(model) -> str:
    """The type code of the ids of a vocabulary, for ``array`` and numpy alike."""
    return "H" if model.get_vocab_size() <= 1 << 16 else "I"


class IdTable:
    """The ids that a ``tokenizers`` file gives a text, as the bytes of unsigned integers: of 16
    bits if the vocabulary allows (``code``), else of 32.

    With a plain byte-level BPE no token spans a space between two other characters, so that
    each distinct chunk is tokenized once; with any other file, each text. A chunk between two
    spaces holds no space but the one before it, so that chunks are given to the library joined,
    and a token that begins with a space begins a chunk.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec, self.model = json.loads(definition), Tokenizer.from_str(definition)
        self.code = id_code(self.model)
        before = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        odd = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        spaced = any(re.search(r"\s", t["content"]) for t in added)
        self.by_chunk = plain and not (spec["normalizer"] or odd or spaced)
        ids = self.model.get_vocab()
        self.begins = np.zeros(max(ids.values(), default=0) + 1, bool)
        self.begins[[i for token, i in ids.items() if token.startswith(SPACE)]] = True
        self.begins[[t["id"] for t in added]] = False
        self.table = ChunkTable(self._of_chunks, NEXT_TO_SPACE.split, stands_alone, MOST_CHUNKS)

    def _of_chunks(self, chunks: list[str], first: bool) -> list[bytes]:
        if first or not self.by_chunk:
            return self._one_by_one(chunks)
        out = []
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        joined = self.model.encode_batch_fast(["".join([" " + c for c in g]) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, joined):
            ids = np.asarray(encoding.ids, self.code)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(group):
                data, at = ids.tobytes(), starts * ids.itemsize
                ends = [*at[1:].tolist(), len(data)]
                out += [data[i:j] for i, j in zip(at.tolist(), ends)]
            else:  # chunks with spaces of their own
                out += self._one_by_one([" " + c for c in group])
        return out

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [t or "" for t in texts]
        if not self.by_chunk:
            return self._one_by_one(whole)
        return [b"".join(v) for v in self.table.all_values(whole)]


@functools.lru_cache(maxsize=2)
def _ids(definition: str) -> IdTable:
    return IdTable(definition)


@functools.lru_cache(maxsize=2)
def _codebook(ids: bytes, lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    limit: int = 20,
) -> None:
    """Tokenize whole texts and write their ids, compressed, in ascending order of ``key``.

    Each text, empty and null ones too, is followed by ``end_id``. The files under ``path``:

    * ``codebook``: ``(id, bits)``, the lengths of a canonical Huffman code of at most ``limit``
      bits for the counts of all ids. Lengths give the codes, as in ``Codebook``.
    * ``blocks``: ``(part, start, keys, sizes, checkpoints, payload)``. A block holds whole
      documents, about 2^18 ids or one longer document: their keys and numbers of ids, the
      bit offset of every 256th id, and the bits. ``start`` counts the ids before it in its
      part. Blocks are decoded independently.
    * ``parts``: ``(part, base)``, the ids before each part.

    Texts are shuffled once, by range of the key, equal and null keys too (nulls come
    first); the ids are written, counted per task, and coded from the written table. At most
    one count per id of the vocabulary reaches the driver. An empty table gives no blocks.
    """
    require_columns(docs, key, text)
    spark = docs.sparkSession
    ship(spark)
    parts = spark.read.parquet(_write_ids(docs, tokenizer, key, text, end_id))
    form = _code_of(tokenizer, end_id)
    counted = parts.select("ids").mapInArrow(_count_ids(form), "id long, n long")
    # One row per id of the vocabulary.
    found = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow().to_pydict()
    ids = np.asarray(found["id"], np.int64)
    lengths = code_lengths(np.asarray(found["n"], np.float64), limit)
    code = spark.sparkContext.broadcast((ids.tobytes(), lengths.tobytes()))
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("keys", T.ArrayType(parts.schema["key"].dataType)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("checkpoints", T.BinaryType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held, size, part = _codebook(*code.value), [], 0, None
        for batch in batches:
            columns = (batch.column(n) for n in ("part", "start", "key", "ids"))
            for p, start, k, data in zip(*columns):
                # Batches follow the files, which need not follow each other.
                if held and (p.as_py() != part or start.as_py() != held[0][0] + size):
                    yield _block(book, part, held, batch.schema.field("key").type)
                    held, size = [], 0
                part = p.as_py()
                held.append((start.as_py(), k.as_py(), np.frombuffer(data.as_buffer(), form)))
                size += len(held[-1][2])
                if size >= BLOCK_IDS:
                    yield _block(book, part, held, batch.schema.field("key").type)
                    held, size = [], 0
        if held:
            yield _block(book, part, held, batch.schema.field("key").type)

    parts.select("part", "start", "key", "ids").mapInArrow(blocks, schema).write.option(
        "compression", "uncompressed"
    ).parquet(f"{path}/blocks")
    book = spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, bits long")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    bases = part_offsets(parts.withColumnRenamed("part", "_part"), {"base": F.col("n")})
    bases.withColumnRenamed("_part", "part").coalesce(1).write.parquet(f"{path}/parts")


def _write_ids(docs: DataFrame, tokenizer: str, key: str, text: str, end_id: int) -> str:
    """Writes ``(part, start, n, key, ids)`` in order of the key and returns the path."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(model_file(tokenizer).decode())
    code = _code_of(tokenizer, end_id)
    end = array(code, [end_id]).tobytes()
    width = len(end)
    rows = docs.select(col(key).alias("key"), col(text).alias("text"))
    # Equal keys are told apart by where they come from, so that they need not share a task.
    order = [F.asc("key"), F.asc("_from")]
    ordered = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(*order)
    schema = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("n", T.LongType()),
            rows.schema["key"],
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, start = _ids(definition.value), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            data = [d + end for d in table.encode(batch.column("text").to_pylist())]
            sizes = np.asarray([len(d) // width for d in data], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(starts), pa.array(sizes), batch.column("key"), pa.array(data, pa.binary())],
                ["start", "n", "key", "ids"],
            )

    numbered = ordered.sortWithinPartitions(*order).mapInArrow(tokenize, schema)
    path = scratch_path(spark, "ids")
    numbered.select(F.spark_partition_id().alias("part"), "*").write.option(
        "compression", "lz4_raw"
    ).parquet(path)
    return path


def _code_of(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    code = id_code(Tokenizer.from_file(tokenizer))
    if not 0 <= end_id < 1 << 8 * array(code).itemsize:
        raise ValueError(f"the end id {end_id} does not fit the ids of the vocabulary")
    return code


def _count_ids(form: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                found = np.bincount(np.frombuffer(data.as_buffer(), form))
                if len(found) > len(counts):
                    counts, found = found, counts
                counts[: len(found)] += found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    return count


def _block(book: Codebook, part: int, held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    payload, checkpoints = book.encode(np.concatenate([ids for _, _, ids in held]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([held[0][0]], pa.int64()),
            pa.array([[k for _, k, _ in held]], pa.list_(kind)),
            pa.array([[len(ids) for _, _, ids in held]], pa.list_(pa.int64())),
            pa.array([checkpoints.astype("<i8").tobytes()], pa.binary()),
            pa.array([payload], pa.binary()),
        ],
        ["part", "start", "keys", "sizes", "checkpoints", "payload"],
    )


def read_tokens(
    spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True
) -> DataFrame:
    """The documents of ``write_tokens``: ``(key, start, n_tokens, ids_crc32, ids)``.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is the CRC-32 of the decoded
    ids as little-endian 32-bit integers, and ``ids`` an array of ints, left out on request.
    """
    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toArrow()  # the vocabulary
    code = spark.sparkContext.broadcast(
        tuple(book.column(n).to_numpy().astype(np.int64).tobytes() for n in ("id", "bits"))
    )
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType
    # One row per range partition of the writer.
    bases = F.broadcast(spark.read.parquet(f"{path}/parts"))
    fields = [
        T.StructField("key", kind),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
    fields = fields if with_ids else fields[:-1]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _codebook(*code.value)
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents(lengths, batch.slice(i, 1), with_ids)

    placed = blocks.join(bases, "part").withColumn("start", F.col("start") + F.col("base"))
    placed = placed.select("start", "keys", "sizes", "checkpoints", "payload")
    return placed.mapInArrow(decode, T.StructType(fields)).withColumnRenamed("key", key)


def _documents(book: Codebook, block: pa.RecordBatch, with_ids: bool) -> pa.RecordBatch:
    sizes = block.column("sizes").flatten().to_numpy()
    checkpoints = np.frombuffer(block.column("checkpoints")[0].as_buffer(), "<i8")
    payload = block.column("payload")[0].as_buffer()
    ids = book.decode(payload, checkpoints, int(sizes.sum())).astype("<u4")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sums = [crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
    columns = {
        "key": block.column("keys").flatten(),
        "start": pa.array(starts + block.column("start")[0].as_py()),
        "n_tokens": pa.array(sizes),
        "ids_crc32": pa.array(sums, pa.int64()),
    }
    if with_ids:
        offsets = pa.array(np.append(starts, ends[-1:]), pa.int32())
        columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
