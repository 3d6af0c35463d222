"""Helpers for frames that the operators of this package share."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dataloupe.functions.columns import col, fresh
from dataloupe.plans.storage import delete_path, materialize

MOST_MODEL_BYTES = 64 << 20
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


# Rows of text are large. Where the session has Spark's default sizes for the batches that go to
# Python, smaller ones keep the workers' memory low whatever the length of the texts.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
}


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, and set ``BATCHES``."""
    for name, (default, smaller) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, smaller)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        base = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(PACKAGE))
        root, name = os.path.split(PACKAGE)
        sc.addPyFile(shutil.make_archive(base, "zip", root, name))
        _shipped.add(sc.applicationId)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that ``names`` do not replace; Spark compares without case."""
    replaced = {n.lower() for n in names}
    return [n for n in df.columns if n.lower() not in replaced]


def unused(df: DataFrame, name: str) -> str:
    """A helper's name that no column of ``df`` has in any case."""
    return fresh(name, *map(str.lower, df.columns))


def trim() -> None:
    """Give memory that a task has freed back to the machine.

    Spark keeps Python workers for later tasks, several per core after a chain of operators, and
    what each of them holds on to adds up.
    """
    pa.default_memory_pool().release_unused()
    if trimming := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries
        trimming(0)


def model_file(path: str) -> bytes:
    """A model file, read on the driver to be broadcast, and checked to be small."""
    if (size := os.path.getsize(path)) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than {MOST_MODEL_BYTES}")
    with open(path, "rb") as file:
        return file.read()


def whole_text(name: str) -> Column:
    """A text column with empty texts for nulls."""
    return F.coalesce(col(name), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the executors share, and read again."""
    return materialize(df)


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` returned and that nothing needs any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            delete_path(df.sparkSession, file.rsplit("/", 1)[0])


def input_bytes(df: DataFrame, *texts: str) -> int:
    """UTF-8 bytes of the text columns over all rows: one scan."""
    sizes = [F.coalesce(F.sum(F.octet_length(col(t))), F.lit(0)) for t in texts]
    return int(df.agg(sum(sizes, F.lit(0)).alias("n")).first()[0])


def slices(
    batches: Iterator[pa.RecordBatch], column: str, most_bytes: int
) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts have up to ``most_bytes``, or one longer text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends, first = np.cumsum(sizes.astype(np.int64)), 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(first, last - first)
            first = last
