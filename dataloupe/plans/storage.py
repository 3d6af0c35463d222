"""Written intermediate tables, and the estimates Catalyst has of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Paths written per application, to be removed by ``release``.
_written: dict[str, list[str]] = {}


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, without running it; None if not available."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except AttributeError:  # remote session: no plan on this side
        return None


def rows_up_to(df: DataFrame, n: int) -> int:
    """The number of rows, but at most ``n``; reads partitions only until n are found."""
    return len(df.select(F.lit(1)).take(n))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, ``spark.checkpoint.dir``. Only in local mode, where
    all tasks share a disk, a temporary folder is set if there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dataloupe-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, kind: str = "table") -> str:
    path = f"{shared_folder(spark)}/dataloupe-{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages start from the files, so a lost executor never repeats the work
    behind them, and row counts and sizes of the result are facts, not guesses.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written; returns their number.

    Frames that were built from them cannot be read afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
