"""Reading, previewing, sampling and writing tables."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dataloupe.functions.columns import col, fresh, nan_to_null
from dataloupe.plans.storage import rows_up_to
from dataloupe.sources.names import clean_names

# Cell texts that mean "missing".
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WHOLE = r"^\s*[+-]?\d+\s*$"
REAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a CSV with a header line, or parquet; NaN becomes NULL.

    CSV cells are read as text, the usual missing markers become NULL, and each
    column gets the narrowest of bigint, double, boolean and string that fits all
    its cells, decided in one pass over the file. Give ``schema`` to skip that pass.
    Headers go through :func:`clean_names`. ``multiline`` allows line breaks inside
    quotes, at the price of one task per file.

    What would lose cells is refused: a row with more cells than the header, files of a
    folder with different headers, and cells that do not fit a given ``schema``.
    """
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return nan_to_null(reader.parquet(path))
    if fmt != "csv":
        raise ValueError("fmt must be 'csv' or 'parquet'")
    if schema is None:
        names = clean_names(_header(spark, path))
        types = None
    else:
        schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        names, types = schema.names, {f.name: f.dataType for f in schema.fields}
    extra = fresh("_more", *names)
    raw = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in (*names, extra)]))
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )
    cells = raw.select([_cell(n).alias(n) for n in names] + [col(extra)])
    types = _fitting_types(cells, extra) if types is None else _fitting(cells, types, extra)
    typed = cells.select([col(n).try_cast(types[n]).alias(n) for n in names])
    return nan_to_null(typed)


def _fitting(
    cells: DataFrame, types: dict[str, T.DataType], extra: str
) -> dict[str, T.DataType]:
    """The given types, if every cell fits them, in one aggregate."""
    lost = [
        F.count_if(col(n).isNotNull() & col(n).try_cast(t).isNull()).alias(n) for n, t in types.items()
    ]
    counts = cells.agg(F.count(col(extra)).alias(extra), *lost).first().asDict()
    _refuse_more(counts.pop(extra), types)
    if wrong := {n: c for n, c in counts.items() if c}:
        raise ValueError(f"cells that do not fit the schema: {wrong}")
    return types


def _refuse_more(rows: int, names) -> None:
    if rows:
        raise ValueError(f"{rows} rows have more than {len(names)} cells")


# Files whose first lines are asked for in one job.
FILES_A_JOB = 32


def _header(spark: SparkSession, path: str) -> list[str]:
    """The first line of the file, which all files of a folder must share.

    Each file is a read of its own that ends after one line, and the files of the path are
    gone through in blocks up to the first that differs, so the cost follows their number, not their size.
    """
    # A file is not split, so that its first line is the first of its only task.
    whole = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.minPartitionNum": "1"}
    session = _with_settings(spark, whole, without=("spark.sql.files.maxPartitionNum",))
    lines = session.read.text(path)
    place = F.col("_metadata.file_path")
    # The list of files is on the driver for every scan; without their content none is opened.
    listed = session.read.format("binaryFile").load(path).where("length > 0").select(place.alias("file"))
    files = sorted(r["file"] for r in listed.collect())
    headers: set[str] = set()
    for start in range(0, len(files), FILES_A_JOB):
        # A filter on the path leaves only that file to be opened.
        firsts = [
            lines.where(place == f).select("value").limit(1)
            for f in files[start : start + FILES_A_JOB]
        ]
        headers.update(r[0] for r in reduce(DataFrame.union, firsts).distinct().limit(2).collect())
        if len(headers) > 1:
            raise ValueError(f"the files of {path} have different headers: {sorted(headers)[:2]}")
    if not headers:
        raise ValueError(f"{path} is empty")
    return next(csv.reader([headers.pop().lstrip("\ufeff").rstrip("\r")]))


def _with_settings(
    spark: SparkSession, settings: dict[str, str], without: tuple[str, ...] = ()
) -> SparkSession:
    """Another session of the application, set like ``spark`` but for ``settings``."""
    session = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if key not in without and session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def _cell(name: str) -> Column:
    return F.when(~col(name).isin(*MISSING), col(name))


def _fitting_types(cells: DataFrame, extra: str) -> dict[str, T.DataType]:
    """The narrowest type every non-missing cell of a column fits, in one aggregate."""
    names = [n for n in cells.columns if n != extra]

    def every(test: Column) -> Column:
        return F.coalesce(F.every(test), F.lit(True))

    checks = []
    for n in names:
        c = col(n)
        whole = c.rlike(WHOLE) & c.try_cast("bigint").isNotNull()
        checks += [every(F.when(c.isNotNull(), t)) for t in (whole, c.rlike(REAL), c.rlike(TRUTH))]
        checks.append(F.count(c) == 0)
    checks.append(F.count(col(extra)))
    row = cells.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).first()
    _refuse_more(row[-1], names)
    types = {}
    for i, n in enumerate(names):
        is_whole, is_real, is_truth, is_empty = row[4 * i : 4 * i + 4]
        if is_empty:
            types[n] = T.DoubleType()
        elif is_whole:
            types[n] = T.LongType()
        elif is_real:
            types[n] = T.DoubleType()
        else:
            types[n] = T.BooleanType() if is_truth else T.StringType()
    return types


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def require_min_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """Return ``df``, or raise if it is empty or has fewer than ``n`` rows."""
    found = rows_up_to(df, n)
    if found == 0:
        raise ValueError("the data set is empty")
    if found < n:
        raise ValueError(f"the data set has {found} rows, at least {n} are needed")
    return df


def sample_rows(df: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) drawn without replacement.

    Each partition keeps its n smallest random keys, so no full sort happens.
    """
    return df.orderBy(F.rand(seed)).limit(n)


def write_results(result: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write a chart-data or evidence table as JSON lines or parquet."""
    if fmt not in ("json", "parquet"):
        raise ValueError("fmt must be 'json' or 'parquet'")
    result.write.mode(mode).format(fmt).save(path)
