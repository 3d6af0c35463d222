"""Secrets in all versions of texts, with a ledger of what has been scanned.

A text is addressed by its content: its blob is the SHA-256 of its UTF-8 bytes. The ledger knows which
blob has been scanned by which version of which rule, so that a scan reads only texts that are new
to a rule, once each, however many paths and versions hold them. All of it is DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import unused, whole_text, written
from dataloupe.plans.joins import BROADCAST_BYTES, lookup_join
from dataloupe.plans.storage import estimated_bytes


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap, of which those count whose ``group`` (0:
    the whole match) has at least ``least`` characters. A changed rule gets a new ``version``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


# What these secrets look like. The order is that of kinds at the same place.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # whole runs, as a shorter run is no match
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
)
RULES = (*BASE_RULES, *MORE_RULES)


def blob(text: str = "text") -> Column:
    """The address of a text: SHA-256 of its bytes; a null text is an empty one."""
    return F.unhex(F.sha2(whole_text(text), 256))


def _named(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


# ``batches`` is written last: the rows of other tables count only if their batch is in it.
TABLES = {
    "findings": "blob binary, rule string, kind string, start long, end long, batch string",
    "scans": "blob binary, rule string, batch string",
    "batches": "batch string",
}


def read_ledger(spark: SparkSession, ledger: str, table: str) -> DataFrame:
    """The rows of complete batches in one of ``TABLES``; none before the first scan."""
    if not _exists(spark, f"{ledger}/batches"):
        return spark.createDataFrame([], TABLES[table])
    rows, batches = (spark.read.schema(TABLES[t]).parquet(f"{ledger}/{t}") for t in (table, "batches"))
    return rows.join(F.broadcast(batches), "batch", "left_semi")  # one row per scan ever made


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scan(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the texts of ``docs`` that the ledger does not know, and enter them there.

    ``docs`` holds any versions of any paths. Returns the pairs ``(blob, rule)`` that were scanned now.
    Nulls are empty texts, repeated rows one blob, further columns are ignored, an empty table adds
    nothing. Positions count code points from 0, ends are exclusive.

    Copies of a text are put together before the shuffle, task by task, so that one text in a third
    of all rows is one row per task. Texts are moved once. As long as the list of blobs that some
    rule has not seen is small (its files are measured), other texts are left out where they lie.

    A scan that was interrupted has not entered its batch, and what it wrote is ignored.
    """
    require_columns(docs, text)
    spark, batch = docs.sparkSession, uuid.uuid4().hex
    texts = docs.select(blob(text).alias("blob"), whole_text(text).alias("text"))
    todo = written(_unseen(texts.select("blob").distinct(), read_ledger(spark, ledger, "scans"), rules))
    if (estimated_bytes(todo) or 0) <= BROADCAST_BYTES:
        new = texts.join(F.broadcast(todo), "blob").dropDuplicates(["blob"])
    else:
        new = texts.dropDuplicates(["blob"]).join(todo, "blob")
    found = _findings(new, rules).withColumn("batch", F.lit(batch))
    found.write.mode("append").parquet(f"{ledger}/findings")
    bits = F.array_compact(F.array(*[F.when(_bit(i), _named(r)) for i, r in enumerate(rules)]))
    pairs = todo.select("blob", F.explode(bits).alias("rule"), F.lit(batch).alias("batch"))
    pairs.write.mode("append").parquet(f"{ledger}/scans")
    spark.createDataFrame([(batch,)], TABLES["batches"]).coalesce(1).write.mode("append").parquet(
        f"{ledger}/batches"
    )
    return pairs.select("blob", "rule")


def _bit(place: int) -> Column:
    """Whether the rule at a place has not seen a blob."""
    return F.col("todo").bitwiseAND(F.lit(1 << place)) != 0


def _unseen(blobs: DataFrame, scans: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, todo)``: blobs with one bit for each rule that has not seen them."""
    every = (1 << len(rules)) - 1
    known = F.coalesce(*[F.when(F.col("rule") == _named(r), F.lit(1 << i)) for i, r in enumerate(rules)])
    seen = scans.groupBy("blob").agg(F.bit_or(known).alias("seen"))
    left = F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0))))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("todo")).where("todo <> 0")


def _hits(place: int, rule: Rule) -> Column:
    """The parts of a text before each match of a rule and behind the last one, as lengths."""
    pattern = F.lit(rule.pattern)

    def lengths(part: Column, at: Column) -> Column:
        return F.struct(
            F.lit(_named(rule)).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            at.alias("at"),
            F.length(part["gap"]).cast("long").alias("gap"),
            F.length(part["found"]).cast("long").alias("size"),  # null behind the last match
            (F.length(part["value"]) >= rule.least).alias("counts"),
        )

    parts = F.arrays_zip(
        F.split("text", rule.pattern, -1).alias("gap"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
    )
    return F.when(_bit(place) & F.col("text").rlike(rule.pattern), F.transform(parts, lengths))


def _findings(new: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, rule, kind, start, end)`` of texts and the rules in ``todo``.

    A text is split at a rule's matches; the lengths of the parts and of the matches, added up in
    order, are the places. The rows of a text stay where its blob was dealt, so that adding up
    needs no further shuffle, and many matches in a text are rows and no growing array.
    """
    hits = F.array_compact(F.array(*[_hits(i, r) for i, r in enumerate(rules)]))
    rows = new.select("blob", F.explode(F.flatten(hits)).alias("hit")).select("blob", "hit.*")
    order = W.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(order)
    placed = rows.withColumn("end", end).where("size is not null and counts")
    return placed.select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def with_findings(
    versions: DataFrame,
    ledger: str,
    address: str = "blob",
    name: str = "secrets",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``versions`` with the findings of each blob in an array ``name`` of ``(start, end, kind)``, by start
    and then by the order of ``rules``; empty where there is none.

    ``versions`` has one row per path and version with the address of its text, see ``blob``; the
    texts themselves are not needed. The rows that hold a blob with findings are counted first,
    so that a text in a third of all rows is divided over tasks (see ``lookup_join``). Findings of
    the given versions of the rules count. A column ``name`` is replaced.
    """
    require_columns(versions, address)
    spark = versions.sparkSession
    found = read_ledger(spark, ledger, "findings").where(F.col("rule").isin([_named(r) for r in rules]))
    # Two scans that ran at the same time may both have entered a blob.
    found = found.dropDuplicates(["blob", "rule", "start", "end"])
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).alias("rank")
    spans = F.array_sort(F.collect_list(F.struct("start", rank, "end", "kind")))
    kept = F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"]))
    kept = kept.cast("array<struct<start: bigint, end: bigint, kind: string>>")
    by_blob = found.groupBy(F.col("blob").alias(address)).agg(kept.alias(name))
    versions = versions.drop(name)
    n_rows = unused(versions, "n_rows")
    held = versions.groupBy(address).agg(F.count(F.lit(1)).alias(n_rows))
    joined = lookup_join(versions, by_blob.join(held, address), [address], n_rows, "left").drop(n_rows)
    none = F.array().cast(by_blob.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(col(name), none))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")
