"""A corpus through five stages: clean, unique, decontaminated documents as piece ids.

Each stage takes what its predecessor wrote and returns the columns of ``documents``; the last
returns the pieces of each text. Rows that a stage has no reason to reject go on unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dataloupe.functions.columns import col
from dataloupe.llm import decontaminate, pieces, simhash, suffix_dedup, toxicity
from dataloupe.llm.frames import unused, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score says that label 1 is the likelier one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    name = unused(docs, "toxicity")
    scored = toxicity.with_toxicity(docs, model, name=name)
    return scored.where(col(name) < TOXIC).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, and of several rows with that id
    the one with the smallest digest of id and text. Documents without an id come last."""
    return simhash.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 50 bytes or more that a document with a smaller id has too.

    Characters of which a part was cut are left out, ``n_chars`` is counted again, and
    documents of which nothing is left are dropped. Documents without repeats are unchanged.
    """
    name = unused(docs, "cut")
    cut = suffix_dedup.with_cut(docs, suffix_dedup.shared_spans(docs), name=name)
    left, touched = col(name)["kept"].cast("string"), col(name)["n_removed"] > 0
    kept = F.coalesce(F.try_validate_utf8(left), _whole_characters(left))
    text = F.when(touched, kept).otherwise(col("text"))
    done = cut.withColumn("text", text).withColumn(
        "n_chars", F.when(touched, F.length("text").cast("long")).otherwise(col("n_chars"))
    )
    return done.where(~(touched & (F.length("text") == 0))).drop(name)


def _whole_characters(text: Column) -> Column:
    """The valid characters of a text."""
    return F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    matches = written(decontaminate.benchmark_matches(docs, items))
    return decontaminate.without_benchmark(docs, matches)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(docs.select(*COLUMNS), model, decoded="decoded")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        "piece_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes_to_text"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", to_pieces),
]
ORACLE_SQL = None  # SQL has neither the hashes nor the models; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
