"""One query per operator, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dataloupe.llm import (
    alignment, conversation_repair, decontaminate, html_extract, nn_descent, pieces, pseudo_likelihood, secret_ledger,
    simhash, suffix_dedup, token_counts, token_store, toxicity,
)
from dataloupe.llm.frames import whole_text, written
from dataloupe.llm.oracles import SQL  # noqa: F401
from dataloupe.plans.storage import scratch_path

LEAST_RECALL = 0.9  # of the links between embeddings, as audited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.withColumn("fingerprint", simhash.hexadecimal(F.col("fingerprint")))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(whole_text("text")).cast("long").alias("n_bytes"),
        "n_tokens",
        token_counts.over_limit(F.col("n_tokens"), 512).alias("over_limit"),
    )


@query
def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found, recall = nn_descent.near_vectors(table(spark, folder, "embeddings"))
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall of links is {recall:.3f}, less than {LEAST_RECALL}")
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op4_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.octet_length(whole_text("text")).cast("long"))
    cut = suffix_dedup.with_cut(sized, suffix_dedup.shared_spans(docs), with_text=False)
    return cut.select(
        "doc_id",
        "n_bytes",
        "kept.n_removed",
        "kept.n_spans",
        F.sha2("kept.kept", 256).alias("kept_sha256"),
    )


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    scored = toxicity.with_toxicity(docs, model, name="score")
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_extract.with_main_text(pages, name="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, path, with_ids=False)


@query
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_digests(pieces.encode_pieces(docs, model, decoded="decoded"))


def piece_digests(decoded: DataFrame) -> DataFrame:
    listed = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of a document and a benchmark item that it contains."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.benchmark_matches(docs, items)


@query
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and summed log-probability of the words of each document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = pseudo_likelihood.fit_language_model(docs)
    scored = pseudo_likelihood.with_pseudo_likelihood(docs, model)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_likelihood", mean.alias("per_word"))


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of each conversation, after damage that follows from its ids."""
    turns = table(spark, folder, "conversations")
    report, repaired = conversation_repair.repair_conversations(conversation_repair.crc_damage(turns))
    key = conversation_repair.conversation_key("conv_id")
    ids = turns.select(key.alias("key"), "conv_id").dropDuplicates(["key"])
    found = report.drop("conv_id").join(conversation_repair.line_digests(repaired), "key", "left")
    none = F.lit(0).cast("long")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, "key", "left").select(
        "conv_id",
        *[F.coalesce(n, none).alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op12_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document, from a new ledger; its documents are paths of one version."""
    docs, ledger = table(spark, folder, "documents"), scratch_path(spark, "ledger")
    secret_ledger.scan(docs.select("text"), ledger)
    versions = written(docs.select("doc_id", secret_ledger.blob("text").alias("blob")))
    found = secret_ledger.with_findings(versions, ledger)
    kinds = [r.kind for r in secret_ledger.BASE_RULES]
    base = F.filter("secrets", lambda x: x["kind"].isin(kinds))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in kinds],
        F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
        secret_ledger.listed(F.col("secrets")).alias("spans"),
    )


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Linked tokens of a byte-level BPE and a piece model in each document, with corpus counts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    files = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.with_alignment(docs, *files)
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, "groups_sha256")
