"""Outliers, summaries and top-k."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.registry import Tables, quartiles, query, r
from dataloupe.operators import outliers as ops, summary, topk


def squared(t: Tables) -> DataFrame:
    """events with a metric that has extreme values."""
    return t.events.withColumn("energy", F.col("value") * F.col("value"))


_SQUARED = "(SELECT *, value * value AS energy FROM events)"


def _evidence(by: str, table: str, y: str) -> str:
    return f"""
WITH limits AS (
  SELECT {by} AS "group", count({y}) AS n, quantile_cont({y}, 0.99) AS p99, max({y}) AS max, sum({y}) AS total
  FROM {table} GROUP BY ALL HAVING quantile_cont({y}, 0.99) > 0 AND max({y}) > 3 * quantile_cont({y}, 0.99)),
hidden AS (
  SELECT l.*, h.outlier_count, h.outlier_sum,
         CASE WHEN total > 0 THEN h.outlier_sum / total * 100 ELSE 0 END AS impact
  FROM limits l JOIN (SELECT k."group", count(*) AS outlier_count, sum(s.{y}) AS outlier_sum
    FROM {table} s JOIN limits k ON {by} = k."group" WHERE s.{y} > k.p99 GROUP BY 1) h ON h."group" = l."group")
SELECT CAST("group" AS VARCHAR) AS "group", n, {r("p99", "p99")}, {r("max", "max")}, outlier_count,
       {r("outlier_sum", "outlier_sum")}, {r("total", "total_sum")}, {r("impact", "impact_pct")},
       CAST(round_even(max, 2) AS DOUBLE) AS original_max, CAST(round_even(p99, 2) AS DOUBLE) AS clipped_at,
       CAST(round_even(impact, 1) AS DOUBLE) AS hidden_impact_pct,
       printf('Stat Alert: %d extreme outliers (Max: %.2f) hidden. They represent %.1f%% of total {y} value.',
              outlier_count, max, impact) AS summary
FROM hidden"""


@query(_evidence("event_type", _SQUARED, "energy"))
def outliers_by_group(t: Tables) -> DataFrame:
    return ops.outliers_by_group(squared(t), "energy", "event_type")


_COHORTS = "(SELECT user_id % 25 AS cohort, pow(value / 100, 8) AS spike FROM events)"


@query(_evidence("cohort", _COHORTS, "spike"))
def outliers_by_numeric_group(t: Tables) -> DataFrame:
    """A number as the group; several of the groups have outliers."""
    rows = t.events.select((F.col("user_id") % 25).alias("cohort"), F.pow(F.col("value") / 100, F.lit(8.0)).alias("spike"))
    return ops.outliers_by_group(rows, "spike", "cohort")


@query(_evidence("'Global'", _SQUARED, "energy"))
def outliers_global(t: Tables) -> DataFrame:
    return ops.outliers_global(squared(t), "energy")


@query("""
SELECT event_type, count(*) AS n_rows, CAST(NULL AS DOUBLE) AS p99, 'none' AS found FROM events GROUP BY event_type""")
def outliers_of_text(t: Tables) -> DataFrame:
    """A text metric: each group stands without evidence, and there is no error."""
    evidence = ops.outliers_by_group(t.events, "props", "event_type").select("group", "p99", "summary")
    groups = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = groups.join(evidence, F.col("event_type") == F.col("group"), "left")
    return joined.select("event_type", "n_rows", "p99", F.coalesce("summary", F.lit("none")).alias("found"))


def _clip(by: str, table: str, y: str) -> str:
    return f"""
WITH limits AS (
  SELECT {by} AS g, quantile_cont({y}, 0.99) AS p99 FROM {table} WHERE {y} IS NOT NULL AND {by} IS NOT NULL
  GROUP BY ALL HAVING p99 > 0 AND max({y}) > 3 * p99)
SELECT event_id, event_type, {r(y, y)} FROM {table} s LEFT JOIN limits l ON {by} = l.g
WHERE l.p99 IS NULL OR {y} IS NULL OR {y} <= l.p99"""


@query(_clip("event_type", _SQUARED, "energy"))
def clip_outliers(t: Tables) -> DataFrame:
    clipped = ops.clip_outliers(squared(t), "energy", "event_type")
    return clipped.select("event_id", "event_type", "energy")


@query(_clip("'Global'", _SQUARED, "energy"))
def clip_outliers_global(t: Tables) -> DataFrame:
    return ops.clip_outliers(squared(t), "energy").select("event_id", "event_type", "energy")


_GAPPED = """
(SELECT event_id, nullif(event_type, 'error') AS event_type,
        CASE WHEN event_type <> 'view' THEN value * value END AS energy FROM events)"""


@query(_clip("event_type", _GAPPED, "energy"))
def clip_outliers_keeps_gaps(t: Tables) -> DataFrame:
    """Rows without a group or a value are neither outliers nor dropped."""
    gapped = squared(t).select(
        "event_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        F.when(F.col("event_type") != "view", F.col("energy")).alias("energy"),
    )
    return ops.clip_outliers(gapped, "energy", "event_type")


def _fence(table: str, y: str) -> str:
    return f"""
WITH q AS (SELECT {quartiles(y)}, sum({y}) AS total FROM {table}),
f AS (SELECT *, q3 + 1.5 * (q3 - q1) AS fence FROM q)
SELECT {r("any_value(q1)", "q1")}, {r("any_value(q3)", "q3")}, {r("any_value(fence)", "upper_fence")},
       count(*) FILTER ({y} > fence) AS outlier_count,
       {r(f"coalesce(sum({y}) FILTER ({y} > fence), 0) / nullif(any_value(total), 0) * 100", "outlier_impact_pct")}
FROM {table} CROSS JOIN f"""


@query(_fence("events", "value"))
def iqr_outliers(t: Tables) -> DataFrame:
    return ops.iqr_outliers(t.events, "value")


@query(_fence("orders", "o_totalprice"))
def iqr_outliers_orders(t: Tables) -> DataFrame:
    return ops.iqr_outliers(t.orders, "o_totalprice")


@query(f"""
SELECT {r("quantile_cont(value, 0.5)", "median")}, {r("avg(value)", "mean")},
       {r("stddev_samp(value) / avg(value)", "cv")}, {r("kurtosis_pop(value)", "kurtosis")} FROM events""")
def dispersion(t: Tables) -> DataFrame:
    return ops.dispersion(t.events, "value")


_ENTROPY = """
-sum(n / total * log2(n / total)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END"""


def _counts(table: str, c: str) -> str:
    return f"(SELECT *, sum(n) OVER () AS total FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1))"


def _concentration(table: str, c: str) -> str:
    return f"""
SELECT CAST((SELECT v FROM {_counts(table, c)} ORDER BY n DESC, CASE WHEN length(CAST(v AS VARCHAR)) < 64 THEN CAST(v AS VARCHAR) ELSE sha256(CAST(v AS VARCHAR)) END LIMIT 1) AS VARCHAR) AS top_class,
       {r("max(n) / any_value(total) * 100", "top_share")}, count(*) AS unique_count,
       max(n) / any_value(total) * 100 > 50 AS is_imbalanced FROM {_counts(table, c)}"""


@query(_concentration("customer", "c_mktsegment"))
def concentration(t: Tables) -> DataFrame:
    return summary.concentration(t.customer, "c_mktsegment")


@query(_concentration("conversations", "text"))
def concentration_of_texts(t: Tables) -> DataFrame:
    return summary.concentration(t.conversations, "text")


@query(f"SELECT count(*) AS unique_count, {r(_ENTROPY, 'entropy')} FROM {_counts('customer', 'c_mktsegment')}")
def normalized_entropy(t: Tables) -> DataFrame:
    return summary.normalized_entropy(t.customer, "c_mktsegment")


@query(f"SELECT count(*) AS unique_count, {r(_ENTROPY, 'entropy')} FROM {_counts('documents', 'source')}")
def normalized_entropy_of_sources(t: Tables) -> DataFrame:
    return summary.normalized_entropy(t.documents, "source")


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3,
  sum(value) AS total, stddev_samp(value) / avg(value) AS cv, kurtosis_pop(value) AS kurt FROM events),
f AS (SELECT *, q3 + 1.5 * (q3 - q1) AS fence FROM q),
o AS (SELECT count(*) AS n, sum(value) AS s FROM events, f WHERE value > fence)
SELECT 1 AS act, printf('BASELINE: ''value'' shows a median of %.2f with a CV of %.2f.', med, cv) AS text FROM f
UNION ALL
SELECT 2, printf('DIVERGENCE: We found %d extreme events representing %.1f%% of volume. Kurtosis is %.2f.', n, s / total * 100, kurt)
FROM f, o
UNION ALL
SELECT 3, printf('LEVER: Focus on the %d records exceeding the %.2f threshold to stabilize the North Star. ' || chr(10) ||
  ' Alert if value > %.2f', n, fence, fence) FROM f, o""")
def forensic_summary_numeric(t: Tables) -> DataFrame:
    return summary.forensic_summary(t.events, "value")


@query(f"""
WITH c AS ({_concentration("customer", "c_mktsegment")}),
e AS (SELECT {_ENTROPY} AS entropy FROM {_counts("customer", "c_mktsegment")})
SELECT 1 AS act, printf('BASELINE: ''c_mktsegment'' is dominated by ''%s'' (%.1f%% share).', top_class, top_share) AS text FROM c
UNION ALL
SELECT 2, printf('DIVERGENCE: The structure is highly %s (Entropy: %.2f) across %d unique categories.',
  CASE WHEN entropy > 0.7 THEN 'fragmented' ELSE 'concentrated' END, entropy, unique_count) FROM c, e
UNION ALL
SELECT 3, printf('LEVER: Prioritize the ''%s'' segment for immediate scale, as it represents the core driver of the Primary Metric. '
  || chr(10) || ' Monitor %s retention. Consolidate %d variants', top_class, top_class, unique_count) FROM c""")
def forensic_summary_categorical(t: Tables) -> DataFrame:
    return summary.forensic_summary(t.customer, "c_mktsegment")


def _pareto(table: str, c: str, y: str) -> str:
    return f"""
SELECT {c}, total, row_number() OVER w AS rank, sum(total) OVER w / nullif(sum(total) OVER (), 0) AS cum_share,
       total / nullif(lead(total) OVER w, 0) AS gap_ratio
FROM (SELECT {c}, CAST(coalesce(sum({y}), 0) AS DOUBLE) AS total FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)
WINDOW w AS (ORDER BY total DESC, {c})"""


def _pareto_shown(table: str, c: str, y: str) -> str:
    return f"""
SELECT {c}, {r("total", "total")}, rank, {r("cum_share", "cum_share")}, {r("gap_ratio", "gap_ratio")}
FROM ({_pareto(table, c, y)})"""


@query(_pareto_shown("documents", "source", "n_chars"))
def category_pareto(t: Tables) -> DataFrame:
    return topk.category_pareto(t.documents, "source", "n_chars")


@query(_pareto_shown("orders", "o_custkey", "o_totalprice"))
def category_pareto_many_categories(t: Tables) -> DataFrame:
    return topk.category_pareto(t.orders, "o_custkey", "o_totalprice")


def _folded(table: str, key: str, c: str, y: str) -> str:
    return f"""
WITH p AS ({_pareto(table, c, y)}),
k AS (SELECT coalesce(min(rank) FILTER (cum_share >= 0.9 OR rank >= 12), count(*)) AS k FROM p)
SELECT {key}, coalesce((SELECT p.{c} FROM p, k WHERE p.{c} = s.{c} AND rank <= k), 'Others') AS {c} FROM {table} s"""


@query(_folded("documents", "doc_id", "source", "n_chars"))
def top_k_others_hard_cap(t: Tables) -> DataFrame:
    return topk.top_k_others(t.documents, "source", "n_chars").select("doc_id", "source")


_FOURTH = "(SELECT *, value * value * value * value AS v4 FROM events)"


@query(_folded(_FOURTH, "event_id", "event_type", "v4"))
def top_k_others_coverage(t: Tables) -> DataFrame:
    value = F.col("value")
    events = t.events.withColumn("v4", value * value * value * value)
    return topk.top_k_others(events, "event_type", "v4").select("event_id", "event_type")


_MIXED = "(SELECT c_custkey, c_mktsegment || c_nationkey % 5 AS niche, c_acctbal FROM customer)"


@query(_folded(_MIXED, "c_custkey", "niche", "c_acctbal"))
def top_k_others_negative_sums(t: Tables) -> DataFrame:
    """A metric with negative values, so the running share can fall again."""
    niche = F.concat("c_mktsegment", (F.col("c_nationkey") % 5).cast("string"))
    mixed = t.customer.select("c_custkey", niche.alias("niche"), "c_acctbal")
    return topk.top_k_others(mixed, "niche", "c_acctbal").select("c_custkey", "niche")


@query(f"""SELECT *, 'mine' AS _group, 1 AS _limit FROM ({_clip("event_type", _SQUARED, "energy")})""")
def clip_outliers_with_helper_names(t: Tables) -> DataFrame:
    """Columns with the names of the operator's helpers are untouched."""
    named = squared(t).select("event_id", "event_type", "energy", F.lit("mine").alias("_group"), F.lit(1).alias("_limit"))
    return ops.clip_outliers(named, "energy", "event_type")
