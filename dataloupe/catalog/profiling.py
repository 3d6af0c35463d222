"""Column profiles."""

from pyspark.sql import DataFrame, functions as F

from dataloupe.catalog.cleaning import _HOLES, holes
from dataloupe.catalog.registry import Tables, query, r
from dataloupe.operators import profile as ops

# Column kinds of the profiled tables, for the SQL side: n number, s text, t time.
CUSTOMER = {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"}
PART = {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"}
LINEITEM = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
    "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s",
    "l_shipdate": "t",
}
ORDERS = {
    "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t",
    "o_orderpriority": "s",
}


def _class(name: str, kind: str) -> str:
    if kind == "t":
        return "'TEMPORAL'"
    if kind == "s":
        return "'CATEGORICAL'"
    return f"CASE WHEN count(DISTINCT {name}) > 10 THEN 'NUMERICAL' ELSE 'CATEGORICAL' END"


def _each(columns: dict[str, str], select: str, table: str, having: str = "") -> str:
    """One select per column, glued together; {c} is the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {select.format(c=c, cls=_class(c, k))} FROM {table} {having.format(c=c)}"
        for c, k in columns.items()
    )


def _of(columns: dict[str, str], kinds: str) -> dict[str, str]:
    return {c: k for c, k in columns.items() if k in kinds}


_TYPES = "{cls} AS semantic_type"
_NULLS = r("count(*) FILTER ({c} IS NULL) / count(*) * 100", "null_pct")
_NUMERIC = ", ".join(
    [r("min({c})", "min"), r("max({c})", "max"), r("quantile_cont({c}, 0.5)", "median"), r("avg({c})", "mean")]
)
_NUMERICAL_ONLY = "HAVING count(DISTINCT {c}) > 10"
_HINT = (
    "CASE WHEN quantile_cont({c}, 0.5) > 0 AND max({c}) / (quantile_cont({c}, 0.5) + 1e-6) > 50 "
    "THEN 'High Skew (Consider Log)' ELSE 'Normal Range' END AS hint"
)


def _tops(columns: dict[str, str], table: str) -> str:
    """Top five values with their rank for each categorical column."""
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table} WHERE {c} IS NOT NULL"
        + (f" AND (SELECT count(DISTINCT {c}) FROM {table}) <= 10" if k == "n" else "")
        for c, k in columns.items()
        if k != "t"
    )
    return f"""
SELECT "column", value, n, CAST(place AS INTEGER) AS rank, n_unique FROM (
  SELECT "column", value, count(*) AS n,
         row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC,
           CASE WHEN length(value) < 64 THEN value ELSE sha256(value) END) AS place,
         count(*) OVER (PARTITION BY "column") AS n_unique
  FROM ({cells}) GROUP BY "column", value)
WHERE place <= 5"""


@query(_each(LINEITEM, _TYPES, "lineitem", "HAVING count(*) > 0"))
def semantic_types(t: Tables) -> DataFrame:
    return ops.semantic_types(t.lineitem)


@query(_each(LINEITEM, _NULLS, _HOLES))
def null_percent(t: Tables) -> DataFrame:
    return ops.null_percent(holes(t))


@query(_each(_of(LINEITEM, "n"), _NUMERIC, _HOLES, _NUMERICAL_ONLY))
def numeric_profile(t: Tables) -> DataFrame:
    return ops.numeric_profile(holes(t))


_CUBED = "(SELECT value * value * value AS cube, value, user_id, event_id FROM events)"


@query(_each({"cube": "n", "value": "n", "user_id": "n", "event_id": "n"}, _HINT, _CUBED, _NUMERICAL_ONLY))
def skew_hint(t: Tables) -> DataFrame:
    value = F.col("value")
    return ops.skew_hint(t.events.select((value * value * value).alias("cube"), "value", "user_id", "event_id"))


@query(_tops(PART, "part"))
def categorical_profile(t: Tables) -> DataFrame:
    return ops.categorical_profile(t.part)


@query(_tops({"text": "s", "lang": "s", "source": "s"}, "documents"))
def categorical_profile_long_texts(t: Tables) -> DataFrame:
    return ops.categorical_profile(t.documents.select("text", "lang", "source"))


@query(_each(_of(PART, "s"), "count(DISTINCT {c}) AS n_unique", "part", "HAVING count(DISTINCT {c}) > 15"))
def cardinality_warning(t: Tables) -> DataFrame:
    return ops.cardinality_warning(t.part)


@query(_each({**_of(CUSTOMER, "s"), **{"c_nationkey": "n"}}, "count(DISTINCT {c}) AS n_unique", "customer", "HAVING count(DISTINCT {c}) > 0 AND '{c}' <> 'c_nationkey' OR count(DISTINCT {c}) <= 10"))
def distinct_counts(t: Tables) -> DataFrame:
    return ops.distinct_counts(t.customer)


def _profile_sql(columns: dict[str, str], table: str) -> str:
    parts = []
    for i, (c, k) in enumerate(columns.items()):
        numerical = f"count(DISTINCT {c}) > 10" if k == "n" else "false"
        number = c if k == "n" else "CAST(NULL AS DOUBLE)"
        dates = "strftime({f}(" + c + "), '%Y-%m-%d')" if k == "t" else "CAST(NULL AS VARCHAR)"
        figures = ", ".join(
            r(f"CASE WHEN {numerical} THEN {e} END", a)
            for e, a in (
                (f"min({number})", "min"), (f"max({number})", "max"),
                (f"quantile_cont({number}, 0.5)", "median"), (f"avg({number})", "mean"),
            )
        )
        unique = f"CASE WHEN {_class(c, k)} = 'CATEGORICAL' THEN count(DISTINCT {c}) END"
        hint = _HINT.removesuffix(" AS hint").format(c=number)
        parts.append(f"""
SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", {_class(c, k)} AS semantic_type,
       {_NULLS.format(c=c)}, {figures}, CASE WHEN {numerical} THEN {hint} END AS hint,
       {unique} AS n_unique, {unique} > 15 AS high_cardinality,
       {dates.format(f='min')} AS min_date, {dates.format(f='max')} AS max_date FROM {table}""")
    return f"""
SELECT b.*, t.top_values FROM ({" UNION ALL ".join(parts)}) b
LEFT JOIN (SELECT "column", string_agg(value, '|' ORDER BY rank) AS top_values
           FROM ({_tops(columns, table)}) GROUP BY 1) t ON b."column" = t."column" """


def _flat(profiled: DataFrame) -> DataFrame:
    """Top values as one text, without the note on nested columns."""
    return profiled.withColumn("top_values", F.array_join("top_values", "|")).drop("note")


@query(_profile_sql(CUSTOMER, "customer"))
def profile_customer(t: Tables) -> DataFrame:
    return _flat(ops.profile(t.customer))


@query(_profile_sql(PART, "part"))
def profile_part(t: Tables) -> DataFrame:
    return _flat(ops.profile(t.part))


@query(_profile_sql(LINEITEM, _HOLES))
def profile_lineitem(t: Tables) -> DataFrame:
    return _flat(ops.profile(holes(t)))


@query(_profile_sql(ORDERS, "orders"))
def profile_orders(t: Tables) -> DataFrame:
    return _flat(ops.profile(t.orders))


@query("""
SELECT 'vec_id' AS "column", 'NUMERICAL' AS semantic_type, CAST(NULL AS VARCHAR) AS note
FROM embeddings HAVING count(DISTINCT vec_id) > 10
UNION ALL SELECT 'embedding', NULL, 'not profiled: array<float>' FROM embeddings HAVING count(*) > 0
UNION ALL SELECT 'label', CASE WHEN count(DISTINCT label) > 10 THEN 'NUMERICAL' ELSE 'CATEGORICAL' END, NULL
FROM embeddings""")
def profile_nested_columns(t: Tables) -> DataFrame:
    return ops.profile(t.embeddings).select("column", "semantic_type", "note")
