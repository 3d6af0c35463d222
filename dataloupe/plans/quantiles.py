"""Exact quantiles with linear interpolation, per group, at any group size.

The rows of every group are counted first, together with its other totals, and each row is
told the size of its group by a join that divides heavy groups (see ``joins``). Groups of up to
``SHORT_GROUP`` rows are put in order as one bounded list each. The others take a bracketing plan:

1. ``percentile_approx`` per (group, part of the input) gives each part's rank bounds a little
   left and right of the wanted one. A task belongs to one part only, so that it builds one
   sketch per group. The smallest left and the largest right bound over the parts enclose
   the group's quantile: if at least a share p of every part lies at or below a value, so
   does a share p of the whole.
2. One more scan counts rows per distinct value inside the bracket, and only totals outside
   it. About 0.1 % of the rows of these groups reach the shuffle.
3. The values in the brackets are put in order. Each bracket is first cut into equal cells;
   cell totals locate the cell of each wanted rank, and only the values of those cells are
   sorted.

The result is exact, and infinite values keep their place in the order. A group whose rank
fell outside its bracket would be taken once more with all its values in the bracket.

A whole column takes the bracketing plan as one lazy plan, in which the totals and the brackets are
one-row subqueries, so that nothing runs before the result is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dataloupe.functions.columns import quoted
from dataloupe.plans.joins import written_join
from dataloupe.plans.storage import materialize

ACCURACY = 10_000  # rank error of the sketch is at most n / ACCURACY
MARGIN = 4 / ACCURACY
SHORT_GROUP = 10_000
CELLS = 4096
PARTS = 256  # of the input; each merges the sketches of its tasks
INFINITY = float("inf")


def exact_quantiles(
    df: DataFrame,
    value: str,
    by: list[str],
    probs: dict[str, float],
    extra: list[Column] | None = None,
) -> DataFrame:
    """One row per group: ``by``, ``n``, ``min``, ``max``, ``sum``, one column per entry of
    ``probs``, and ``extra``.

    ``value`` must be a double column without NULL and NaN, ``by`` columns without NULL.
    ``extra`` are further aggregates over the same rows, taken with the counts. Without ``by``
    the result is one row, also for an empty input (n = 0).
    """
    y = F.col(quoted(value))
    totals = [
        F.count(F.lit(1)).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.sum(y).alias("sum"), *(extra or []),
    ]
    if not by:
        return _of_all(df, y, totals, probs)
    keys = [quoted(b) for b in by]
    facts = materialize(df.groupBy(*keys).agg(*totals))
    shortest, longest = facts.agg(F.min("n"), F.max("n")).first()
    rows = df.select(*keys, y.alias("_y"))
    ordered = sorted(set(probs.values()))
    found = []
    if (longest or 0) <= SHORT_GROUP:
        found.append(_listed(rows, keys, ordered))
    else:
        if shortest <= SHORT_GROUP:
            sized = written_join(rows, facts.select(*keys, F.col("n").alias("_rows")), by, "_rows")
            found.append(_listed(sized.where(F.col("_rows") <= SHORT_GROUP), keys, ordered))
            rows = sized.where(F.col("_rows") > SHORT_GROUP).drop("_rows")
        found.append(_bracketed(rows, by, ordered))
    ranked = facts.join(reduce(DataFrame.unionByName, found), by)
    return _levels(ranked, keys, probs, facts.columns[len(by) + 4 :])


def bracket_sketch(y: Column, ordered: list[float]) -> Column:
    """What one part of the input tells about the levels: two sketched values around each."""
    bounds = [b for p in ordered for b in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    return F.percentile_approx(y, bounds, ACCURACY)


def merged_sketches(sketch: Column, ordered: list[float]) -> list[Column]:
    """The aggregates ``lo, hi`` of each level over the parts' sketches."""
    pairs = ((F.min(sketch[2 * i]), F.max(sketch[2 * i + 1])) for i in range(len(ordered)))
    return [end for pair in pairs for end in pair]


def quantiles_in_brackets(
    placed: DataFrame, facts: DataFrame, by: list[str], probs: dict[str, float]
) -> DataFrame:
    """``facts``, which has ``by`` and the groups' sizes ``n``, and one column per entry of
    ``probs``, where the brackets are known before; lazy.

    ``placed`` has ``by``, the values ``_y``, the group's size ``_n`` and its brackets ``_b``, an
    array of (lo, hi) in the order of the levels. Rows above the last bracket may be left out.
    """
    ordered = sorted(set(probs.values()))
    found = _ranked(_in_brackets(placed, by, ordered), by, ordered)
    names = [n for n in found.columns if n not in by]
    lost = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    # Cannot happen as long as the sketches keep their promise.
    checked = F.when(lost, F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col(names[0]))
    levels = [_between(ordered.index(p), p).alias(name) for name, p in probs.items()]
    return found.withColumn(names[0], checked).join(facts, by).select(*map(quoted, facts.columns), *levels)


def _of_all(df: DataFrame, y: Column, totals: list[Column], probs: dict[str, float]) -> DataFrame:
    """The whole frame as one group. One row, and lazy: totals and brackets are subqueries."""
    counted = df.agg(*totals)
    ordered = sorted(set(probs.values()))
    rows = df.select(F.lit(0).alias("_all"), y.alias("_y"))
    brackets = _brackets(rows, ["_all"], ordered)
    told = brackets.select(F.struct("_n", "_b").alias("f")).agg(F.max("f")).scalar()
    placed = rows.withColumn("_f", told).select("*", "_f.*").drop("_f")
    found = _ranked(_in_brackets(placed, ["_all"], ordered), ["_all"], ordered)
    names = [n for n in found.columns if n != "_all"]
    # An empty frame has no row here, and NULLs then.
    values = found.agg(F.max(F.struct(*names))).scalar()
    ranked = counted.withColumn("_f", values).select(*counted.columns, *[F.col("_f")[n].alias(n) for n in names])
    lost = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]) & (F.col("n") > 0)
    # Cannot happen as long as the sketches keep their promise.
    checked = F.when(lost, F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col(names[0]))
    return _levels(ranked.withColumn(names[0], checked), [], probs, counted.columns[4:])


def _levels(ranked: DataFrame, keys: list[str], probs: dict[str, float], others: list[str]) -> DataFrame:
    ordered = sorted(set(probs.values()))
    levels = [_between(ordered.index(p), p).alias(name) for name, p in probs.items()]
    return ranked.select(*keys, "n", "min", "max", "sum", *levels, *map(quoted, others))


def _between(i: int, p: float) -> Column:
    """The interpolated value of level ``p`` from the two that enclose it."""
    position = (F.col("n") - 1) * F.lit(p)
    share = position - F.floor(position)
    low, high = F.col(f"_{i}_0"), F.col(f"_{i}_1")
    plain = (share == 0) | (low == high)
    return F.when(plain, low).otherwise(low * (1 - share) + high * share)


def _listed(rows: DataFrame, keys: list[str], ordered: list[float]) -> DataFrame:
    """The enclosing values of each level, for groups short enough to be one sorted list."""
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_y")).alias("_list"))
    ranks = [r for p in ordered for r in _ranks(F.size("_list"), p)]
    names = [f"_{i}_{side}" for i in range(len(ordered)) for side in (0, 1)]
    return lists.select(*keys, *[F.get("_list", r.cast("int")).alias(n) for r, n in zip(ranks, names)])


def _bracketed(rows: DataFrame, by: list[str], ordered: list[float]) -> DataFrame:
    """The same for long groups."""
    keys = [quoted(b) for b in by]
    brackets = materialize(_brackets(rows, keys, ordered))
    picked = _picked(rows, brackets, by, ordered)
    names = [n for n in picked.columns if n not in by]
    missed = picked.where(reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]))
    if missed.isEmpty():
        return picked
    # Cannot happen as long as the sketches keep their promise.
    whole = F.transform("_b", lambda _: F.struct(F.col("_min").alias("lo"), F.col("_max").alias("hi")))
    wide = brackets.join(missed.select(*keys), by, "left_semi").withColumn("_b", whole)
    repeated = rows.join(wide.select(*keys), by, "left_semi")
    return picked.join(wide, by, "left_anti").unionByName(_picked(repeated, wide, by, ordered))


def _picked(rows: DataFrame, brackets: DataFrame, by: list[str], ordered: list[float]) -> DataFrame:
    counted = _in_brackets(written_join(rows, brackets, by, "_n"), by, ordered)
    return _ranked(materialize(counted), by, ordered)


def _in_brackets(located: DataFrame, by: list[str], ordered: list[float]) -> DataFrame:
    """Rows per segment, cell and value; values only inside the brackets.

    Segment 2i lies below bracket i, segment 2i + 1 is bracket i itself.
    """
    inside = located.withColumn("_s", _segment(len(ordered))).where(F.col("_s").isNotNull())
    in_bracket = F.col("_s") % 2 == 1
    return (
        inside.withColumn("_c", _cell(in_bracket))
        .withColumn("_v", F.when(in_bracket, F.col("_y")))
        .groupBy(*[quoted(b) for b in by], "_n", "_s", "_c", "_v")
        .agg(F.count(F.lit(1)).alias("_m"))
    )


def _ranked(counted: DataFrame, by: list[str], ordered: list[float]) -> DataFrame:
    """The values at the wanted ranks, ``_{level}_0`` and ``_{level}_1`` per group."""
    keys = [quoted(b) for b in by]
    ranks = [_ranks(F.col("_n"), p) for p in ordered]
    cells = _wanted_cells(counted, keys, [r for pair in ranks for r in pair])
    within = W.partitionBy(*keys, "_s", "_c").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counted.join(cells, [*by, "_s", "_c"])
    hits = placed.withColumn("_end", F.col("_start") + F.sum("_m").over(within))
    hits = hits.withColumn("_start", F.col("_end") - F.col("_m"))

    def value_at(rank: Column) -> Column:
        here = (F.col("_start") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    return hits.groupBy(*keys).agg(
        *[value_at(r).alias(f"_{i}_{side}") for i, pair in enumerate(ranks) for side, r in enumerate(pair)]
    )


def _brackets(rows: DataFrame, keys: list[str], ordered: list[float]) -> DataFrame:
    """Per group: its size ``_n``, its ends, and an array ``_b`` of (lo, hi), one per level."""
    parts = (
        rows.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        .groupBy(*keys, "_part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("_y").alias("min"),
            F.max("_y").alias("max"),
            bracket_sketch(F.col("_y"), ordered).alias("_a"),
        )
    )
    ends = [f"_{side}{i}" for i in range(len(ordered)) for side in ("lo", "hi")]
    merged = parts.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.min("min").alias("_min"),
        F.max("max").alias("_max"),
        *[c.alias(n) for c, n in zip(merged_sketches(F.col("_a"), ordered), ends)],
    )
    pairs = [
        F.struct(F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
        for i in range(len(ordered))
    ]
    return merged.select(*keys, "_n", "_min", "_max", F.array(*pairs).alias("_b"))


def _segment(levels: int) -> Column:
    y, out = F.col("_y"), None
    for i in range(levels):
        edge = F.col("_b")[i]
        place = F.when(y < edge["lo"], 2 * i).otherwise(2 * i + 1)
        out = F.when(y <= edge["hi"], place) if out is None else out.when(y <= edge["hi"], place)
    return out


def _cell(in_bracket: Column) -> Column:
    """The cell of a value in its bracket; the order of cells is the order of values.

    A bracket with an infinite end is divided on a logarithmic scale, which is finite.
    """
    edge = F.col("_b")[(F.col("_s") / 2).cast("int")]
    endless = (F.abs(edge["lo"]) == INFINITY) | (F.abs(edge["hi"]) == INFINITY)

    def scaled(v: Column) -> Column:
        return F.when(endless, F.signum(v) * F.least(F.log1p(F.abs(v)), F.lit(800.0))).otherwise(v)

    low, width = scaled(edge["lo"]), scaled(edge["hi"]) - scaled(edge["lo"])
    place = F.least(F.floor((scaled(F.col("_y")) - low) / width * CELLS), F.lit(CELLS - 1))
    return F.when(in_bracket & (width > 0), place).otherwise(F.lit(0)).cast("int")


def _wanted_cells(counted: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """``(keys, _s, _c, _start)`` of the cells that hold a wanted rank. At most CELLS + 1
    totals per level and group are put in order, whatever the group's size."""
    totals = counted.groupBy(*keys, "_n", "_s", "_c").agg(F.sum("_m").alias("_w"))
    so_far = W.partitionBy(*keys).orderBy("_s", "_c").rowsBetween(W.unboundedPreceding, 0)
    totals = totals.withColumn("_end", F.sum("_w").over(so_far))
    totals = totals.withColumn("_start", F.col("_end") - F.col("_w"))
    holds = [(F.col("_start") <= r) & (r < F.col("_end")) for r in ranks]
    return totals.where(reduce(lambda a, b: a | b, holds)).select(*keys, "_s", "_c", "_start")


def _ranks(n: Column, p: float) -> list[Column]:
    """Zero-based ranks of the two values that enclose level ``p``."""
    position = (n - 1) * F.lit(p)
    return [F.floor(position), F.ceil(position)]
