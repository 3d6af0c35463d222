"""Faults of conversations, and their cheapest repair to alternating turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm import edit_search as es
from dataloupe.llm.frames import ship, unused, written
from dataloupe.plans.joins import lookup_join
from dataloupe.plans.ordering import ROW_BITS, range_parts

SPACE = " \t\n\x0b\x0c\r"
BLOCK = 64  # turns searched at once
FAN = 64  # blocks joined at once
MATRIX = "costs array<int>, places array<int>"


def _or_space(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(" "))


def crc_damage(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``df`` with faults that follow from CRC-32 of ``conv:turn`` modulo 20, to try repairs on.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row and 4 sets
    the role user. Nulls are one space, in the hashed key, in roles and in texts.
    """
    require_columns(df, conv, turn, role, text)
    case = F.crc32(F.concat_ws(":", _or_space(conv), _or_space(turn))) % 20
    words = _or_space(text)
    hurt = F.when(case == 1, "").when(case == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words)
    out = df.where(case != 0).withColumns(
        {role: F.when(case == 4, "user").otherwise(_or_space(role)), text: hurt}
    )
    copies = F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))
    name = unused(out, "_copy")
    return out.withColumn(name, F.explode(copies)).drop(name)


def conversation_key(conv: str) -> Column:
    """A text that stands for an id, and for a null id too."""
    return F.coalesce(F.concat(F.lit("="), col(conv).cast("string")), F.lit(""))


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """A report per conversation and the repaired turns, as two frames.

    The turns of a conversation are taken by ``turn``, nulls first; equal turns by role, the first
    64 characters of the text and the rest of it by its SHA-256, so that repeated rows are
    neighbours. The first of these faults of a turn counts: blank (only white space), duplicate
    (role and text were there before), truncated (the last character that is not white space
    is none of ``.!?``). The repair is the cheapest list of edits, see ``edit_search``, found by
    iterative-deepening A*.

    * ``report``: ``key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. ``gaps`` are
      missing numbers between the least and the greatest turn, ``illegal`` neighbours whose roles
      do not follow each other, ``audit`` the edits' initials in order.
    * ``repaired``: ``key, conv_id, place, step, edit, turn, role, text``, ordered in each conversation
      by ``place`` and ``step``. Inserted turns have no number and an empty text.

    ``key`` is a text that is never null; null ids are one conversation. Null roles and texts count
    as one space. Further columns are ignored, and an empty table gives two empty frames.

    Rows are dealt by range of id and turn, so that a conversation of any length is divided
    over tasks, and searched in blocks of up to ``BLOCK`` turns. A conversation of one block is
    searched as a whole. The blocks of others are searched from each state to each state and
    joined ``FAN`` at a time, level by level, which gives the same edits. No task holds a conversation.
    """
    require_columns(df, conv, turn, role, text)
    ship(df.sparkSession)
    placed = _placed(df, conv, turn, role, text)
    stretches = written(_stretches(placed))
    found = stretches.where("whole").mapInPandas(_whole_lists, _SEARCHED)
    blocks, most = _numbered(stretches.where("not whole"))
    if most:
        found = found.unionByName(_chained(blocks, most))
    searched = written(found)
    report = _report(placed, stretches, searched, _seams(blocks) if most else None)
    return report, _repaired(placed, searched)


def _placed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns in order, written with ``_part`` and ``_row`` and what is seen in each alone."""
    said = _or_space(text)
    tail = F.rtrim(said, F.lit(SPACE))
    rows = df.select(
        conversation_key(conv).alias("key"),
        col(conv).alias("conv_id"),
        col(turn).alias("turn"),
        _or_space(role).alias("role"),
        said.alias("text"),
        F.when(tail == "", "b").when(F.right(tail, F.lit(1)).isin(*".!?"), "-").otherwise("t").alias("fault"),
    )
    rows = rows.withColumn("digest", _digest("role", "text"))
    first = [F.asc_nulls_first(n) for n in ("conv_id", "turn")]
    return range_parts(rows, [*first, F.asc("role"), F.left("text", F.lit(64)).asc(), F.asc("digest")])


def _digest(role: str, text: str) -> Column:
    parts = F.concat(F.length(role).cast("string"), F.lit(":"), col(role), col(text))
    return F.unhex(F.sha2(parts, 256))


def _row_id() -> Column:
    return F.shiftleft(F.col("_part").cast("long"), ROW_BITS) + F.col("_row")


def _stretches(placed: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK`` turns of one conversation in one part: one row each, with the
    roles' letters, the faults and the numbers that gaps are made of."""
    rows = placed.select(
        "key", "turn", F.left("role", F.lit(1)).alias("letter"), "fault", "_part", "_row",
        F.when(F.col("fault") != "b", F.col("digest")).alias("digest"), _row_id().alias("id"),
    )
    seen = rows.where(F.col("digest").isNotNull()).groupBy("key", "digest")
    repeated = seen.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = lookup_join(rows, repeated, ["key", "digest"], "n", "left")
    again = F.col("id") > F.col("first")
    letter = F.when(F.col("letter").isin("s", "u", "a"), F.col("letter")).otherwise("x")
    # The turns of a conversation in a part have consecutive rows, so a group here never has
    # more than BLOCK turns, whatever the conversation holds.
    starts = placed.groupBy("key", "_part").agg(F.min("_row").alias("first_row"), F.count(F.lit(1)).alias("held"))
    totals = starts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("held").alias("turns"))
    whole = (F.col("parts") == 1) & (F.col("turns") <= BLOCK)
    starts = starts.join(totals.select("key", whole.alias("whole")), "key")
    placed_rows = rows.join(starts, ["key", "_part"]).withColumn(
        "block", F.expr(f"(_row - first_row) div {BLOCK}")
    )
    turns = F.sort_array(
        F.collect_list(
            F.struct("_row", letter.alias("letter"), F.when(again, "d").otherwise(F.col("fault")).alias("fault"), "turn")
        )
    )
    grouped = placed_rows.groupBy("key", "_part", "block", "whole").agg(turns.alias("t"))
    number = F.col("t.turn").cast("array<decimal(38,0)>")
    return grouped.select(
        "key", "_part", "block", "whole", F.col("t")[0]["_row"].alias("_row"),
        F.array_join("t.letter", "").alias("letters"), F.array_join("t.fault", "").alias("faults"),
        F.array_min(number).alias("least"), F.array_max(number).alias("most"),
        F.size(F.array_distinct(F.array_compact(number))).alias("distinct"),
    )


_WAY = "key string, at long, start int, goal int, cost int, last boolean"
_SEARCHED = "key string, _part int, block long, _row long, letters string, start int, audit string, tail string, cost int"


def _whole_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        found = [es.whole(a, b) for a, b in zip(rows["letters"], rows["faults"])]
        out = rows[["key", "_part", "block", "_row", "letters"]].assign(start=es.START)
        # Inserts that complete the list follow its last turn.
        split = [_split(a) for _, a in found]
        out["audit"], out["tail"] = [a for a, _ in split], [t for _, t in split]
        out["cost"] = [c for c, _ in found]
        yield out


def _split(edits: str) -> tuple[str, str]:
    body = edits.rstrip("I")
    return body, edits[len(body) :]


def _numbered(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with their number ``at`` in the conversation, and the most that one has."""
    counted = blocks.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("key").orderBy("_part")  # one row per part that a conversation reaches into
    before = counted.select("key", "_part", (F.sum("n").over(order) - F.col("n")).alias("before"))
    numbered = written(
        blocks.join(before, ["key", "_part"]).withColumn("at", F.col("before") + F.col("block")).drop("before")
    )
    return numbered, (numbered.agg(F.max("at")).first()[0] or 0) + (not numbered.isEmpty())


def _chained(blocks: DataFrame, most: int) -> DataFrame:
    """The edits of conversations of several blocks: searched from each state to each state,
    joined upwards level by level, and the way chosen at the top handed down again."""
    place = ["key", "_part", "block", "_row", "letters", "at"]
    matrix = T.StructType([*blocks.select(*place).schema, *_types(f"{MATRIX}, audits array<string>")])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            found = [es.block(a, b) for a, b in zip(rows["letters"], rows["faults"])]
            out = rows[place].copy()
            out["costs"] = [[None if x is None else x[0] for x in f] for f in found]
            out["places"] = [es.ranks(f) for f in found]
            out["audits"] = [[None if x is None else x[1] for x in f] for f in found]
            yield out

    # A block is few bytes and much work: dealt evenly over a fixed number of tasks.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(tasks, "key", "at")
    leaf = written(dealt.mapInPandas(search, matrix))
    levels = [leaf.select("key", "at", "costs", "places")]
    while most > 1:
        groups = levels[-1].groupBy("key", F.expr(f"at div {FAN}").alias("up"))
        levels.append(written(groups.applyInPandas(_joined, f"key string, at long, {MATRIX}")))
        most = -(-most // FAN)
    way = levels[-1].mapInPandas(_ends, _WAY)
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.expr(f"at div {FAN}"))
        together = below.join(way.withColumnRenamed("at", "up"), ["key", "up"]).groupBy("key", "up")
        way = written(together.applyInPandas(_routes, _WAY))
    chosen = leaf.join(way, ["key", "at"])
    tail = F.element_at(F.array(*[F.lit(es.TAIL[q]) for q in es.STATES]), F.col("goal") + 1)
    return chosen.select(
        "key", "_part", "block", "_row", "letters", "start",
        F.element_at("audits", 4 * F.col("start") + F.col("goal") + 1).alias("audit"),
        F.when(F.col("last"), tail).otherwise("").alias("tail"),
        "cost",
    )


def _types(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _parts(rows: pd.DataFrame) -> list[tuple[list, list]]:
    return [
        ([None if pd.isna(x) else int(x) for x in c], [int(x) for x in p])
        for c, p in zip(rows["costs"], rows["places"])
    ]


def _joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    costs, places = es.joined(_parts(rows.sort_values("at")))
    return pd.DataFrame({"key": [key[0]], "at": [int(key[1])], "costs": [costs], "places": [places]})


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        found = [es.best_end(*p) for p in _parts(rows)]
        out = rows[["key", "at"]].assign(start=es.START)
        out["goal"], out["cost"], out["last"] = [g for _, g in found], [c for c, _ in found], True
        yield out


def _routes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The states that each part leads from and to; the cost is that of the whole list."""
    rows = rows.sort_values("at")
    way = es.route(_parts(rows), int(rows["start"].iloc[0]), int(rows["goal"].iloc[0]))
    last = [False] * (len(rows) - 1) + [bool(rows["last"].iloc[0])]
    return pd.DataFrame(
        {"key": key[0], "at": rows["at"], "start": way[:-1], "goal": way[1:], "cost": rows["cost"], "last": last}
    )


def _report(placed: DataFrame, blocks: DataFrame, searched: DataFrame, seams: DataFrame | None) -> DataFrame:
    def count(fault: str) -> Column:
        return F.sum(F.length("faults") - F.length(F.replace("faults", F.lit(fault), F.lit("")))).cast("long")

    @F.pandas_udf("long")
    def illegal(letters: pd.Series) -> pd.Series:
        return letters.map(es.illegal).astype("int64")

    own = blocks.withColumn("within", illegal("letters")).groupBy("key").agg(
        *[count(f).alias(n) for f, n in zip("bdt", ("blank", "duplicate", "truncated"))],
        F.sum("within").alias("within"), F.sum("distinct").alias("distinct"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    none = F.lit(0).cast("long")
    if seams is None:
        own = own.withColumns({"shared": none, "broken": none})
    else:
        own = own.join(seams, "key", "left").fillna(0, ["shared", "broken"])
    gaps = F.col("most") - F.col("least") + 1 - (F.col("distinct") - F.col("shared"))
    # One letter per turn.
    parts = F.array_sort(F.collect_list(F.struct("_part", "block", F.concat("audit", "tail").alias("a"))))
    edits = searched.groupBy("key").agg(
        F.array_join(parts["a"], "").alias("audit"), F.first("cost").cast("long").alias("cost")
    )
    ids = placed.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    return ids.join(own, "key").join(edits, "key").select(
        "key", "conv_id", F.coalesce(gaps.cast("long"), none).alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("within") + F.col("broken")).alias("illegal"),
        "cost", "audit",
    )


def _seams(blocks: DataFrame) -> DataFrame:
    """What neighbouring blocks of a conversation have in common: a turn's number counted in both,
    and roles that do not follow each other."""
    before = blocks.select(
        "key", (F.col("at") + 1).alias("at"), F.col("most").alias("before"), F.right("letters", F.lit(1)).alias("last")
    )
    pairs = blocks.select("key", "at", "least", "letters").join(before, ["key", "at"])
    pair = F.concat("last", F.left("letters", F.lit(1)))
    return pairs.groupBy("key").agg(
        F.count_if(F.col("least") == F.col("before")).alias("shared"),
        F.count_if(~pair.isin(*es.LEGAL)).alias("broken"),
    )


def _repaired(placed: DataFrame, searched: DataFrame) -> DataFrame:
    schema = "key string, _part int, _row long, step int, edit string, brought string"

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            names = ("key", "_part", "_row", "letters", "start", "audit", "tail")
            for key, part, first, letters, start, audit, tail in zip(*map(rows.get, names)):
                count: dict[int, int] = {}
                for at, edit, role in es.steps(audit + tail, letters, start):
                    row = min(at, len(letters) - 1)
                    step = count[row] = count.get(row, -1) + 1
                    if edit != "D":
                        out.append((key, part, first + row, step, edit, role))
            yield pd.DataFrame(out, columns=["key", "_part", "_row", "step", "edit", "brought"])

    edits = searched.mapInPandas(unfold, schema)
    said = placed.select("conv_id", "turn", "role", "text", "_part", "_row")
    new = F.col("edit") == "I"
    return edits.join(said, ["_part", "_row"]).select(
        "key", "conv_id", _row_id().alias("place"), "step", "edit",
        F.when(~new, F.col("turn")).alias("turn"),
        F.coalesce("brought", "role").alias("role"),
        F.when(new, "").otherwise(F.col("text")).alias("text"),
    )


def line_digests(repaired: DataFrame) -> DataFrame:
    """``(key, repaired_sha256)``: SHA-256 of the lines ``role:text`` of each conversation.

    A digest is made from beginning to end, so the lines of a conversation pass through one
    task, in order and one batch at a time; only the running hash is held.
    """
    lines = repaired.select("key", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("key").sortWithinPartitions("key", "place", "step").select("key", "line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                if k != key:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(line.encode())
                else:
                    running.update(b"\n" + line.encode())
            yield _digests(done)
        if running:
            yield _digests([(key, running.hexdigest())])

    return ordered.mapInArrow(digest, "key string, repaired_sha256 string")


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = [pa.array([d[i] for d in done], pa.string()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["key", "repaired_sha256"])
