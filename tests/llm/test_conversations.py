"""Conversation repair beside its SQL and a search without bounds."""

import random

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from dataloupe.llm import conversation_repair, edit_search as es
from dataloupe.llm.oracles import SQL
from dataloupe.llm.queries import QUERIES

NAME = "op11_conversation_repair"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(letters, faults):
    """The least (cost, edits) over all edits, by dynamic programming from the end."""
    brought, tails = es.BROUGHT, {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    after = tails
    for letter, fault in zip(reversed(letters), reversed(faults)):
        now = {}
        for first in es.STATES:
            ways, state, inserts = [], first, ""
            for _ in range(5):
                cost, rest = after[state]
                ways.append((2 * len(inserts) + cost + 3, f"{inserts}D{rest}"))
                if fault in "-t":
                    extra = int(fault == "t")
                    cost, rest = after[brought[state]]
                    ways.append((2 * len(inserts) + cost + 2 + extra, f"{inserts}R{rest}"))
                    if letter in es.FOLLOWS[state]:
                        cost, rest = after[es.STATE_OF[letter]]
                        ways.append((2 * len(inserts) + cost + extra, f"{inserts}K{rest}"))
                state, inserts = brought[state], inserts + "I"
            now[first] = min(ways)
        after = now
    return after[es.START]


def turns(seed, most=10):
    r = random.Random(seed)
    n = r.randint(0, most)
    kinds = "suax" if seed % 3 == 0 else "ua"
    return "".join(r.choices(kinds, k=n)), "".join(r.choices("---bdt", k=n))


def test_search_finds_the_least_edits():
    for seed in range(1500):
        letters, faults = turns(seed)
        assert es.whole(letters, faults) == brute(letters, faults), (letters, faults)


def test_blocks_give_the_edits_of_the_whole():
    for seed in range(600):
        letters, faults = turns(seed, 14)
        r = random.Random(seed)
        if len(letters) < 3:
            continue
        cuts = sorted(r.sample(range(1, len(letters)), 2))
        ends = list(zip([0, *cuts], [*cuts, len(letters)]))
        found = [es.block(letters[a:b], faults[a:b]) for a, b in ends]
        parts = [([x and x[0] for x in f], es.ranks(f)) for f in found]
        costs, places = es.joined([parts[0], es.joined(parts[1:])])
        cost, goal = es.best_end(costs, places)
        first, middle, _ = es.route([parts[0], es.joined(parts[1:])], es.START, goal)
        way = [first, *es.route(parts[1:], middle, goal)]
        edits = "".join(f[4 * a + b][1] for f, a, b in zip(found, way, way[1:])) + es.TAIL[goal]
        assert (cost, edits) == es.whole(letters, faults)


def conversation(conv, n, seed):
    r = random.Random(seed)
    said = ["Yes.", "no", "Well!", "Is it?  ", "And then\n", "  ", "a. b. c", "日本語。", "x" * 500 + "."]
    roles = ["user", "assistant"]
    out = []
    for i in range(n):
        role = roles[i % 2] if r.random() < 0.8 else r.choice(["system", "user", "tool", "", "assistant"])
        out.append((conv, i + (i > n // 2), role, f"{r.choice(said)}" if r.random() < 0.4 else f"line {i}."))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [row for c in range(60) for row in conversation(c, c % 9 + 1, c)]
    out += conversation(100, 700, 5)  # a third of all rows in several blocks
    out += conversation(None, 40, 6)
    out += [(101, None, "user", "a."), (101, None, "assistant", None), (101, 3, None, "b."), (101, 3, None, "b.")]
    out += [(102, None, None, None), (103, 7, "user", "Same."), (103, 7, "user", "Same."), (103, 7, "assistant", "")]
    out += [(104, 5, "assistant", "x" * 300_000), (104, -4, "system", "y.")]
    out += conversation(3, 4, 3)  # repeated rows
    return out


def write(spark, rows, path, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(v) for n, v in more.items()})
    df.repartition(4).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def differences(spark, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    return oracle.compare(QUERIES[NAME](spark, path), con, SQL[NAME])


def test_query_equals_sql(spark, rows, tmp_path):
    path = write(spark, rows, tmp_path, key="mine", _part=1, fault="b", letters="s", digest="x", _copy=3)
    assert differences(spark, path) == []


def test_query_on_an_empty_table(spark, tmp_path):
    assert differences(spark, write(spark, [], tmp_path)) == []


def test_small_blocks_and_levels_give_the_same(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", 3)
    monkeypatch.setattr(conversation_repair, "FAN", 4)
    assert differences(spark, write(spark, rows, tmp_path)) == []


def test_repaired_turns_alternate_and_keep_what_is_sound(spark):
    good = [(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "assistant", "A.")]
    bad = [(2, 0, "user", "U."), (2, 1, "user", ""), (2, 2, "assistant", "A.")]
    report, repaired = conversation_repair.repair_conversations(spark.createDataFrame(good + bad, SCHEMA))
    told = {r.conv_id: (r.cost, r.audit) for r in report.collect()}
    assert told == {1: (0, "KKK"), 2: (3, "KDK")}
    lines = [(r.conv_id, r.turn, r.role, r.text) for r in repaired.orderBy("conv_id", "place", "step").collect()]
    assert lines == [*good, bad[0], bad[2]]
