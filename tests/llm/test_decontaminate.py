import random

import numpy as np
import pytest

from dataloupe.llm import decontaminate
from dataloupe.llm.words import words
from llm.conftest import prose


def brute_tiles(item, text, least):
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while (
                    i + n < len(item) and t + n < len(text) and free_item[i + n]
                    and free_text[t + n] and item[i + n] == text[t + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, t, n)
        if best is None:
            return sorted(out)
        i, t, n = best
        out.append(best)
        free_item[i : i + n] = free_text[t : t + n] = [False] * n


@pytest.mark.parametrize("vocabulary", [2, 4, 9])
def test_tiles_cover_what_greedy_tiling_covers(vocabulary):
    random_ = random.Random(vocabulary)
    for _ in range(150):
        item = [random_.randrange(vocabulary) for _ in range(random_.randint(3, 22))]
        text = [random_.randrange(vocabulary) for _ in range(random_.randint(3, 35))]
        cut = random_.randrange(len(item))
        if random_.random() < 0.5:
            text = text[:9] + item[cut:] + text[9:14] + item[:cut] + text[14:]
        arrays = np.array(item, np.uint64), np.array(text, np.uint64)
        got = decontaminate.tiles(*arrays, [(0, len(text))], 3)
        want = brute_tiles(item, text, 3)
        assert sum(n for *_, n in got) == sum(n for *_, n in want)
        for i, t, n in got:
            assert item[i : i + n] == text[t : t + n]


def brute_matches(docs, items, threshold=0.8, seed=5):
    out = []
    for key, text in docs:
        for item_key, item_text in items:
            item, mine = words(item_text), words(text)
            least = min(seed, len(item))
            if least:
                covered = sum(n for *_, n in brute_tiles(item, mine, least))
                if covered >= threshold * len(item):
                    out.append((key, item_key, len(item), covered))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark):
    first, second = prose(50, 30).replace("ß", ""), prose(51, 24)
    items = [(1, first), (2, second), (3, "Just three words"), (4, ""), (5, None), (None, prose(52, 18)), (2, second)]
    w = second.split()
    texts = [
        prose(1, 40) + " " + first + ". " + prose(2, 30),
        prose(3, 9) + " " + " ".join(w[12:]) + " " + prose(4, 9) + " " + " ".join(w[:12]),  # reordered
        " ".join(w[:10]) + " " + prose(5, 30),  # less than half
        first.replace("ß", "").upper().replace(" ", "\n") + " " + second,
        "so, JUST three -- words!", prose(6, 50), prose(52, 18), "", None,
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, first)]
    return (
        docs, items, spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("block", [16 << 20, 100])
def test_matches_equal_brute_force(benchmark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items, doc_frame, item_frame = benchmark
    rows = decontaminate.benchmark_matches(doc_frame, item_frame).collect()
    got = sorted(((r.doc_id, r.item_id, r.item_words, r.covered_words) for r in rows), key=repr)
    assert got == brute_matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} >= {(0, 1), (1, 2), (3, 1), (3, 2), (4, 3), (6, None)}
    for r in rows:
        assert r.coverage == r.covered_words / r.item_words
        assert sum(t.length for t in r.tiles) == r.covered_words


def test_without_benchmark(benchmark):
    _, _, docs, items = benchmark
    clean = decontaminate.without_benchmark(docs, decontaminate.benchmark_matches(docs, items))
    assert sorted(r.doc_id for r in clean.collect()) == [2, 5, 7, 8]


def test_empty_sides_and_clashing_columns(benchmark, clashing):
    _, _, docs, items = benchmark
    for a, b in ((docs.where("false"), items), (docs, items.where("false"))):
        assert decontaminate.benchmark_matches(a, b).count() == 0
    matches = decontaminate.benchmark_matches(clashing, items)
    assert decontaminate.without_benchmark(clashing, matches).columns == clashing.columns
