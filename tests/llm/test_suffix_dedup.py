import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dataloupe.llm import suffix_array, suffix_dedup
from llm.conftest import prose


def brute_spans(rows, length=50):
    """Per row the bytes to remove, as a mask."""
    first = {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], key)
    masks = []
    for key, text in rows:
        data = (text or "").encode()
        mask = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if key is not None and first[data[i : i + length]] < key:
                mask[i : i + length] = True
        masks.append(mask)
    return masks


def expected(rows):
    out = []
    for (key, text), mask in zip(rows, brute_spans(rows)):
        data = np.frombuffer((text or "").encode(), np.uint8)
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((key, data[~mask].tobytes(), int(mask.sum()), runs))
    return out


def found(docs, **options):
    cut = suffix_dedup.with_cut(docs, suffix_dedup.shared_spans(docs, **options))
    return [(r.doc_id, bytes(r.kept.kept), r.kept.n_removed, r.kept.n_spans) for r in cut.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.fixture
def small_tasks(monkeypatch):
    """Many buckets and bins, and frequent anchors from three documents on."""
    for name, value in (("DETECT_BYTES", 4000), ("SORT_BYTES", 2000), ("LEAST_HOT", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)


def test_equals_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert order(found(corpus)) == order(expected(rows))


def test_equals_brute_force_in_many_buckets_with_frequent_anchors(spark, corpus, small_tasks):
    line = "This line stands at the end of a third of all pages of the web. " * 2
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    rows += [(1000 - i, prose(1000 + i, 10) + " " + line + prose(2000 + i, 9)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert order(found(docs)) == order(expected(rows))


def test_repeats_inside_one_text_and_periodic_texts(spark, small_tasks):
    rows = [
        (5, "ab" * 300), (2, "ab" * 40), (9, "ab" * 100 + "c"), (1, "x" * 49), (3, "x" * 50),
        (4, "x" * 51), (7, "y" * 50), (6, "z" * 120 + "y" * 60),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert order(found(docs)) == order(expected(rows))


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    text = prose(1, 1500)
    rows = [(1, text), (2, prose(2, 300) + text[4000:7000] + prose(3, 300)), (3, text + text[:900])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(found(docs)) == order(expected(rows))


def test_other_lengths(spark):
    rows = [(1, prose(1, 60)), (2, prose(2, 20) + prose(1, 60)[100:125] + prose(3, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = suffix_dedup.shared_spans(docs, length=24)
    assert [r.doc_id for r in spans.collect()] == [2]
    with pytest.raises(ValueError):
        suffix_dedup.shared_spans(docs, length=10)
    with pytest.raises(TypeError):
        suffix_dedup.shared_spans(docs.selectExpr("string(doc_id) doc_id", "text"))


def test_empty_and_clashing(corpus, empty, clashing):
    assert found(empty) == []
    cut = suffix_dedup.with_cut(clashing, suffix_dedup.shared_spans(clashing))
    assert cut.count() == clashing.count() and len(cut.columns) == len(clashing.columns)
    assert cut.agg({"kept.n_removed": "sum"}).first()[0] > 0


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "".join(map(chr, range(40, 120)))])
def test_windows_are_sorted(alphabet):
    random_ = random.Random(len(alphabet))
    for _ in range(40):
        text = "".join(random_.choices(alphabet, k=random_.randint(1, 250))).encode()
        data = np.frombuffer(text + b"\xff" * (suffix_array.MARGIN + 50), np.uint8)
        wanted = np.sort(random_.sample(range(len(text)), random_.randint(1, len(text))))
        result = suffix_array.sort_windows(data, np.asarray(wanted), 50)
        windows = [data[i : i + 50].tobytes() for i in result]
        assert windows == sorted(windows) and sorted(result) == list(wanted)
        same = suffix_array.same_as_before(data, result, 50).tolist()
        assert same == [False] + [a == b for a, b in zip(windows, windows[1:])]


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    random_ = random.Random(8)
    texts = ["".join(random_.choices("ab ", k=random_.randint(0, 300))).encode() for _ in range(25)]
    owner, of_window, anchor = suffix_dedup.anchors(texts, 50), {}, {}
    for text, start, count, value in zip(*(c.tolist() for c in owner)):
        for i in range(start, start + count):
            assert of_window.setdefault((text, i), value) is value
            assert anchor.setdefault(texts[text][i : i + 50], value) == value
    assert len(of_window) == sum(max(0, len(t) - 49) for t in texts)


def test_a_large_bin_is_sorted_in_portions(monkeypatch):
    """Windows of frequent anchors stand alone, so that one bin can get many times its share."""
    text = "".join(random.Random(4).choices("abcdefgh", k=6000)).encode()
    keys, texts = np.asarray([3, 5, 8]), [text[:4000], text[1000:], text]
    prints = [suffix_dedup._text_hash(t) for t in texts]
    owner = np.repeat(np.arange(3), [len(t) - 49 for t in texts])
    start = np.concatenate([np.arange(len(t) - 49) for t in texts])
    alone = np.ones(len(owner), bool)
    batches = [
        suffix_dedup._window_rows(
            keys, texts, prints, owner[m], start[m], alone[m].astype(int), owner[m], alone[m], 50, 1, []
        )
        for m in (owner == i for i in range(3))
    ]
    rows = pa.Table.from_batches(batches).to_pandas()

    def spans():
        frame = suffix_dedup._sorted_spans(50)(rows)
        return [
            (key, np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist())
            for key, a, b in zip(frame["key"], frame["starts"], frame["ends"])
        ]

    assert spans() == [(5, [0], [3000]), (8, [0], [6000])]
    sort, sorted_at_once = suffix_dedup.sort_windows, []

    def counted(data, wanted, depth):
        sorted_at_once.append(len(data))
        return sort(data, wanted, depth)

    monkeypatch.setattr(suffix_dedup, "sort_windows", counted)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 100_000)
    assert spans() == [(5, [0], [3000]), (8, [0], [6000])]
    assert len(sorted_at_once) > 3 and max(sorted_at_once) < 150_000 < rows["size"].sum()


@pytest.mark.parametrize("size", [60_000, 50])
def test_sorting_takes_little_memory_beside_its_text(size):
    """A frequent passage makes nearly all windows of a bin repeats, in long stretches or one by one."""
    text = "".join(random.Random(5).choices("abcdefgh", k=60_000)).encode()
    starts = np.arange(0, 1_000_000, size) % len(text)
    keys = np.arange(len(starts))
    data = np.frombuffer(b"".join([text[a : a + size] for a in starts.tolist()]), np.uint8)
    sizes = np.full(len(starts), size)
    tracemalloc.start()
    found = suffix_dedup._repeated([keys, keys, starts, sizes], data, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    again = np.arange(len(text) // size, len(starts))
    assert found[0].tolist() == keys[again].tolist()
    assert found[2].tolist() == starts[again].tolist() and set(found[3] - found[2]) == {size}
    assert peak < 25 * len(data)


def test_spans_of_stretches_are_those_of_their_windows():
    """Windows that touch or overlap are one span, across stretches of one text as well."""
    random_ = random.Random(6)
    for _ in range(30):
        text = "".join(random_.choices("ab", k=400)).encode()
        sizes = [random_.randint(20, 90) for _ in range(12)]
        entries = [(random_.randint(0, 3), random_.randint(0, 300), n) for n in sizes]
        stretches = [text[a : a + n] for _, a, n in entries]
        first, masks = {}, {}
        for (key, _, _), s in zip(entries, stretches):
            for i in range(len(s) - 19):
                first[s[i : i + 20]] = min(key, first.get(s[i : i + 20], key))
        for (key, a, _), s in zip(entries, stretches):
            for i in range(len(s) - 19):
                if first[s[i : i + 20]] < key:
                    masks.setdefault(key, np.zeros(500, int))[a + i : a + i + 20] = 1
        wanted = []
        for key in sorted(masks):
            edges = np.diff(np.concatenate([[0], masks[key], [0]]))
            wanted += [(key, a, b) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]
        keys, starts, sizes = (np.asarray(c, np.int64) for c in zip(*entries))
        sizes = np.asarray([len(s) for s in stretches])
        data = np.frombuffer(b"".join(stretches), np.uint8)
        found = suffix_dedup._repeated([keys, keys, starts, sizes], data, 20)
        assert list(zip(*(found[i].tolist() for i in (0, 2, 3)))) == wanted


def test_a_filter_on_the_cut_texts_does_not_cut_them_twice(corpus):
    cut = suffix_dedup.with_cut(corpus, suffix_dedup.shared_spans(corpus)).where("kept.n_removed > 0")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [apply(") == 1
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    wanted = order(r for r in expected(rows) if r[2])
    assert order((r.doc_id, bytes(r.kept.kept), r.kept.n_removed, r.kept.n_spans) for r in cut.collect()) == wanted
