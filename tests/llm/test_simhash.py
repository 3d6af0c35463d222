import re

import pytest
import xxhash

from dataloupe.llm import graph, simhash
from llm.conftest import prose


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_groups_equal_brute_force(corpus):
    rows = [r for r in corpus.collect() if r.doc_id is not None]
    rows.sort(key=lambda r: r.doc_id)
    prints = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(prints, 2)
    want = sorted((r.doc_id, f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, roots))
    groups = simhash.simhash_groups(corpus)
    named = groups.withColumn("fingerprint", simhash.hexadecimal(groups["fingerprint"]))
    got = sorted(tuple(r) for r in named.collect() if r.doc_id is not None)
    assert got == want


def test_every_pair_within_the_radius_is_connected(spark):
    import random

    random_ = random.Random(4)
    base = [random_.getrandbits(64) for _ in range(20)]
    values = set(base)
    for b in base:
        for _ in range(12):  # a chain of small steps around each
            b ^= 1 << random_.randrange(64)
            b ^= 1 << random_.randrange(64) if random_.random() < 0.5 else 0
            values.add(b)
    ordered = sorted(values)
    roots = brute_components(ordered, 2)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in ordered]
    prints = spark.createDataFrame(signed, "f long")
    links = simhash.near_fingerprints(prints, "f", 2)
    for a, b in links.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    found = dict(graph.components(links, "a", "b").collect())
    by_root, by_component = {}, {}
    for (v,), r in zip(signed, roots):
        by_root.setdefault(r, set()).add(v)
        by_component.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_component.values()))


@pytest.mark.parametrize("radius", [2, 4])
def test_some_mask_keeps_no_differing_bit(radius):
    import itertools

    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.islice(itertools.combinations(range(64), radius), 0, None, 97):
        changed = sum(1 << b for b in bits)
        assert any(not changed & m for m in masks)


def test_odd_radius_is_rejected(spark):
    with pytest.raises(ValueError):
        simhash.near_fingerprints(spark.createDataFrame([(1,)], "f long"), "f", 3)


def test_empty_and_null_rows(corpus, empty):
    assert simhash.simhash_groups(empty).count() == 0
    groups = simhash.simhash_groups(corpus)
    assert groups.count() == corpus.count()
    kept = simhash.first_of_groups(corpus, groups)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}


def test_clashing_columns(clashing):
    assert simhash.simhash_groups(clashing).count() == clashing.count()
    assert dict(simhash.with_fingerprint(clashing).dtypes)["fingerprint"] == "bigint"


def test_components_of_chains_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert found == {**{i: 1 for i in range(1, 41)}, 200: 200, 201: 200}


def test_one_row_of_each_group_with_repeated_and_missing_ids(spark):
    a, b, c = (prose(i, 60) for i in (901, 902, 903))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (None, c), (None, c), (5, None), (6, ""), (7, b + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' AS mark", "'x' AS f")
    kept = sorted(map(str, ((r.doc_id, r.text) for r in simhash.one_of_each_group(docs).collect())))
    assert kept == sorted(map(str, [(1, a), (1, b), (None, c), (5, None)]))
    assert simhash.one_of_each_group(docs).columns == docs.columns
    assert simhash.one_of_each_group(docs.where("false")).count() == 0
