import numpy as np
import pytest

from dataloupe.llm import nn_descent

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.93):
    """Links and smallest reachable key of each row."""
    usable = {}
    for i, (key, x, label) in enumerate(rows):
        whole = x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x)
        if key is not None and label is not None and whole and any(x):
            usable[i] = np.asarray(x, float) / np.linalg.norm(np.asarray(x, float))
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in usable:
        for j in usable:
            same = rows[i][2] == rows[j][2] and len(usable[i]) == len(usable[j])
            if i < j and same and usable[i] @ usable[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min(k) if None not in k else None for r, k in groups.items()}
    return sorted(((rows[i][0], links[i], least[root(i)]) for i in range(len(rows))), key=repr)


def noisy(random_, centre, size):
    return [(centre + random_.normal(size=len(centre)) * size).tolist() for _ in range(1)][0]


@pytest.fixture(scope="module")
def rows():
    random_ = np.random.default_rng(5)
    out = [(i, random_.normal(size=16).tolist(), i % 3) for i in range(200)]
    centre = random_.normal(size=16)
    out += [(1000 + i, noisy(random_, centre, 0.05), 1) for i in range(70)]  # a saturated group
    out += [(2000 + i, noisy(random_, np.asarray(out[i][1]), 0.1), i % 3) for i in range(30)]
    out += [(3000 + i, out[0][1], 0) for i in range(25)]  # copies
    out += [(4000, out[0][1], 1), (4001, [2 * v for v in out[1][1]], 1), (4002, out[2][1][:8], 2)]
    out += [
        (5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [NAN] * 16, 1),
        (5004, [INF] + [1.0] * 15, 1), (5005, [None] + [1.0] * 15, 1), (5006, out[1][1], None),
        (None, out[1][1], 1), (7, out[7][1], 1),
    ]
    return out


def test_equals_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    settings = nn_descent.Settings(neighbours=6, crowd=24, block=32)
    found, recall = nn_descent.near_vectors(frame, settings=settings)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
    assert recall == 1.0


def test_audit_sees_missing_links(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blind = nn_descent.Settings(neighbours=6, tables=1, crowd=2, rounds=0, repairs=0, walk=0.9)
    found, recall = nn_descent.near_vectors(frame, settings=blind)
    truth = {k: n for k, n, _ in brute(rows)}
    assert all(r.n_links <= truth[r.vec_id] for r in found.collect() if r.vec_id != 7)
    assert recall < 1


def test_rounds_find_what_the_start_missed(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    weak = dict(neighbours=8, tables=2, crowd=8, repairs=0, walk=0.0)
    start = nn_descent.near_vectors(frame, settings=nn_descent.Settings(rounds=0, **weak))[1]
    after = nn_descent.near_vectors(frame, settings=nn_descent.Settings(rounds=6, **weak))[1]
    assert after >= start and after > 0.9


def test_empty_and_clashing_columns(spark, rows):
    frame = spark.createDataFrame(rows[:40], "vec_id long, embedding array<float>, label int")
    assert nn_descent.near_vectors(frame.where("false"))[0].count() == 0
    names = ("key", "x", "id", "n", "component_id", "n_links", "place")
    more = frame.selectExpr("*", *[f"'mine' AS {n}" for n in names])
    assert nn_descent.near_vectors(more)[0].columns == ["vec_id", "n_links", "component_id"]
    only_bad = frame.selectExpr("vec_id", "CAST(NULL AS array<float>) embedding", "label")
    assert {r.n_links for r in nn_descent.near_vectors(only_bad)[0].collect()} == {0}


def test_groups_whose_links_are_beyond_full_lists(spark):
    """Every vector has more near ones in its own group than its list holds; groups are linked
    in a chain, and the last one stays apart."""
    random_ = np.random.default_rng(8)
    centres = np.linalg.qr(random_.normal(size=(64, 4)))[0].T
    angle = np.arccos(0.945)
    turned = [
        np.cos(i * angle) * centres[0] + np.sin(i * angle) * centres[1] for i in range(3)
    ] + [centres[2]]
    rows = [
        (100 * i + j, noisy(random_, c, 0.005), 1) for i, c in enumerate(turned) for j in range(30)
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, recall = nn_descent.near_vectors(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert recall == 1.0 and {c for _, _, c in brute(rows)} == {0, 300}


def test_scattered_pairs_are_found_at_every_size(spark):
    """Isolated pairs of a label of 2^11 crowds; the start alone finds what it finds in small
    labels, and far neighbours are walked too."""
    assert nn_descent.Settings().walk <= -1
    settings = nn_descent.Settings()
    few = 1 - (1 - 0.88**7) ** 8
    for bits in range(41):
        tables = nn_descent.tables_for(bits, 0.93, settings)
        assert 1 - (1 - 0.88**bits) ** tables > few - 0.01
    random_ = np.random.default_rng(3)
    rows = random_.normal(size=(6000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for i in range(0, 800, 2):  # cosine 0.935 to the row before
        off = rows[i + 1] - (rows[i + 1] @ rows[i]) * rows[i]
        rows[i + 1] = 0.935 * rows[i] + (1 - 0.935**2) ** 0.5 * off / np.linalg.norm(off)
    frame = spark.createDataFrame(
        [(i, r.tolist(), 1) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int"
    )
    start = nn_descent.Settings(neighbours=6, crowd=3, rounds=0, repairs=0)
    got = nn_descent.near_vectors(frame, settings=start)[0]
    assert got.where("n_links > 0 AND vec_id < 800").count() / 800 > 0.96


def test_audit_goes_on_until_it_has_seen_links(spark):
    """Few nodes have a link, and a blind search loses most of these."""
    random_ = np.random.default_rng(4)
    rows = [(i, random_.normal(size=16).tolist(), 1) for i in range(600)]
    rows += [(9000 + i, noisy(random_, np.asarray(rows[i][1]), 0.25), 1) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blind = dict(neighbours=6, tables=1, crowd=2, rounds=0, repairs=0)
    found, recall = nn_descent.near_vectors(frame, settings=nn_descent.Settings(**blind))
    got = found.selectExpr("sum(n_links)").first()[0]
    true = sum(n for _, n, _ in brute(rows))
    assert 0 <= got < true and recall == got / true


def test_query_refuses_a_low_recall(spark, monkeypatch):
    from dataloupe.llm import queries

    frame = spark.createDataFrame([(1, 0, 1)], "vec_id long, n_links long, component_id long")
    monkeypatch.setattr(nn_descent, "near_vectors", lambda vectors: (frame, 0.5))
    with pytest.raises(RuntimeError, match="0.500"):
        queries.op3_embedding_near_dedup(spark, "/root/testdata/sf0.001")
