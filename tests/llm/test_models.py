from dataclasses import replace
from zlib import crc32

import numpy as np
import pyspark.sql.functions as F
import pytest

from dataloupe.llm import pseudo_likelihood, toxicity
from dataloupe.llm.words import hashes_of_texts, word_hashes, words
from llm.conftest import DATA, ODD_TEXTS, prose

SMALL = pseudo_likelihood.Settings(
    inputs=257, width=4, hidden=8, frequent=12, hashed=4, buckets=256, stride=1, batch=64
)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")


def test_held_out_accuracy(spark, documents):
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    scored = toxicity.with_toxicity(documents, model).join(labels, "doc_id")
    rows = scored.where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = np.mean([(r.toxicity >= 0.5) == (r.toxic == 1) for r in rows])
    caught = np.mean([r.toxicity >= 0.5 for r in rows if r.toxic == 1])
    wrong = np.mean([r.toxicity >= 0.5 for r in rows if r.toxic == 0])
    assert right > 0.96 and caught > 0.75 and wrong < 0.01
    assert len(model.index) < 2000  # L1 leaves few weights


def test_held_out_labels_are_not_used(spark, documents):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels).key() == toxicity.fit_toxicity(docs, turned).key()


def test_ftrl_equals_the_plain_update():
    settings = toxicity.Settings(bits=6, l1=0.3, l2=0.5, alpha=0.4, epochs=2)
    texts, labels = [prose(i, 12) for i in range(30)], [i % 3 == 0 for i in range(30)]
    model = toxicity.train(texts, labels, settings)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        l1, l2 = (0, 0) if i == 64 else (settings.l1, settings.l2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((settings.beta + n[i] ** 0.5) / settings.alpha + l2)

    for _ in range(settings.epochs):
        for text, label in zip(texts, labels):
            active = [*toxicity.features(text, settings), 64]
            ws = {i: weight(i) for i in active}
            g = 1 / (1 + np.exp(-sum(ws.values()))) - label
            for i in active:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / settings.alpha
                z[i] += g - sigma * ws[i]
                n[i] += g * g
    assert np.allclose(model.dense(), [weight(i) for i in range(64)])
    assert abs(model.bias - weight(64)) < 1e-9


def test_toxicity_of_odd_tables(spark, corpus, empty, clashing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 7), (999, 1)], "doc_id long, toxic int"
    )
    for docs in (corpus, empty, clashing):
        for marked in (labels, labels.where("false")):
            scored = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, marked))
            rows = scored.collect()
            assert len(rows) == docs.count()
            assert all(0 <= r.toxicity <= 1 for r in rows)
    model = toxicity.fit_toxicity(corpus, labels.where("false"))
    assert {r.toxicity for r in toxicity.with_toxicity(corpus, model).collect()} == {0.5}


def test_training_rows_are_bounded(spark, corpus):
    repeated = corpus.where("doc_id = 2").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i"), "text")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(repeated, labels, most_rows=3).bias > 0


def test_vocabulary_counts_everything(corpus):
    found = pseudo_likelihood.count_words(corpus, "text", SMALL)
    hashes = np.concatenate([word_hashes(words(r.text)) for r in corpus.collect()])
    distinct, n = np.unique(hashes, return_counts=True)
    top = distinct[np.lexsort((distinct, -n))[: SMALL.frequent]]
    assert np.frombuffer(found.top, np.uint64).tolist() == sorted(top.tolist())
    rest = ~np.isin(distinct, top)
    sums = np.bincount(
        pseudo_likelihood.buckets(distinct[rest], SMALL), n[rest], SMALL.buckets
    )
    assert np.frombuffer(found.bucket_counts, np.int64).tolist() == sums.astype(int).tolist()


def test_probabilities_sum_to_one(corpus):
    model = pseudo_likelihood.fit_language_model(corpus, settings=SMALL)
    top, inside = model.vocabulary.tables
    kinds = np.arange(SMALL.buckets) % SMALL.hashed
    assert np.allclose(np.bincount(kinds, np.exp(inside)), 1)
    rows = pseudo_likelihood.contexts(word_hashes(words(prose(1, 9))), SMALL)
    assert np.allclose(np.exp(model.network.log_softmax(rows)[0]).sum(axis=1), 1, atol=1e-5)


def test_score_equals_word_by_word(corpus):
    model = pseudo_likelihood.fit_language_model(corpus, settings=SMALL)
    embedding, inner, inner_bias, outer, outer_bias = (p.astype(float) for p in model.network.parts)
    for r in pseudo_likelihood.with_pseudo_likelihood(corpus, model).collect()[:25]:
        hashes = word_hashes(words(r.text))
        rows, (kinds, inside) = pseudo_likelihood.contexts(hashes, SMALL), model.vocabulary.targets(hashes)
        total = 0.0
        for row, kind, share in zip(rows, kinds, inside):
            hidden = np.tanh(embedding[row].reshape(-1) @ inner + inner_bias)
            logits = hidden @ outer + outer_bias
            total += logits[kind] - np.log(np.exp(logits).sum()) + share
        assert r.n_words == len(hashes)
        assert abs(r.log_likelihood - total) < 1e-3 * max(1, abs(total))


def test_contexts_hide_the_word_itself():
    hashes = word_hashes(words("a b c d e f g"))
    other = hashes.copy()
    other[3] = 12345
    settings = pseudo_likelihood.Settings()
    a, b = (pseudo_likelihood.contexts(h, settings) for h in (hashes, other))
    assert (a[3] == b[3]).all() and (a[2] != b[2]).any()


def test_training_learns_order(spark):
    """Words that follow a fixed cycle are far likelier in order than shuffled."""
    cycle = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(cycle[(i + j) % 8] for j in range(200))) for i in range(60)]
    settings = pseudo_likelihood.Settings(
        inputs=257, width=8, hidden=16, frequent=16, hashed=4, buckets=256, stride=2, batch=64, rounds=3
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = pseudo_likelihood.fit_language_model(docs, settings=settings)
    shuffled = list(np.random.default_rng(1).permutation(rows[0][1].split()))
    both = spark.createDataFrame([(0, rows[0][1]), (1, " ".join(shuffled))], "doc_id long, text string")
    scores = {r.doc_id: r.log_likelihood for r in pseudo_likelihood.with_pseudo_likelihood(both, model).collect()}
    assert scores[0] > -0.5 * 200 > scores[1]


def test_gradient_is_right():
    network = pseudo_likelihood.Network(SMALL)
    rows = np.random.default_rng(2).integers(0, SMALL.inputs, (10, 4))
    kinds = np.random.default_rng(3).integers(0, SMALL.classes, 10)

    def loss(flat):
        moved = pseudo_likelihood.Network(SMALL, flat)
        return -moved.log_softmax(rows)[0][np.arange(10), kinds].mean(dtype=np.float64)

    before, squares = network.flat.copy(), np.zeros(len(network.flat), np.float32)
    network.train(rows, kinds, squares)
    gradient = np.sqrt(squares) * np.sign(before - network.flat)
    for i in np.argsort(-squares)[:20]:
        step = np.zeros(len(before), np.float32)
        step[i] = 1e-2
        slope = (loss(before + step) - loss(before - step)) / 2e-2
        assert abs(slope - gradient[i]) < 2e-2 * max(0.05, abs(slope))


def test_scores_of_odd_tables(corpus, empty, clashing):
    for docs in (corpus, empty, clashing):
        model = pseudo_likelihood.fit_language_model(docs, settings=SMALL)
        scored = pseudo_likelihood.with_pseudo_likelihood(docs, model)
        rows = scored.collect()
        assert len(rows) == docs.count()
        assert all(r.log_likelihood <= 0 and r.n_words >= 0 for r in rows)
        assert all(r.log_likelihood == 0 for r in rows if not r.n_words)


def test_every_word_is_a_target_once():
    settings = pseudo_likelihood.Settings()
    for seed in range(40):
        hashes = word_hashes(words(prose(seed, seed)))
        rounds = [pseudo_likelihood.targets_of_round(hashes, t, settings) for t in range(settings.rounds)]
        assert sorted(np.concatenate(rounds).tolist()) == list(range(len(hashes)))
    with pytest.raises(ValueError):
        pseudo_likelihood.Settings(rounds=2, stride=16)


def test_words_of_many_texts_are_hashed_together():
    texts = [*ODD_TEXTS, *(prose(i, 40) for i in range(30)), "ΟΔΟΣ", "Σ", "a" * 23 + " " + "b" * 24 + " " + "c" * 25]
    hashes, counts = hashes_of_texts(texts)
    each = [word_hashes(words(t)) for t in texts]
    assert counts.tolist() == [len(h) for h in each]
    assert hashes.tolist() == np.concatenate(each).tolist() and hashes.dtype == each[0].dtype
    for none in ([], [None], ["", "-"]):
        hashes, counts = hashes_of_texts(none)
        assert len(hashes) == 0 and counts.tolist() == [0] * len(none)


def test_no_window_reaches_another_text():
    settings = pseudo_likelihood.Settings()
    hashes, counts = hashes_of_texts(["a b c", "", "d", None, "e f", "g h i j k"])
    ends = np.cumsum(counts)
    each = [pseudo_likelihood.contexts(hashes[b - n : b], settings) for b, n in zip(ends, counts)]
    together = pseudo_likelihood.contexts(hashes, settings, counts)
    assert together.tolist() == np.concatenate(each).tolist()
    assert pseudo_likelihood.contexts(hashes, settings, counts, np.asarray([1, 4])).tolist() == together[[1, 4]].tolist()


def test_large_logits_are_scored():
    network = pseudo_likelihood.Network(SMALL)
    hashes, counts = hashes_of_texts([prose(1, 30)])
    empty = pseudo_likelihood.Vocabulary(SMALL, b"", np.zeros(SMALL.buckets, np.int64).tobytes())
    assert network.bounded()
    before = network.scores(hashes, counts, empty)
    network.parts[-1][:] += 1000  # the same for each class, which changes no probability
    assert not network.bounded()
    assert np.allclose(network.scores(hashes, counts, empty), before, atol=1e-3)


def test_training_steps_keep_their_memory():
    """A step after the first one asks for no second array of logits or of looked-up embeddings."""
    settings = pseudo_likelihood.Settings()
    network, random = pseudo_likelihood.Network(settings), np.random.default_rng(4)
    squares = np.full(len(network.flat), 1e-4, np.float32)
    rows = random.integers(0, settings.inputs, (2, settings.batch, 2 * settings.window))
    kinds = random.integers(0, settings.classes, (2, settings.batch))
    network.train(rows[0], kinds[0], squares)
    kept = {name: held.ctypes.data for name, held in network.rooms.items()}
    network.train(rows[1], kinds[1], squares)
    assert {name: held.ctypes.data for name, held in network.rooms.items()} == kept
    assert {"logits", "seen"} <= set(kept)


@pytest.mark.parametrize("width", [3, 4])
def test_embedding_gradients_are_summed_by_place(width):
    settings = replace(SMALL, width=width)
    random = np.random.default_rng(5)
    places = np.minimum(random.integers(0, 400, 300), settings.inputs - 1)  # many are equal
    into = random.normal(size=(300, width)).astype(np.float32)
    touched, found = pseudo_likelihood.Network(settings).of_embeddings(places, into)
    expected = np.zeros((settings.inputs, width))
    np.add.at(expected, places, into)
    assert touched.tolist() == sorted(set(places.tolist()))
    assert np.allclose(found, expected[touched], atol=1e-4)


def test_blocks_do_not_change_a_step_or_scores(monkeypatch):
    random = np.random.default_rng(6)
    rows, kinds = random.integers(0, SMALL.inputs, (50, 4)), random.integers(0, SMALL.classes, 50)
    hashes, counts = hashes_of_texts([prose(2, 40), "", prose(3, 25)])
    plain = pseudo_likelihood.Vocabulary(SMALL, b"", np.zeros(SMALL.buckets, np.int64).tobytes())
    found = []
    for block in (1024, 50, 7):
        monkeypatch.setattr(pseudo_likelihood, "BLOCK", block)
        network = pseudo_likelihood.Network(SMALL)
        for n in (50, 20, 50):
            network.train(rows[:n], kinds[:n], np.full(len(network.flat), 1e-4, np.float32))
        found.append((network.flat, network.scores(hashes, counts, plain)))
    for flat, scores in found[1:]:
        assert np.allclose(flat, found[0][0], atol=1e-4)
        assert np.allclose(scores, found[0][1], atol=1e-3)


def test_case_is_lowered_alike_in_ascii_and_other_texts():
    texts = ["".join(map(chr, range(128))), "AZaz09 É K İ ß", "A" * 24 + " " + "B" * 25 + " Z", " x  Y ", None]
    hashes, counts = hashes_of_texts(texts)
    each = [word_hashes(words(t)) for t in texts]
    assert counts.tolist() == [len(h) for h in each]
    assert hashes.tolist() == np.concatenate(each).tolist()
