"""The pipeline beside the same stages done by brute force, one row after the other."""

from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from dataloupe.llm import toxicity
from llm.conftest import prose
from llm.test_decontaminate import brute_matches
from llm.test_simhash import brute_components, brute_fingerprint
from llm.test_suffix_dedup import brute_spans

INSULT = "you are a worthless pathetic idiot and a clown"


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """A folder with the tables that the pipeline reads: toxic documents, copies, shared
    passages, a benchmark item in two documents, odd texts and null keys."""
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(700, 25).replace("ß", "")
    rows = [tuple(r) for r in corpus.collect()]
    rows += [(500 + i, f"{prose(500 + i, 30)} {INSULT} {prose(600 + i, 12)}", "en", "tox", 1) for i in range(25)]
    rows += [(900, prose(1, 20) + " " + item, "en", "leak", 5), (901, item.upper(), "en", "leak", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= 500)) for i in [*range(0, 50, 2), *range(500, 520)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(0, item), (1, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def brute_pipeline(spark, path):
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    marked = {}
    for r in spark.read.parquet(f"{path}/labels.parquet").collect():
        if crc32(str(r.doc_id).encode()) % 5:
            marked[r.doc_id] = max(r.toxic, marked.get(r.doc_id, 0))
    hashed = {
        r.k: r.h for r in spark.createDataFrame([(k,) for k in marked], "k long").selectExpr("k", "xxhash64(k) h").collect()
    }
    sample = sorted((hashed[d[0]], d[0], d[1] or "", d[1]) for d in docs if d[0] in marked)
    model = toxicity.train([s[3] for s in sample], [marked[s[1]] for s in sample])
    weights = model.dense()

    def score(text):
        x = model.bias + weights[toxicity.features(text, model.settings)].sum()
        return 1 / (1 + np.exp(-x))

    docs = [d for d in docs if score(d[1]) < 0.5]

    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    roots = brute_components([brute_fingerprint(d[1]) for d in docs], 2)
    first = {}
    for d, r in zip(docs, roots):
        first.setdefault(r, d[0])
    kept, seen = [], set()
    for d, r in zip(docs, roots):
        if d[0] == first[r] and (d[0] is None or d[0] not in seen):
            seen.add(d[0])
            kept.append(d)

    cut = []
    for d, mask in zip(kept, brute_spans([(d[0], d[1]) for d in kept])):
        if mask.any():
            left = np.frombuffer(d[1].encode(), np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
            d = (d[0], left, *d[2:4], len(left))
        if d[1] != "" or not mask.any():
            cut.append(d)

    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    leaks = {m[0] for m in brute_matches([(d[0], d[1]) for d in cut], items)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d in cut:
        if d[0] not in leaks:
            ids = pieces.encode(d[1] or "")
            out.append((d[0], d[2], d[3], len(ids), ids, pieces.decode(ids) == (d[1] or "")))
    return out


def test_run_equals_brute_force(spark, folder):
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    want = brute_pipeline(spark, folder)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {r[0] for r in got}
    assert not ids & {900, 901} and len(ids & set(range(500, 525))) < 5
    assert 0 in ids and 3 in ids  # clean ones and the first of the copies stay


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.dtypes == docs.dtypes, name


def test_stages_of_nothing_and_of_more_columns(spark, folder, clashing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        wide = stage(spark, clashing, folder)
        if stage is not corpus_pipeline.to_pieces:
            assert wide.columns == clashing.columns, name
        assert wide.count() > 0, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
