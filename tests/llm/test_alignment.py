"""Aligned tokens beside the two libraries and plain counting."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from dataloupe.llm import alignment
from dataloupe.llm.perfect_hash import Hash, build, segment_of
from dataloupe.llm.queries import QUERIES

NAME = "op13_cross_tokenizer_alignment"
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_perfect_hash_numbers_each_key_once():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 32, 30_000, dtype=np.uint64)).astype(np.uint32)
    other = np.setdiff1d(r.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32), keys)
    at = segment_of(keys, 7)
    parts = [(s, *build(keys[at == s])) for s in range(7)]
    whole = Hash.of(7, parts)
    assert sorted(whole.numbers(keys)) == list(range(len(keys)))
    assert (whole.stored[whole.numbers(keys)] == keys).all()
    assert (whole.numbers(other) == -1).all()
    some = Hash.of(7, parts[2:4])
    numbers = some.numbers(keys)
    assert sorted(numbers[numbers >= 0]) == list(range(len(some.stored)))
    assert ((numbers >= 0) == np.isin(at, (2, 3))).all()
    assert len(Hash.of(3, [(0, *build(keys[:0]))]).numbers(keys)) == len(keys)


def brute(texts):
    first, second = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    first.encode_special_tokens = True
    letters = {c: b for c, b in alignment.byte_letters().items()}
    vocabulary = {i: t for t, i in json.load(open(FILES[0]))["model"]["vocab"].items()}
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        want = (" " + text).encode()
        a = [(i, bytes(letters[c] for c in vocabulary[i])) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, _piece(second.id_to_piece(i))) for i in second.encode(text)]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        links, i, j, groups, now = [], 0, 0, [], ([], [])
        while i < len(a) or j < len(b):
            links.append((a[i][0], b[j][0]))
            if not now[0] or now[0][-1] != i:
                now[0].append(i)
            if not now[1] or now[1][-1] != j:
                now[1].append(j)
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(str(a[k][0]) for k in now[0]) + "|" + ",".join(str(b[k][0]) for k in now[1]))
                now = ([], [])
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(count[p] == best[p[0]] for p in d[3])
        total = sum(count[p] for p in d[3])
        out.append((d[0], d[1], len(d[2]), len(d[3]), n_best, total, hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


def _piece(piece):
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.select("doc_id", *COUNTS, "groups_sha256").collect()))


@pytest.fixture(scope="module")
def told(corpus):
    docs = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    return sorted(repr((d, *found)) for (d, _), found in zip(docs, brute([t for _, t in docs])))


def test_query_equals_the_libraries(spark, corpus, told, tmp_path):
    names = "a b n_a row pairs known n_best count_sum segment groups_sha256 A".split()[:-1]
    corpus.withColumns({n: F.lit("mine") for n in names}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(QUERIES[NAME](spark, str(tmp_path))) == told


def test_several_passes_and_levels_give_the_same(spark, corpus, told, monkeypatch):
    for name, value in {"SEGMENT": 256, "MOST_KEYS": 700, "FAN": 2, "MOST_PAIRS": 100, "ID_BYTES": 500, "MOST_CHUNKS": 50}.items():
        monkeypatch.setattr(alignment, name, value)
    docs = corpus.withColumns({n: F.lit("mine") for n in ("row", "pairs", "known", "ROWS")}).repartition(5)
    found = alignment.with_alignment(docs, *FILES)
    assert rows_of(found) == told
    assert [r.row for r in found.select("row").distinct().collect()] == ["mine"]


def test_no_documents_and_no_tokens(spark, empty, tmp_path):
    assert alignment.with_alignment(empty, *FILES).count() == 0
    silent = spark.createDataFrame([(1, None), (2, ""), (3, "▁ x")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.with_alignment(silent, *FILES).select("n_a", "n_links", "groups_sha256").collect()] == [(0, 0, "")] * 3
