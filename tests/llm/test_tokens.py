import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dataloupe.llm import huffman, pieces, token_counts, token_store
from llm.conftest import ODD_TEXTS, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def odd():
    random_ = random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", " ", "é", "1", "'s", "▁", "<|endoftext|>", "՘", "!", "\x85", "\x1f"]
    made = ["".join(random_.choices(parts, k=random_.randint(1, 25))) for _ in range(2000)]
    every = [f"a{chr(c)}1{chr(c)} {chr(c)}b {chr(c)}" for c in range(0x600)]
    return [t for t in ODD_TEXTS if t is not None] + made + every


def test_counts_equal_the_library(library, odd):
    counter = token_counts.BpeCounter(open(BPE).read())
    want = [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    assert counter.counts(odd) == want
    assert [counter.counts([t])[0] for t in odd[:300]] == want[:300]


def test_ids_equal_the_library(library, odd):
    table = token_store.IdTable(open(BPE).read())
    for found, e in zip(table.encode(odd), library.encode_batch(odd, add_special_tokens=False)):
        assert np.frombuffer(found, table.code).tolist() == e.ids


def test_pieces_equal_the_library(odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.PieceTable(open(PIECES, "rb").read())
    assert table.by_word
    for text, found in zip(odd, table.encode(odd)):
        assert found.tolist() == model.encode(text)


def test_a_full_chunk_table_is_emptied_and_stays_right(library):
    counter = token_counts.BpeCounter(open(BPE).read())
    counter.table.most = 5
    text = prose(1, 200)
    want = len(library.encode(text, add_special_tokens=False).ids)
    assert counter.counts([text]) == counter.counts([text]) == [want]
    assert len(counter.table.inner) <= 5


def test_count_column(corpus, empty, clashing, library):
    rows = token_counts.token_counts(corpus, BPE).collect()
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(empty, BPE).count() == 0
    assert dict(token_counts.token_counts(clashing, BPE).dtypes)["n_tokens"] == "bigint"


def test_piece_columns(corpus, empty, clashing):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    both = pieces.encode_pieces(corpus, PIECES, decoded="decoded")
    again = pieces.decode_pieces(both, PIECES, text="once_more")
    for r in again.collect():
        ids = model.encode(r.text or "")
        assert r.piece_ids == ids
        assert r.decoded == r.once_more == model.decode(ids)
    assert pieces.encode_pieces(empty, PIECES).count() == 0
    replaced = pieces.encode_pieces(clashing, PIECES, decoded="decoded")
    assert len(replaced.columns) == len(clashing.columns)
    assert replaced.where("decoded = 'mine'").count() == 0


def _huffman_cost(counts):
    import heapq

    heap, total = sorted(counts), 0
    while len(heap) > 1:
        joined = heapq.heappop(heap) + heapq.heappop(heap)
        total += joined
        heapq.heappush(heap, joined)
    return total


def test_code_lengths_are_optimal_and_limited():
    counts = np.random.default_rng(3).zipf(1.3, 900).clip(1, 10**8).astype(float)
    free = huffman.code_lengths(counts, 40)
    assert (counts * free).sum() == _huffman_cost(counts.tolist())
    limited = huffman.code_lengths(counts, 11)
    assert limited.max() == 11 and (2.0**-limited).sum() == 1
    assert huffman.code_lengths(np.array([7.0])).tolist() == [1]
    assert huffman.code_lengths(np.array([])).tolist() == []
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("symbols", [1, 2, 3, 500])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_round_trip(symbols, n):
    random_ = np.random.default_rng(symbols * 10 + n)
    ids = np.sort(random_.choice(60_000, symbols, replace=False))
    book = huffman.Codebook(ids, huffman.code_lengths(random_.integers(1, 10**6, symbols) ** 2.0))
    text = random_.choice(ids, n)
    payload, checkpoints = book.encode(text)
    assert (book.decode(payload, checkpoints, n) == text).all()


def test_store_round_trip(spark, corpus, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 700)  # several blocks per part
    rows = corpus.where("doc_id IS NOT NULL")
    path = f"{tmp_path}/tokens"
    token_store.write_tokens(rows, path, BPE)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(rows.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    start, texts = 0, {}
    for r in want:
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        ids = library.encode(texts[r.doc_id].pop() or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)


def test_store_of_nothing_and_of_null_keys(spark, corpus, empty, tmp_path):
    token_store.write_tokens(empty, f"{tmp_path}/empty", BPE)
    assert token_store.read_tokens(spark, f"{tmp_path}/empty").count() == 0
    token_store.write_tokens(corpus, f"{tmp_path}/all", BPE)
    found = token_store.read_tokens(spark, f"{tmp_path}/all", with_ids=False).orderBy("start").collect()
    assert [r.doc_id for r in found[:2]] == [None, None] and len(found) == corpus.count()


def test_registered_digests(spark, corpus):
    from dataloupe.llm.queries import piece_digests

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_digests(pieces.encode_pieces(corpus, PIECES, decoded="decoded")).collect()
    texts = {r.doc_id: r.text for r in corpus.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            ids = model.encode(texts[r.doc_id] or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_joined_chunks_give_the_ids_of_whole_texts():
    """Spaces of many kinds, special strings, and characters that look like the vocabulary's marks."""
    with open(BPE) as file:
        table = token_store.IdTable(file.read())
    parts = ["a", " ", "  ", "\n", "\t", "\u0120", "\u010a", "\u00e9", "<|endoftext|>", "'s", "1", "\u4e2d", "\u00a0",
             "\u3000", "\x1c", "\x85", "\U0001f44d", "x y", ".", "don't"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(5000)]
    texts += [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(3000))]
    wanted = [e.ids for e in table.model.encode_batch(texts, add_special_tokens=False)]
    got = table.encode(texts[:2000]) + table.encode(texts[2000:])
    assert [np.frombuffer(g, table.code).tolist() for g in got] == wanted
