"""Document scores by a masked pseudo-likelihood: each word predicted from both its sides."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import forget, others, ship, slices, unused, written
from dataloupe.llm.words import hashes_of_texts, mixed


COUNT_BYTES = 24 << 20  # texts whose words a task counts at a time
HASH_CHARS = 1 << 19  # of texts whose words are hashed at a time, or one longer text
BLOCK = 1024  # rows whose logits are worked on at a time
LARGEST = 40.0  # logits up to which the exponentials of all classes and their sum are far inside a float


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and of its training.

    ``window`` words on either side are looked up in ``inputs`` hashed embeddings of
    ``width`` numbers, go through ``hidden`` units, and give a class: one class for each of the
    ``frequent`` most frequent words and ``hashed`` classes for all others. ``buckets`` is
    the hash space of words. Training goes through the corpus ``rounds`` times; each round
    takes every ``stride``-th word of every document as a target, from the next place on, so
    that every word is a target; a ``stride`` beyond ``rounds`` is refused.
    """

    window: int = 2
    inputs: int = 1 << 13
    width: int = 16
    hidden: int = 32
    frequent: int = 192
    hashed: int = 64
    buckets: int = 1 << 18
    rounds: int = 2
    stride: int = 2
    batch: int = 1024
    rate: float = 0.1
    seed: int = 7

    def __post_init__(self):
        if not 1 <= self.stride <= self.rounds:
            raise ValueError("the stride must be from 1 to the number of rounds")

    @property
    def classes(self) -> int:
        return self.frequent + self.hashed

    def shapes(self) -> list[tuple[int, ...]]:
        context = 2 * self.window * self.width
        return [
            (self.inputs, self.width), (context, self.hidden), (self.hidden,),
            (self.hidden, self.classes), (self.classes,),
        ]


@dataclass(frozen=True)
class Vocabulary:
    """Counts over all documents: the frequent words and all hash buckets of the others."""

    settings: Settings
    top: bytes  # hashes of the frequent words, ascending
    bucket_counts: bytes  # of the words that are not frequent

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The frequent hashes, and the log-probability of each bucket inside its class."""
        counts = np.frombuffer(self.bucket_counts, np.int64) + 1.0
        kind = np.arange(len(counts)) % self.settings.hashed
        totals = np.bincount(kind, counts, self.settings.hashed)
        return np.frombuffer(self.top, np.uint64), np.log(counts / totals[kind])

    def targets(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word and its log-probability inside the class."""
        top, inside = self.tables
        bucket = buckets(hashes, self.settings)
        kind = self.settings.frequent + bucket % self.settings.hashed
        share = inside[bucket]
        if len(top):
            place = np.minimum(np.searchsorted(top, hashes), len(top) - 1)
            frequent = top[place] == hashes
            kind, share = np.where(frequent, place, kind), np.where(frequent, 0.0, share)
        return kind, share


def buckets(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    return (mixed(hashes) % np.uint64(settings.buckets)).astype(np.int64)


def hashed(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes of texts in order, many texts at a time, with the number of words of each."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= HASH_CHARS:
            yield hashes_of_texts(held)
            held, size = [], 0
    if held:
        yield hashes_of_texts(held)


def contexts(
    hashes: np.ndarray, settings: Settings, counts: np.ndarray | None = None,
    chosen: np.ndarray | slice = slice(None),
) -> np.ndarray:
    """For each word, or the ``chosen`` ones, the embeddings' rows of the words around it; row 0 is
    outside the text. ``counts`` has the words of each text, if there are several."""
    w = settings.window
    counts = np.asarray([len(hashes)]) if counts is None else counts
    # So many rows of zeros are between two texts that no window reaches both.
    place = np.arange(len(hashes)) + w * np.repeat(np.arange(1, len(counts) + 1), counts)
    rows = np.zeros(len(hashes) + w * (len(counts) + 1), np.int64)
    rows[place] = 1 + mixed(hashes + np.uint64(1 << 40)) % np.uint64(settings.inputs - 1)
    place = place[chosen]
    sides = [i for i in range(-w, w + 1) if i]
    return np.stack([np.take(rows, place + i) for i in sides], axis=1)


def targets_of_round(hashes: np.ndarray, turn: int, settings: Settings) -> np.ndarray:
    """The places of a text that a round trains on; ``stride`` rounds take each place once."""
    first = (turn + int(hashes[0]) if len(hashes) else 0) % settings.stride
    return np.arange(first, len(hashes), settings.stride)


class Network:
    """The window network; its parameters are five arrays, kept in one flat vector."""

    def __init__(self, settings: Settings, flat: np.ndarray | None = None):
        self.settings = settings
        shapes = settings.shapes()
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            random = np.random.default_rng(settings.seed)
            flat = np.concatenate(
                [
                    random.normal(0, scale, size)
                    for size, scale in zip(sizes, (0.1, 0.15, 0, 0.15, 0))
                ]
            )
        self.flat = np.array(flat, np.float32)
        cuts = np.cumsum(sizes)[:-1]
        self.parts = [p.reshape(s) for p, s in zip(np.split(self.flat, cuts), shapes)]
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, rows: int, width: int, kind: type = np.float32) -> np.ndarray:
        """An array that the next call with this name gets again, as memory that is asked for anew for
        every block costs time. It is not cleared."""
        held = self.rooms.get(name)
        if held is None or len(held) < rows:
            held = self.rooms[name] = np.empty((rows, width), kind)
        return held[:rows]

    @property
    def last(self) -> np.ndarray:
        """The weights between the hidden units and the classes; the last row is the biases."""
        return self.flat[-(self.settings.hidden + 1) * self.settings.classes :].reshape(
            -1, self.settings.classes
        )

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the hidden units and a 1 for the biases, and the embeddings looked up; the
        next call overwrites them."""
        embedding, inner, inner_bias, *_ = self.parts
        n, units = len(rows), inner.shape[1]
        seen = self.room("seen", rows.size, embedding.shape[1])
        np.take(embedding, rows.reshape(-1), axis=0, out=seen, mode="clip")  # the default mode copies
        seen = seen.reshape(n, -1)
        into = np.matmul(seen, inner, out=self.room("into", n, units))
        into += inner_bias
        found = self.room("units", n, units + 1)
        found[:, -1] = 1
        np.tanh(into, out=found[:, :-1])
        return found, seen

    def bounded(self) -> bool:
        """Whether no logit can be too large to be exponentiated: hidden values are from -1 to 1."""
        return bool(np.abs(self.last).sum(axis=0).max() <= LARGEST)

    def logits(self, units: np.ndarray, bounded: bool) -> np.ndarray:
        found = np.matmul(units, self.last, out=self.room("logits", len(units), self.settings.classes))
        if not bounded:
            found -= found.max(axis=1, keepdims=True)
        return found

    def log_softmax(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units, seen = self.hidden(rows)
        logits = self.logits(units, self.bounded())
        logits = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits, units[:, :-1], seen

    def train(self, rows: np.ndarray, kinds: np.ndarray, squares: np.ndarray) -> None:
        """One Adagrad step on a batch; ``squares`` sums the squared gradients."""
        embedding, inner, _, outer, _ = self.parts
        units, seen = self.hidden(rows)
        n, classes, bounded = len(rows), self.settings.classes, self.bounded()
        ones = np.ones(max(n, classes), np.float32)
        back, of_last = self.room("back", n, outer.shape[0]), np.zeros_like(self.last.T)
        own = np.arange(0, min(n, BLOCK) * classes, classes)
        for at in range(0, n, BLOCK):
            here = slice(at, at + BLOCK)
            inside = units[here]
            error = self.logits(inside, bounded)
            np.exp(error, out=error)
            sums = error @ ones[:classes]
            # The errors are left as multiples of the sums, and smaller arrays are divided by them.
            error.reshape(-1)[own[: len(inside)] + kinds[here]] -= sums
            share = (1 / (n * sums))[:, None]
            np.matmul(error, outer.T, out=back[here])
            back[here] *= share
            of_last += error.T @ (inside * share)
        hidden = units[:, :-1]
        back *= 1 - hidden * hidden
        into = np.matmul(back, inner.T, out=self.room("of_seen", n, inner.shape[0]))
        touched, looked_up = self.of_embeddings(rows.reshape(-1), into)
        rate, cut = self.settings.rate, embedding.size
        past = squares[:cut].reshape(embedding.shape)
        summed = np.take(past, touched, axis=0)
        summed += looked_up * looked_up
        past[touched] = summed
        looked_up *= rate
        looked_up /= np.sqrt(summed, out=summed) + 1e-6
        embedding[touched] = np.take(embedding, touched, axis=0) - looked_up
        dense = (seen.T @ back, ones[:n] @ back, of_last.T)
        gradient = np.concatenate([g.reshape(-1) for g in dense])
        squares[cut:] += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(squares[cut:]) + 1e-6
        self.flat[cut:] -= gradient

    def of_embeddings(self, places: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings that were looked up at ``places``, the only ones with a gradient, and
        the gradient of each, summed over its places."""
        inputs, width = self.settings.inputs, self.settings.width
        seen = np.zeros(inputs, bool)
        seen[places] = True
        touched = np.flatnonzero(seen)
        index = np.empty(inputs, np.int64)
        index[touched] = np.arange(len(touched))
        # A complex number is two floats that are added at once.
        kind, lanes = (np.complex64, width // 2) if width % 2 == 0 else (np.float32, width)
        every = np.arange(len(touched) * lanes).reshape(-1, lanes)
        each = self.room("each", len(places), lanes, np.int64)
        np.take(every, np.take(index, places), axis=0, out=each, mode="clip")
        summed = np.zeros((len(touched), width), np.float32)
        np.add.at(summed.reshape(-1).view(kind), each.reshape(-1), into.reshape(-1).view(kind))
        return touched, summed

    def scores(self, hashes: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """The log-probability of each word of several texts given those around it."""
        kinds, found = vocabulary.targets(hashes)
        rows, bounded = contexts(hashes, self.settings, counts), self.bounded()
        classes = self.settings.classes
        ones, sums = np.ones(classes, np.float32), np.empty(len(hashes), np.float32)
        first = np.arange(0, BLOCK * classes, classes)
        for at in range(0, len(hashes), BLOCK):
            here = slice(at, at + BLOCK)
            logits = self.logits(self.hidden(rows[here])[0], bounded)
            found[here] += np.take(logits.reshape(-1), first[: len(logits)] + kinds[here])
            np.matmul(np.exp(logits, out=logits), ones, out=sums[here])
        found -= np.log(sums, dtype=np.float64)
        return found


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    parameters: bytes

    @functools.cached_property
    def network(self) -> Network:
        return Network(self.vocabulary.settings, np.frombuffer(self.parameters, np.float32))


def count_words(docs: DataFrame, text: str, settings: Settings) -> Vocabulary:
    """Word counts over all documents, summed per task before the shuffle.

    The driver receives the ``frequent`` top words and one count per bucket, both bounded by
    the settings. Ties among the top words go to the smaller hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", COUNT_BYTES):
            every = [hashes for hashes, _ in hashed(batch.column(0).to_pylist())]
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *every]), return_counts=True)
            arrays = [pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    each = docs.select(col(text).alias("t")).mapInArrow(count, "word long, n long")
    counts = each.groupBy("word").agg(F.sum("n").alias("n")).select("word", "n")
    space = settings.buckets

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().astype(np.uint64)
            arrays = [batch.column(0), pa.array(buckets(hashes, settings)), batch.column(1)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "bucket", "n"])

    placed = counts.mapInArrow(by_bucket, "word long, bucket long, n long")
    placed = written(placed)
    top = placed.orderBy(F.desc("n"), "word").limit(settings.frequent).toArrow()
    hashes = np.sort(top.column("word").to_numpy())
    sums = placed.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(space, np.int64)
    totals[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    forget(placed)
    frequent = top.column("word").to_numpy().astype(np.uint64)
    np.subtract.at(totals, buckets(frequent, settings), top.column("n").to_numpy())
    return Vocabulary(settings, hashes.astype(np.uint64).tobytes(), totals.tobytes())


def fit_language_model(
    docs: DataFrame, text: str = "text", settings: Settings = Settings()
) -> Model:
    """Counts the words of all documents and trains the network on targets from all of them.

    In each round every task starts from the same parameters and trains on its own documents;
    the parameters are then averaged, weighted by targets, in a grouped sum over parameters.
    The driver holds one copy. Null and empty texts have no targets; without any target the
    parameters stay as they were drawn.
    """
    require_columns(docs, text)
    spark = docs.sparkSession
    ship(spark)
    model = Model(count_words(docs, text, settings), Network(settings).flat.tobytes())
    for turn in range(settings.rounds):
        sent = spark.sparkContext.broadcast((model, turn))
        moved = docs.select(col(text).alias("t")).mapInArrow(
            functools.partial(_train_task, sent=sent), "i int, v double, n long"
        )
        mean = (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")
        averaged = moved.groupBy("i").agg(mean).toArrow()  # one row per parameter
        flat = np.frombuffer(model.parameters, np.float32).copy()
        flat[averaged.column("i").to_numpy()] = averaged.column("v").to_numpy()
        model = replace(model, parameters=flat.tobytes())
    return model


def _train_task(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model, turn = sent.value
    settings, vocabulary = model.vocabulary.settings, model.vocabulary
    network = Network(settings, np.frombuffer(model.parameters, np.float32))
    squares = np.full(len(network.flat), 1e-4, np.float32)
    rows, kinds, held, n = [], [], 0, 0
    # The first word of a document depends on the document only, so that the rounds between them
    # take every place of a text, whatever the order of documents.
    for batch in batches:
        for hashes, counts in hashed(batch.column(0).to_pylist()):
            ends = np.cumsum(counts).tolist()
            texts = zip(ends, counts.tolist())
            chosen = np.concatenate(
                [b - k + targets_of_round(hashes[b - k : b], turn, settings) for b, k in texts]
            )
            if not len(chosen):
                continue
            rows.append(contexts(hashes, settings, counts, chosen))
            kinds.append(vocabulary.targets(hashes[chosen])[0])
            held += len(chosen)
            n += len(chosen)
            if held >= settings.batch:
                every, classes = np.concatenate(rows), np.concatenate(kinds)
                for at in range(0, held - settings.batch + 1, settings.batch):
                    here = slice(at, at + settings.batch)
                    network.train(every[here], classes[here], squares)
                used = held // settings.batch * settings.batch
                rows, kinds, held = [every[used:]], [classes[used:]], held - used
    if held:
        network.train(np.concatenate(rows), np.concatenate(kinds), squares)
    if n:
        count = len(network.flat)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(count, dtype=np.int32)),
                pa.array(network.flat.astype(np.float64)),
                pa.array(np.full(count, n, np.int64)),
            ],
            ["i", "v", "n"],
        )


def with_pseudo_likelihood(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    name: str = "log_likelihood",
    count: str = "n_words",
) -> DataFrame:
    """``docs`` with the summed conditional log-probabilities (natural) of all words of each
    whole text as a double ``name`` and their number as a long ``count``.

    Null and empty texts, and those of punctuation only, get 0.0 and 0. Columns of these names
    are replaced. One scan without a
    shuffle; the model (about 3 MB at the default sizes) is broadcast.
    """
    require_columns(docs, text)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("log_likelihood double, n_words long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        network, vocabulary = sent.value.network, sent.value.vocabulary
        for texts in batches:
            sums, sizes = [np.empty(0)], [np.empty(0, np.int64)]
            for hashes, counts in hashed(texts):
                owner = np.repeat(np.arange(len(counts)), counts)
                each = network.scores(hashes, counts, vocabulary)
                sums.append(np.bincount(owner, each, len(counts)))
                sizes.append(counts)
            yield pd.DataFrame(
                {"log_likelihood": np.concatenate(sums), "n_words": np.concatenate(sizes)}
            )

    both = unused(docs, "score")
    scored = docs.withColumn(both, score(col(text)))
    return scored.select(
        *map(col, others(docs, name, count)),
        col(both)["log_likelihood"].alias(name),
        col(both)["n_words"].alias(count),
    )
