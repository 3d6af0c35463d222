"""Toxicity scores by FTRL-proximal logistic regression over hashed words and word pairs."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dataloupe.functions.columns import col, require_columns
from dataloupe.llm.frames import ship, trim
from dataloupe.llm.words import mixed, word_hashes, words

FOLDS = 5
MOST_TRAINING_ROWS = 12_000


@dataclass(frozen=True)
class Settings:
    """``bits`` of the feature hash, the widest ``gap`` inside a word pair, FTRL-proximal's
    rates and penalties, and how often the rows are gone through."""

    bits: int = 20
    gap: int = 2
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 6


def features(text: str | None, settings: Settings) -> np.ndarray:
    """The distinct hashed features of a text: words, adjacent words, and pairs of words with
    up to ``gap`` others between them. The whole text is used; an empty one has none."""
    hashes = word_hashes(words(text))
    kinds = [mixed(hashes)]
    for step in range(1, settings.gap + 2):
        left, right = hashes[:-step], hashes[step:]
        kinds.append(mixed((left << np.uint64(32) | right) + np.uint64(step << 8)))
    return np.unique(np.concatenate(kinds) >> np.uint64(64 - settings.bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Non-zero weights only: ``index`` and ``weight``, and the bias."""

    settings: Settings
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        weights = np.zeros(1 << self.settings.bits)
        weights[self.index] = self.weight
        return weights

    def key(self) -> tuple:
        return self.settings, self.index.tobytes(), self.weight.tobytes(), self.bias


def train(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """FTRL-proximal (McMahan and others, 2013), one text at a time in the given order.

    Every coordinate has its own rate, falling with the squares of its gradients, and L1 keeps
    the coordinates at zero whose evidence is small. The last coordinate is the bias, which
    is not penalised.
    """
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    found = [np.append(features(t, settings), size).astype(np.int32) for t in texts]
    for _ in range(settings.epochs):
        for active, label in zip(found, labels, strict=True):
            za, na = z[active], n[active]
            weights = _weights(za, na, settings)
            gradient = _sigmoid(float(weights.sum())) - label
            square = gradient * gradient
            sigma = (np.sqrt(na + square) - np.sqrt(na)) / settings.alpha
            z[active] = za + gradient - sigma * weights
            n[active] = na + square
    everything = np.arange(size + 1)
    weights = _weights(z, n, settings) if texts else np.zeros(len(everything))
    index = np.flatnonzero(weights[:size])
    return Model(settings, index, weights[index], float(weights[size]))


def _weights(z: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    """The closed form of FTRL-proximal; the last coordinate is free of the penalties."""
    l1 = np.full(len(z), settings.l1)
    l2 = np.full(len(z), settings.l2)
    l1[-1] = l2[-1] = 0.0
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
    return -shrunk / ((settings.beta + np.sqrt(n)) / settings.alpha + l2)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(x, -35.0), 35.0)))


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the key as text is divisible by ``folds``; false for null keys."""
    digest = F.crc32(key.cast("string").cast("binary"))
    return F.coalesce(digest % F.lit(folds) == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_rows: int = MOST_TRAINING_ROWS,
    settings: Settings = Settings(),
) -> Model:
    """A model from the labelled rows outside the held-out fold.

    At most ``most_rows`` rows are used, those whose keys have the smallest hashes: the
    documented bound on what reaches the driver. Keys with several labels count as toxic if one
    of them is. Null keys, null labels and labels other than 0 and 1 are left out; without
    any row the model is empty and scores 0.5. Only the text is looked at.
    """
    require_columns(docs, key, text)
    require_columns(labels, key, label)
    marked = labels.select(col(key).alias("k"), col(label).cast("int").alias("y"))
    marked = marked.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    order = [F.xxhash64("k"), F.col("k")]
    chosen = marked.groupBy("k").agg(F.max("y").alias("y")).orderBy(*order).limit(most_rows)
    texts = docs.select(col(key).alias("k"), col(text).alias("t"))
    # At most most_rows pairs of a key and a label: 200 kB.
    rows = texts.join(F.broadcast(chosen), "k").orderBy(*order, "t").limit(most_rows)
    sample = rows.select("t", "y").toArrow().to_pydict()
    model = train(sample["t"], sample["y"], settings)
    del sample
    trim()
    return model


@functools.lru_cache(maxsize=1)
def _dense(key: tuple) -> np.ndarray:
    settings, index, weight, _ = key
    weights = np.zeros(1 << settings.bits)
    weights[np.frombuffer(index, np.int64)] = np.frombuffer(weight)
    return weights


def with_toxicity(
    docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity"
) -> DataFrame:
    """``docs`` with the probability of label 1 as a double ``name``.

    One scan without a shuffle; the model's non-zero weights are broadcast. Null and empty
    texts get the probability that the bias alone gives. A column ``name`` is replaced.
    """
    require_columns(docs, text)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.key())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = sent.value
        settings, bias, weights = key[0], key[3], _dense(key)
        for texts in batches:
            sums = [bias + float(weights[features(t, settings)].sum()) for t in texts]
            yield pd.Series([_sigmoid(x) for x in sums], dtype="float64")
        trim()

    return docs.withColumn(name, score(col(text)))
