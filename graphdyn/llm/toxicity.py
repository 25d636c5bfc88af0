"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct 32-bit hashes of its words, word stems (the
first ``STEMS`` bytes, so that unseen inflections count), word pairs and pairs
with one word between. Training reads a bounded sample of labelled rows
(2 * ``TRAIN_DOCS``, drawn by hash of the key at one rate for both labels, so that
a score means the same at every table size), cut by key into shards of about ``SHARD_ROWS``. Each shard runs FTRL-proximal with per-coordinate rates; L1
leaves a few hundred non-zero weights. The shards' weights are averaged and sent
to the executors once. All of it is bounded by the sample, not by the corpus.

Edge cases: null and empty texts score the bias alone; rows without a label or
with a label other than 0 and 1 are not learned from; without rows of both
labels every score is the share of label 1 (0 without rows); a key that repeats
is learned from once, equal draws in order of label; very long texts are read whole;
an empty table gives an empty result; columns named like a result move the result to a fresh name,
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import Sent, bound_batches, fresh, unit_hash
from graphdyn.llm.words import PUNCT, chunks, encode, mix, words

TRAIN_DOCS = 3000
SHARD_ROWS = 4000
EPOCHS = 6
STEMS = (4, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
_U = np.uint64
_K = _U(0xD1342543DE82EF95)
BIAS = np.uint32(0)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Distinct feature hashes per text, the bias first."""
    for a, b in chunks(texts):
        w, first, *stems = words(texts[a:b], PUNCT, STEMS)
        pair = mix(w[:-1] * _K + w[1:]) if len(w) > 1 else w[:0]
        skip = mix(w[:-2] * _K + w[2:] + _U(1)) if len(w) > 2 else w[:0]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            every = np.concatenate([w[i:j], pair[i: max(i, j - 1)], skip[i: max(i, j - 2)],
                                    *(x[i:j] for x in stems)])
            every = np.unique((every >> _U(32)).astype(np.uint32))
            yield np.concatenate([[BIAS], every[every != BIAS]])


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the non-zero coordinates after passes over rows in order."""
    names, at = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True)
    at = np.split(at, np.cumsum([len(f) for f, _ in rows])[:-1])
    z, n = np.zeros(len(names)), np.zeros(len(names))

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(epochs):
        for i, (_, y) in zip(at, rows):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / ALPHA * w
            n[i] += g * g
    w = weights(slice(None))
    keep = np.flatnonzero(w)
    return names[keep], w[keep]


class Model:
    """Sorted non-zero coordinates and a small bitmap that most features miss."""

    def __init__(self, names: np.ndarray, weights: np.ndarray):
        order = np.argsort(names)
        self.names, self.weights = names[order].astype(np.uint32), weights[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.names >> np.uint32(12)] = True

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, f in enumerate(features(texts)):
            f = f[self.maybe[f >> np.uint32(12)]]
            at = np.minimum(np.searchsorted(self.names, f), max(0, len(self.names) - 1))
            hit = self.names[at] == f if len(self.names) else np.zeros(len(f), bool)
            out[i] = self.weights[at[hit]].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str,
        train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from the texts of ``docs`` whose key has a label in ``labels``.

    The sample is drawn from the labels alone, in their own ratio; at most about 2 * ``train_docs``
    drawn keys are broadcast to the documents, whose texts are not shuffled.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isin(0, 1))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        share = np.clip(float(1 in counts), 1e-9, 1 - 1e-9)
        return Model(np.array([BIAS]), np.array([np.log(share / (1 - share))]))
    total = sum(counts.values())
    draw = unit_hash("toxicity", F.col("k"))
    n_shards = -(-min(total, 2 * train_docs) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("k"), F.lit(n_shards)).alias("shard")
    # a key is drawn with all its rows, so it counts once per label
    drawn = rows.filter(draw < 2 * train_docs / total).select("k", "y", shard, draw.alias("draw")).distinct()
    sample = docs.select(F.col(key).alias("k2"), F.col(text).alias("t")).join(
        F.broadcast(drawn), F.col("k2") == F.col("k")).groupBy("shard", "draw", "k", "y").agg(F.min("t").alias("t"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "y"])
        names, w = ftrl(list(zip(features(encode(pdf["t"])), pdf["y"])))
        return pd.DataFrame({"name": names.astype(np.int64), "w": w})

    # a shard is a bounded sample
    parts = sample.groupBy("shard").applyInPandas(train, "name long, w double")
    # a coordinate that one shard zeroed counts as 0 there
    mean = parts.groupBy("name").agg((F.sum("w") / n_shards).alias("w")).toPandas()
    return Model(mean["name"].to_numpy(np.int64), mean["w"].to_numpy())


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "toxicity")


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` and the score under a fresh name (``added``)."""
    bound_batches(docs.sparkSession)
    shared = Sent(docs.sparkSession, model)
    (name,), (t,) = added(docs), fresh(docs, "t")
    rows = docs.select(*dict.fromkeys(keep), F.col(text).alias(t))
    schema = [f"`{n}` {k}" for n, k in rows.drop(t).dtypes] + [f"`{name}` double"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=t).assign(**{name: shared.value.scores(encode(pdf[t]))})

    return rows.mapInPandas(run, ", ".join(schema))
