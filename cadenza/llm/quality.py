"""Quality classifier: supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams of words are each hashed to a vector; a document is the
average of all its features' vectors, and a softmax layer scores it. Vectors and layer are trained together by stochastic
gradient descent in numpy.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts_of, with_columns

#: Distinct words whose features a worker keeps; beyond it the memory is emptied and refilled.
KEPT_WORDS = 300_000


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the labelled rows that are fitted on: the ones with the smallest hashes of their keys."""

    buckets: int = 1 << 17
    dim: int = 12
    shortest: int = 3
    longest: int = 4
    epochs: int = 10
    rate: float = 0.5
    max_train: int = 3000
    seed: int = 7


def word_features(word: str, s: Settings) -> list[int]:
    """Buckets of the word itself and of its character n-grams, its ends marked."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode())]
    for n in range(s.shortest, s.longest + 1):
        out += [zlib.crc32(marked[i : i + n].encode()) for i in range(len(marked) - n + 1)]
    return [f % s.buckets for f in out]


def word_code(word: str) -> int:
    """What stands for a word in pairs of words."""
    return zlib.crc32(word.encode())


def pair_features(codes: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of all pairs of neighbouring words, from the words' codes in order.

    A pair is hashed by the exclusive or of its words' codes: every pair has a bucket of its own, in either order,
    but a word that follows itself has the same one whatever the word is.
    """
    x = (codes[:-1] ^ codes[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(s.buckets)).astype(np.int64)


def document_features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs, in 16 bits where all counts fit, else 32."""
    times = Counter(text.split())
    feats = [word_features(w, s) for w in times]
    codes = np.asarray([word_code(w) for w in text.split()], np.uint64)
    flat = np.asarray([f for x in feats for f in x], np.int64)
    often = np.repeat(np.asarray(list(times.values()), np.int64), np.asarray(list(map(len, feats)), np.int64))
    pairs = pair_features(codes, s)
    ids, inverse = np.unique(np.concatenate([flat, pairs]), return_inverse=True)
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, inverse, np.concatenate([often, np.ones(len(pairs), np.int64)]))
    return ids.astype(np.int32), n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32)


def bag_of(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``document_features`` from their bytes; counts as long as the buckets have 32 bits."""
    i = np.frombuffer(ids, np.int32)
    return i, np.frombuffer(counts, np.uint32 if len(i) and len(counts) == i.nbytes else np.uint16)


@dataclass
class Model:
    """``value[f]``: feature f's vector times (layer's row of 1 less row of 0); ``bias`` likewise."""

    settings: Settings
    value: np.ndarray
    bias: float


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Softmax over averaged vectors by plain SGD, with a rate that falls to nothing, from each row's buckets and their
    counts. No rows: a model that says 0.5."""
    rng = np.random.default_rng(s.seed)
    e = (rng.random((s.buckets, s.dim), np.float32) - 0.5) / s.dim
    w, bias = np.zeros((2, s.dim), np.float32), np.zeros(2, np.float32)
    w[1], w[0] = 0.1, -0.1
    step, steps = 0, max(1, s.epochs * len(labels))
    for _ in range(s.epochs):
        for i in rng.permutation(len(labels)):
            ids, count = features[i]
            share = (count / np.float32(max(1, int(count.sum(dtype=np.int64))))).astype(np.float32, copy=False)
            rate = s.rate * (1 - step / steps)
            step += 1
            h = share @ e[ids] if len(ids) else np.zeros(s.dim, np.float32)
            z = w @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ w
            w -= rate * np.outer(p, h)
            bias -= rate * p
            if len(ids):
                # shares are small, so vectors move by shares scaled to the largest one
                e[ids] -= (rate * 20) * np.outer(share, back)
    if not len(labels):
        return Model(s, np.zeros(s.buckets), 0.0)
    return Model(s, (e @ (w[1] - w[0])).astype(np.float64), float(bias[1] - bias[0]))


class Scorer:
    """Scores of whole texts in [0, 1]; each distinct word's features are summed once and kept."""

    def __init__(self, m: Model) -> None:
        self.m, self.at = m, {}
        self.sums, self.counts, self.codes = np.zeros(1 << 12), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)

    def _learn(self, word: str) -> int:
        i, f = len(self.at), word_features(word, self.m.settings)
        if i == len(self.sums):
            self.sums, self.counts, self.codes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.codes))
        self.sums[i], self.counts[i], self.codes[i] = self.m.value[f].sum(), len(f), word_code(word)
        self.at[word] = i
        return i

    def __call__(self, text: str) -> float:
        words = text.split()
        total = self.m.bias
        if words:
            if len(self.at) >= KEPT_WORDS:
                self.at.clear()
            for w in set(words).difference(self.at):
                self._learn(w)
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            pairs = pair_features(self.codes[at], self.m.settings)
            total += (self.sums[at].sum() + self.m.value[pairs].sum()) / (self.counts[at].sum() + len(pairs))
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def held_out(key: Column) -> Column:
    """Rows that never teach: crc32 of the key as text leaves 2 modulo 4. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on at most ``settings.max_train`` labelled rows that aren't held out.

    Only keys, texts and labels are read; features are hashed where the texts are, at most ``max_train`` bags of hashed
    features go to one task, which trains, and ``settings.buckets`` numbers come to the driver. Rows with null text teach as empty ones; labels other than 0 and 1, null keys
    and labels without a document don't count; of a key labelled twice its smallest label counts.
    """
    short_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(F.col(key)))
    known = known.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).groupBy("k").agg(F.min("y").alias("y"))
    # Labels alone are ordered; twice the bound allows for labels without a document.
    picked = known.orderBy(F.xxhash64("k"), "k").limit(2 * settings.max_train)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(picked), "k").select("k", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [document_features(t, settings) for t in texts_of(batch, "t")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).cast(pa.string())), batch.column(1), pa.array([b[0].tobytes() for b in both], pa.binary()), pa.array([b[1].tobytes() for b in both], pa.binary())],
                names=["k", "y", "ids", "counts"])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, known = [], []
        for batch in batches:
            known += batch.column(1).to_pylist()
            features += [bag_of(i, n) for i, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        m = train(features, np.asarray(known, np.int64), settings)
        yield pa.RecordBatch.from_arrays([pa.array([m.value.tobytes()], pa.binary()), pa.array([m.bias])], names=["value", "bias"])

    bags = rows.mapInArrow(run, "k string, y int, ids binary, counts binary").orderBy(F.xxhash64("k"), "k", "y", "ids").limit(settings.max_train)
    # an ordered limit is a single partition, in order
    got = bags.mapInArrow(teach, "value binary, bias double").first()
    return Model(settings, np.frombuffer(bytes(got["value"])).copy(), got["bias"]) if got else train([], np.empty(0, np.int64), settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, held_out, score, predicted (1 if score >= threshold, else 0).

    Whole texts are scored where they are read, without a shuffle; null and empty texts score by the bias alone. The
    model is a table of ``settings.buckets`` numbers, whatever the input. Other columns are left out.
    """
    short_batches(docs.sparkSession)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = [scorer(t) for t in texts_of(batch, "t")]
            yield with_columns(batch, ["k", "held_out"], {"score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= threshold) for x in s], pa.int32())})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("k"), held_out(docs[key]).alias("held_out"), docs[text].alias("t"))
    return rows.mapInArrow(run, f"k {kind}, held_out boolean, score double, predicted int").withColumnRenamed("k", key)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more; a filter in place, without a shuffle."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t) >= threshold for t in texts_of(batch, text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
