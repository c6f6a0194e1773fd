"""Quality with supervised subword embeddings (operator 2).

A word's vector is the mean of learned vectors of its hashed word and
character n-grams.  A document is the mean of its words' vectors, of those of
its hashed word bigrams, and of a bigram that all adjacent equal words share;
a softmax over it gives the label.  Vectors and output are learned by numpy
stochastic gradient descent.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import held_out, per_batch, ship, small_batches
from .langid import sample, summed
from .words import WordTable, hashed_grams, ragged_sum

#: Labelled rows of each label that a model is fitted on, at most.
SAMPLE_ROWS = 2000
BUCKETS, SIZE = 1 << 17, 10
REPEAT = "\x01repeat"


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) pairs."""
    return hashed_grams(words, (3, 4, 5), buckets)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def bigrams(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the pairs of adjacent words, whose hashes are given."""
    x = h.astype(np.uint64)
    x = (x[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
    return ((x ^ (x >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's features and their weights, which sum to 1 unless it has no words."""
    ws = (text or "").split()
    twice = sum(a == b for a, b in zip(ws, ws[1:]))
    pairs = bigrams(np.fromiter(map(word_hash, ws), np.int64, len(ws)), buckets)
    total = max(1, len(ws) + twice + len(pairs))
    counts = Counter(ws + [REPEAT] * twice)
    found, own = features(list(counts), buckets)
    share = np.array(list(counts.values()), float) / total / np.maximum(np.bincount(own, minlength=len(counts)), 1)
    u, at = np.unique(np.concatenate([found, pairs]), return_inverse=True)
    return u, np.bincount(at, np.concatenate([share[own], np.full(len(pairs), 1 / total)]), len(u)).astype(np.float32)


class Quality:
    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vectors, self.output, self.bias = vectors, output, bias
        self.table: WordTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def word_vectors(self, words: list[str]) -> np.ndarray:
        """Each word's vector, and its hash as the last column."""
        found, own = features(words, len(self.vectors))
        mean = summed(self.vectors, found, own, len(words)) / np.maximum(np.bincount(own, minlength=len(words)), 1)[:, None]
        return np.concatenate([mean, np.fromiter(map(word_hash, words), float, len(words))[:, None]], axis=1)

    def document_vectors(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            self.table = WordTable(self.word_vectors)
        idx, rows = self.table.batch(texts)
        n, size = np.array([len(i) for i in idx]), self.vectors.shape[1]
        if not n.sum():
            return np.zeros((len(idx), size))
        flat = np.concatenate(idx)
        sums = ragged_sum(rows, flat, n)[:, :size]
        pairs = bigrams(rows[flat, size], len(self.vectors))
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(n)[n > 0] - 1] = False  # the last word of a text begins no pair
        more = np.maximum(n - 1, 0)
        sums += ragged_sum(self.vectors, pairs[inside[:-1]], more)
        twice = ragged_sum((flat[1:] == flat[:-1])[inside[:-1]].astype(float), np.arange(more.sum()), more)
        return (sums + twice[:, None] * self.word_vectors([REPEAT])[:, :size]) / np.maximum(n + twice + more, 1)[:, None]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; that of the bias for texts without words."""
        return softmax(self.document_vectors(texts) @ self.output + self.bias)[:, 1]


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def slopes(docs: np.ndarray, output: np.ndarray, bias: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Of the mean weighted cross-entropy: its slopes by output and bias, and n times those by the documents' vectors."""
    p = softmax(docs @ output + bias)
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None]
    return docs.T @ p / len(y), p.mean(axis=0), p @ output.T


def fit(rows: list[tuple[str, int]], size: int = SIZE, buckets: int = BUCKETS, epochs: int = 8, rate: float = 0.5, batch: int = 16, seed: int = 5) -> Quality:
    """A model of (text, label 0 or 1) rows; classes weigh alike in the loss."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    model = Quality(vectors, np.zeros((size, 2), np.float32), np.zeros(2, np.float32))
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        model.bias[:] = (0, 4) if len(y) and y[0] else (4, 0) if len(y) else (0, 0)
        return model
    bags = [bag(text, buckets) for text, _ in rows]
    weight = (len(y) / (2 * np.bincount(y, minlength=2)))[y]
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        lr = rate * (1 - epoch / epochs)
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            docs = np.stack([w @ vectors[u] for u, w in (bags[i] for i in pick)])
            by_output, by_bias, by_docs = slopes(docs, model.output, model.bias, y[pick], weight[pick])
            model.output -= (4 * lr * by_output).astype(np.float32)
            model.bias -= (lr * by_bias).astype(np.float32)
            for i, g in zip(pick, by_docs):
                u, w = bags[i]
                vectors[u] -= (lr * 40) * w[:, None] * g.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 9) -> Quality:
    """A model from labelled rows that are not held out; sample_rows of each label at most.

    Labels other than 0 and 1, and null ids, are left out."""
    known = labels.where(~held_out(F.col("doc_id"), 3, 1) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = sample(known, "quality", sample_rows, seed)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()
    return fit([(r.text, r.quality) for r in sorted(got, key=lambda r: (r.doc_id, r.quality, r.text or ""))])


def score(docs: DataFrame, labels: DataFrame | None = None, model: Quality | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Without a model one is trained on docs and labels.  Null and empty texts
    get the score of the bias alone.  A null doc_id is not held out.  Rows
    with equal doc_id each give a row, equal texts equal scores.  Other
    columns are ignored; an empty table gives an empty table; without labels
    to learn from the score is 0.5."""
    model = model or train(docs, labels)
    shared = ship(docs.sparkSession, model)

    def batch(b):
        s = np.concatenate([shared().score(part) for part in small_batches(b.column(2))]).astype(float)
        return {"doc_id": b.column(0), "held_out": b.column(1), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)), "text")
    return per_batch(slim, batch, "doc_id long, held_out boolean, score double, predicted int")
