"""Language of words and documents with a linear-chain CRF (operator 1).

Words have affix, character n-gram, word and lexicon features; transitions
between the labels of adjacent words are learned with them.  Training
sequences splice stretches of documents of different languages, so that the
model expects code-switched text.  Marginals come from forward-backward; a
document's language is the one with the largest sum of word marginals.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import held_out, per_batch, ship, small_batches
from .words import WordTable, bucket, hashed_grams, ragged_sum

#: Rows of each language that a model is fitted on, at most.
SAMPLE_ROWS = 400
#: Spliced training sequences and their length in words.
SEQUENCES, LENGTH = 5000, 48
BUCKETS = 1 << 15
CHUNK = 64
UNKNOWN = "und"


def bare(word: str) -> str:
    """Lower-cased, without other than letters at the ends; empty if there is no letter."""
    w = word.lower()
    if w.isalpha():
        return w
    at = [i for i, c in enumerate(w) if c.isalpha()]
    return w[at[0] : at[-1] + 1] if at else ""


class Features:
    """Hashed features of bare words; lexicon maps words to the label that they mark."""

    def __init__(self, lexicon: dict[str, int], buckets: int = BUCKETS):
        self.lexicon, self.buckets = lexicon, buckets

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, number of the word) pairs; empty words have none."""
        found, own = hashed_grams(words, (2, 3), self.buckets, prefixes=(1, 2, 3), suffixes=(1, 2, 3, 4))
        marked = [(bucket(f"lex{k}", self.buckets), i) for i, k in enumerate(map(self.lexicon.get, words)) if k is not None]
        more = np.array(marked, np.int64).reshape(-1, 2)
        return np.concatenate([found, more[:, 0]]), np.concatenate([own, more[:, 1]])


def summed(weights: np.ndarray, found: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows weights[found] by owner."""
    return np.stack([np.bincount(own, column[found], n) for column in weights.T], axis=1)


def find_lexicon(by_label: list[Counter], least: int = 5, share: float = 0.8) -> dict[str, int]:
    """Frequent words that stand in one label's texts for `share` of their rate."""
    total = [max(1, sum(c.values())) for c in by_label]
    out = {}
    for k, c in enumerate(by_label):
        for w, n in c.items():
            rate = n / total[k]
            if n >= least and rate >= share * sum(d[w] / t for d, t in zip(by_label, total)):
                out[w] = k
    return out


class Crf:
    def __init__(self, labels: list[str], features: Features, weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.features, self.weights, self.transitions = labels, features, weights, transitions
        self.table: WordTable | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word's labels; then one column that tells whether it has letters."""
        bares = [bare(w) for w in words]
        e = summed(self.weights, *self.features.of(bares), len(bares))
        return np.concatenate([e, np.array([bool(b) for b in bares])[:, None]], axis=1)

    def marginal_sums(self, texts: list[str | None], words: bool = False):
        """Sums over each text's words with letters of their label marginals, and the number of those words.

        words: the marginals of every word too, as a list of arrays."""
        if self.table is None:
            self.table = WordTable(self.emissions)
        idx, rows = self.table.batch(texts)
        n = np.array([len(i) for i in idx])
        k = len(self.labels)
        flat = rows[np.concatenate(idx)] if n.sum() else np.zeros((0, k + 1))
        gamma = forward_backward(flat[:, :k], n, np.exp(self.transitions))
        letters = flat[:, k]
        ends = np.cumsum(n)
        sums = ragged_sum(gamma * letters[:, None], np.arange(n.sum()), n)
        count = ragged_sum(letters, np.arange(n.sum()), n)
        return (sums, count, np.split(gamma, ends[:-1])) if words else (sums, count)

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """The words of a text, each with its likeliest label (UNKNOWN without letters)."""
        _, _, (g,) = self.marginal_sums([text], words=True)
        return [(w, self.labels[p.argmax()] if bare(w) else UNKNOWN) for w, p in zip(text.split(), g)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums, count = self.marginal_sums(texts)
        return [(self.labels[s.argmax()], min(1.0, float(s.max() / c))) if c else (UNKNOWN, 0.0) for s, c in zip(sums, count)]


def forward_backward(log_e: np.ndarray, lengths: np.ndarray, a: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Label marginals of sequences that lie one after another.

    log_e: (positions, labels); a: transition potentials.  Sequences are cut
    into chunks whose transfer matrices are formed in step; messages then pass
    from chunk to chunk, and once more through all chunks in step.  Exact."""
    k, total = a.shape[0], int(lengths.sum())
    if not total:
        return np.zeros((0, k))
    e = np.exp(np.maximum(log_e - log_e.max(axis=1, keepdims=True), -60.0))
    a = a / a.max()
    per = -(-lengths // chunk)
    owner = np.repeat(np.arange(len(lengths)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + place * chunk
    size = np.minimum(chunk, np.repeat(np.cumsum(lengths), per) - start)
    order = np.argsort(-size, kind="stable")
    owner, place, start, size = owner[order], place[order], start[order], size[order]
    c, steps = len(size), int(size[0])
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]  # chunks with over t positions
    m = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for t in range(steps):
        n = active[t]
        x = (m[:n].reshape(-1, k) @ a).reshape(n, k, k) * e[start[:n] + t][:, None, :]
        m[:n] = x / x.max(axis=(1, 2), keepdims=True) if t % 4 == 3 else x
    alpha_in, beta_out = np.ones((c, k)), np.ones((c, k))
    by_place = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[by_place], np.arange(int(place.max()) + 2))
    at = np.zeros(len(lengths), np.int64)
    groups = [by_place[cuts[j] : cuts[j + 1]] for j in range(len(cuts) - 1)]
    norm = lambda v: v / v.sum(axis=-1, keepdims=True)
    for before, here in zip(groups, groups[1:]):
        at[owner[before]] = before
        p = at[owner[here]]
        alpha_in[here] = norm(np.einsum("ck,ckj->cj", alpha_in[p], m[p]))
    for here, before in zip(groups[::-1], groups[-2::-1]):
        at[owner[before]] = before
        p = at[owner[here]]
        beta_out[p] = norm(np.einsum("ckj,cj->ck", m[here], beta_out[here]))
    alpha = np.empty((total, k))
    v = alpha_in
    for t in range(steps):
        n = active[t]
        v[:n] = norm((v[:n] @ a) * e[start[:n] + t])
        alpha[start[:n] + t] = v[:n]
    v = beta_out
    for t in range(steps - 1, -1, -1):
        n = active[t]
        i = start[:n] + t
        alpha[i] *= v[:n]
        v[:n] = norm((e[i] * v[:n]) @ a.T)
    return norm(alpha)


def splice(docs: list[tuple[list[int], int]], k: int, rng, sequences: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and label matrices of sequences spliced from documents (word numbers, label) of k labels."""
    by = [[d for d, y in docs if y == label and d] for label in range(k)]
    have = [i for i in range(k) if by[i]]
    words, labels = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        at = 0
        while at < length:
            y = have[rng.integers(len(have))]
            d = by[y][rng.integers(len(by[y]))]
            n = min(int(rng.integers(3, length + 1)), length - at, len(d))
            i = int(rng.integers(len(d) - n + 1))
            words[s, at : at + n], labels[s, at : at + n] = d[i : i + n], y
            at += n
    return words, labels


def fit(rows: list[tuple[str, str]], sequences: int = SEQUENCES, length: int = LENGTH, epochs: int = 40, rate: float = 0.05, decay: float = 1e-3, buckets: int = BUCKETS, seed: int = 1) -> Crf:
    """A CRF of (text, label) rows, by Adam on the conditional log likelihood."""
    labels = sorted({y for _, y in rows})
    k, rng = max(1, len(labels)), np.random.default_rng(seed)
    counts, known, docs = [Counter() for _ in range(k)], {}, []
    for text, y in rows:
        ws = [b for w in text.split() if (b := bare(w))]
        counts[labels.index(y)].update(ws)
        docs.append(([known.setdefault(w, len(known)) for w in ws], labels.index(y)))
    model = Crf(labels or [UNKNOWN], Features(find_lexicon(counts), buckets), np.zeros((buckets, k)), np.zeros((k, k)))
    if k < 2 or not known:
        return model
    words, gold = splice(docs, k, rng, sequences, length)
    used, words = np.unique(words, return_inverse=True)
    words = words.reshape(gold.shape)
    names = list(known)
    found, owner = model.features.of([names[i] for i in used])
    target = np.zeros((len(used), k))
    np.add.at(target, (words.ravel(), gold.ravel()), 1)
    gold_pairs = np.bincount((gold[:, :-1] * k + gold[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    params = [model.weights, model.transitions]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        log_e = summed(model.weights, found, owner, len(used))[words]
        e, a = np.exp(log_e - log_e.max(axis=2, keepdims=True)), np.exp(model.transitions)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(length):
            x = e[:, t] * (alpha[:, t - 1] @ a if t else a.sum(axis=0))
            alpha[:, t] = x / x.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
            beta[:, t] = x / x.sum(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        pairs = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        expect = np.stack([np.bincount(words.ravel(), gamma[:, :, j].ravel(), len(used)) for j in range(k)], axis=1)
        slope = (target - expect) / sequences
        grads = [np.stack([np.bincount(found, slope[owner, j], buckets) for j in range(k)], axis=1) - decay * model.weights / 10, (gold_pairs - pairs.sum(axis=(0, 1))) / sequences - decay * model.transitions]
        for p, g, (m1, m2) in zip(params, grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-8)
    return model


def sample(docs: DataFrame, by: str, rows: int, seed: int) -> DataFrame:
    """Rows of docs for each value of a column, those of the `rows` ids of least hash.

    A bound on the hash, from one count of ids a value, lets some twice as many
    ids of each value pass, however common it is; only these are ranked.  The
    values are the labels of a model, and few."""
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    n = docs.groupBy(F.col(by).alias("_by")).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n"))
    bound = F.when(F.col("_n") <= 2 * rows + 64, F.lit((1 << 63) - 1)).otherwise(((2 * rows + 64) / F.col("_n") * float(1 << 63)).cast("long"))
    slim = docs.select("doc_id", by, h.alias("h")).join(F.broadcast(n.select("_by", bound.alias("_most"))), F.col(by) == F.col("_by")).where("h <= _most").select("doc_id", by, "h").distinct()
    picked = slim.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("h", "doc_id"))).where(F.col("n") <= rows).select("doc_id").distinct()
    return docs.join(F.broadcast(picked), "doc_id", "left_semi")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 3) -> Crf:
    """A model from the rows of docs with text and lang that are not held out; sample_rows of each language at most."""
    rows = docs.where(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    got = sample(rows, "lang", sample_rows, seed).select("text", "lang", "doc_id").collect()
    return fit([(r.text, r.lang) for r in sorted(got, key=lambda r: (r.doc_id, r.lang, r.text))])


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs.

    Without a model one is trained on docs itself.  Null texts and texts
    without letters get UNKNOWN and score 0; so do all texts if there is
    nothing to learn from.  A null doc_id is not held out.  Rows with equal
    doc_id each give a row, equal texts equal predictions.  Other columns are
    ignored; an empty table gives an empty table."""
    model = model or train(docs)
    shared = ship(docs.sparkSession, model)

    def batch(b):
        m, pred, score = shared(), [], []
        for part in small_batches(b.column(2)):
            for p, s in m.predict(part):
                pred.append(p)
                score.append(s)
        return {"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": pred, "score": score}

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)), "text")
    return per_batch(slim, batch, "doc_id long, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, least: float = 0.3, model: Crf | None = None) -> DataFrame:
    """docs without the rows whose language is UNKNOWN or scored below `least`."""
    model = model or train(docs)
    shared = ship(docs.sparkSession, model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([p != UNKNOWN and s >= least for part in small_batches(column) for p, s in shared().predict(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
