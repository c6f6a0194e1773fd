"""The pipeline's near-duplicate stage against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import neardup


def brute(rows):
    """doc_ids that a document of smaller id leads to over pairs of similarity 0.8 and more."""
    words = {d: t.lower().split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for a in sets:
        for b in sets:
            if a < b and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    pairs += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d for d in root if find(d) != d}, pairs


def corpus():
    """Texts of 40 to 300 words with chains of copies that differ in a few words, and unrelated ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows = []
    for _ in range(60):
        w = [word() for _ in range(rng.randrange(40, 300))]
        for _ in range(4):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 50)):
                w[rng.randrange(len(w))] = word()
    return rows


def test_stage_like_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    want, pairs = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
    gone = {d for d, _ in rows} - kept
    assert pairs > 100 and gone <= want and len(want - gone) <= 0.01 * len(want)


def test_blocks_of_a_cluster(spark, monkeypatch):
    rows = corpus()[:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.groups(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 2)
    assert {(r.doc_id, r.component_id) for r in neardup.groups(docs).collect()} == got


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, of which few pairs are similar enough: no pair of them is emitted but what spans."""
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in neardup.groups(docs).where("doc_id > component_id").collect()}
    assert gone == brute(rows)[0] and 50 < len(gone) < 299
    texts = neardup._own(docs, True).withColumn("comp", F.col("th"))
    assert neardup.candidates(texts, range(8)).count() < 8 * 300


def test_similar_pairs_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(40)]
    want = {(i, j) for i in range(15) for j in range(25) if neardup.jaccard(set(sets[i]), set(sets[15 + j])) >= 0.3 and len(sets[i]) + len(sets[15 + j])}
    assert set(zip(*(x.tolist() for x in neardup.similar_pairs(sets[:15], sets[15:], 0.3, width=7)))) == want


def test_odd_rows(odd, empty):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 2 and ids.count(None) == 1 and not {3, 5, 8} & set(ids) and {1, 2, 4, 6, 9, 10} <= set(ids)
    assert neardup.keep_one(empty).count() == 0


def test_recall_is_calibrated():
    assert neardup.missed() < 0.01 and neardup.missed(0.9) < 0.001
