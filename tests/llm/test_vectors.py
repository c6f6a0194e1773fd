import os

import numpy as np
import pytest

from lodestrata.llm import ann, vectordedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KIND = "vec_id long, embedding array<double>, label int, rep string, n_links string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "x") for i, v in vectors], KIND)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 16))
    near = base[rng.integers(0, 40, 200)] + rng.normal(size=(200, 16)) * 0.35
    x = np.concatenate([base, near, np.tile(base[0], (30, 1)), np.tile(base[1] * 2, (5, 1))])
    out = [(int(i), list(v)) for i, v in enumerate(x)]
    return out + [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, []), (405, [1.0, 2.0]), (450, [float("inf")] * 16)]


def brute(vectors):
    """Ids of the vectors that take part, and their cosines (-2 between dimensions), scaled so that squares stay finite."""
    good = [(i, np.array(v, float)) for i, v in vectors if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x = [v / np.abs(v).max() for _, v in good]
    s = np.array([[a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else -2.0 for b in x] for a in x])
    return [i for i, _ in good], s


def check_dedup(spark, vectors):
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordedup.near_duplicates(table(spark, vectors)).collect())
    ids, s = brute(vectors)
    near = s >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    label = list(ids)
    while True:
        new = [min([label[i], *[label[j] for j in np.flatnonzero(near[i])]]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    rest = [i for i, v in vectors]
    for i in ids:
        rest.remove(i)
    assert got == sorted([(v, int(near[i].sum()), label[i], v == label[i]) for i, v in enumerate(ids)] + [(v, 0, v, True) for v in rest])


@pytest.mark.parametrize("block", [64, 4096])
def test_dedup_like_brute_force(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(vectordedup, "BLOCK_ROWS", block)
    check_dedup(spark, vectors)


@pytest.mark.parametrize("dim", [128, 768])
def test_dedup_of_many_dimensions(spark, dim):
    """Partners just above the threshold, with differences spread over all axes or on a few."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(90, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = rng.normal(size=(90, dim)) * (rng.random((90, dim)) < np.where(np.arange(90) % 2, 1.0, 4 / dim)[:, None])
    axes -= np.einsum("ij,ij->i", axes, x)[:, None] * x
    size = np.linalg.norm(axes, axis=1, keepdims=True)
    c = rng.uniform(0.9003, 0.92, (90, 1))
    y = c * x + np.sqrt(1 - c**2) * axes / np.where(size > 0, size, 1)
    check_dedup(spark, [(i, list(v)) for i, v in enumerate(np.concatenate([x, y]))])


ODD = [(1, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (150, [3.0, 2.0, 1.0]), (3, [1e200] * 16), (200, [1.1e200] * 16), (5, [1e-200] * 15 + [0.0]), (250, [2e-200] * 15 + [-0.0])]


def test_dedup_of_several_dimensions_and_sizes(spark, vectors):
    check_dedup(spark, vectors[:150] + [(1000 + i, v) for i, v in ODD])


def test_dedup_of_repeated_ids(spark):
    """Each row counts on its own, whatever else has its id."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    check_dedup(spark, [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c)])


def test_window_counts_are_never_short():
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(300, 9)), rng.normal(size=(20, 9))
    true = (np.abs(p[None] - q[:, None]) <= 0.7).sum(axis=2)
    for least in range(1, 10):
        hit = np.unpackbits(vectordedup.count_collisions(vectordedup._windows(p), q, 0.7, least).view(np.uint8), axis=1, bitorder="little")[:, :300]
        assert (hit[true >= least] == 1).all() and (least < 7 or hit.mean() < 0.6)


def test_dedup_empty_and_invalid_only(spark, vectors):
    t = table(spark, vectors)
    assert vectordedup.near_duplicates(t.limit(0)).count() == 0
    assert vectordedup.near_duplicates(table(spark, vectors[-7:-6] + vectors[-6:-5])).count() == 2


def check_neighbours(spark, vectors, **options):
    got = ann.nearest(table(spark, vectors), **options).collect()
    ids, s = brute(vectors)
    for q in [i for i in ids if i % 50 == 0]:
        a = ids.index(q)
        want = sorted((-round(s[a, b], 9), ids[b]) for b in range(len(ids)) if ids[b] != q and s[a, b] > -2)[:5]
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [v for _, v in want] and [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert all(abs(r.score + c) < 1e-8 for r, (c, _) in zip(mine, want))
    assert {r.query_id for r in got} <= {i for i in ids if i % 50 == 0}


def test_neighbours_exact_when_all_leaves_are_visited(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_ROWS", 64)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 3)
    check_neighbours(spark, vectors, forests={16: ann.Forest(np.eye(16), 350, trees=2, depth=3)})


def test_neighbours_of_several_dimensions_and_sizes(spark):
    check_neighbours(spark, ODD)


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7])
def test_neighbours_all_if_few(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    check_neighbours(spark, [(50 * i, list(v)) for i, v in enumerate(x)], leaf_rows=1)


def test_queue_yields_leaves_by_margin():
    """The shared queue is ordered by the squared margins to a leaf, over all trees."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(x, 500, trees=3, depth=4)
    order = list(forest.walk(x[0]))
    assert sorted(order) == list(range(3 << 4)) and set(forest.place(x[:1])[0]) <= set(order[:3])

    def cost(leaf):
        t, total, at = leaf >> 4, 0.0, 0
        for level in range(4):
            m, bit = x[0] @ forest.normals[t, level] - forest.cuts[level][t, at], leaf >> 3 - level & 1
            total, at = total + (m * m if bit != (m > 0) else 0.0), 2 * at + bit
        return total

    costs = [cost(leaf) for leaf in order]
    assert costs == sorted(costs)


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(e).toPandas().groupby("query_id").vec_id.apply(set)
    p = e.toPandas()
    x = np.stack(p.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = np.flatnonzero(p.vec_id % 50 == 0)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = -2
    want = [set(p.vec_id.to_numpy()[np.argsort(-r)[:5]]) for r in s]
    assert np.mean([len(w & got[q]) / 5 for q, w in zip(p.vec_id.to_numpy()[at], want)]) >= 0.9


def test_neighbours_few_and_none(spark, vectors):
    assert ann.nearest(table(spark, vectors[:3])).count() == 2
    assert ann.nearest(table(spark, vectors[:1])).count() == 0 and ann.nearest(table(spark, []).limit(0)).count() == 0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The models reach workers that cannot import the package."""
    import subprocess
    import sys

    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", "file://{tmp_path}/ck").config("spark.sql.warehouse.dir", "file://{tmp_path}/wh").getOrCreate()
sys.path.insert(0, {ROOT!r})
from lodestrata.llm import entry
for name in ("op1_language_id", "op2_quality", "op3_html_text", "op9_ann", "op10_vector_dedup"):
    assert entry.QUERIES[name](spark, "/root/testdata/sf0.001").count(), name
def there(_):
    import importlib.util
    return importlib.util.find_spec("lodestrata") is not None
assert not any(spark.sparkContext.parallelize(range(4), 2).map(there).collect())
print("all fine")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME_TEST")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all fine" in done.stdout, done.stderr[-3000:]
