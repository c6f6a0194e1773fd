"""Approximate nearest neighbours by a forest of random-projection trees (operator 9).

A tree has one random direction a level, orthonormal within the tree, and a
median cut at each node.  Directions and cuts are fitted on a bounded sample;
every row is indexed, in one leaf of each tree, and the depth grows with the
number of rows, so that leaves stay small.  A query walks all trees through
one priority queue, ordered by the squared margins on the way, until it has
visited the number of leaves that gave the wanted recall on sampled queries,
whose true neighbours are sought among all rows.
Leaves and their queries meet in buckets of adjoining leaves; a query is
compared with the rows of the leaves that it visits, by the exact cosine, and
keeps its best of the bucket.
"""
from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, ship
from .vectors import exact_cosine, matrix, unit, valid_vectors

TREES = 8
#: Rows of a leaf, about; levels at most.
LEAF_ROWS, MOST_DEPTH = 64, 24
#: Levels whose nodes have cuts of their own; a deeper level has one cut.
NODE_LEVELS = 10
#: Rows that the forests are fitted and their search calibrated on, at most.
SAMPLE_ROWS = 8192
#: Recall that the search effort is calibrated to; the margin over 0.9 is for other queries.
RECALL = 0.96
#: Queries of a dimension that it is calibrated on, at most.
QUERIES = 200
#: Leaves of a bucket, and rows and queries of a bucket that meet in one group at most, about.
BUCKET_BITS, GROUP_ROWS, GROUP_QUERIES = 5, 4096, 4096


class Forest:
    """Trees of `depth` levels.  A leaf's number is its tree's, then a bit for each level."""

    def __init__(self, x: np.ndarray, n_rows: int, trees: int = TREES, depth: int | None = None, leaf_rows: int = LEAF_ROWS, seed: int = 13):
        """x: unit rows, a sample of n_rows."""
        rng, d = np.random.default_rng([seed, x.shape[1]]), x.shape[1]
        self.trees = trees
        self.depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(n_rows, 1) / leaf_rows))))) if depth is None else depth
        self.normals = np.empty((trees, self.depth, d))
        for t in range(trees):
            r = rng.normal(size=(d, self.depth))
            r[:, :d] = np.linalg.qr(r[:, :d])[0]
            self.normals[t] = (r / np.linalg.norm(r, axis=0)).T
        p = self._projected(x)
        self.cuts: list[np.ndarray] = []
        at = np.zeros((len(x), trees), np.int64)
        for level in range(self.depth):
            nodes = 1 << level if level < NODE_LEVELS else 1
            cuts = np.zeros((trees, nodes))
            for t in range(trees):
                own, node = p[:, t, level], at[:, t] if nodes > 1 else np.zeros(len(x), np.int64)
                cuts[t] = np.median(own) if len(own) else 0.0
                order = np.argsort(node, kind="stable")
                found, begin = np.unique(node[order], return_index=True)
                for i, part in zip(found, np.split(own[order], begin[1:])):
                    cuts[t, i] = np.median(part)
            self.cuts.append(cuts)
            at = 2 * at + (p[:, :, level] > self._cut(level, at))
        self.leaves, self.visits = trees << self.depth, trees << self.depth
        #: rows of each leaf, where the sample holds all rows
        self.sizes = np.bincount((at + (np.arange(trees) << self.depth)).ravel(), minlength=self.leaves) if len(x) >= n_rows else None

    def _projected(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.normals.reshape(-1, x.shape[1]).T).reshape(len(x), self.trees, self.depth)

    def _cut(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.cuts[level][np.arange(self.trees), at if level < NODE_LEVELS else 0]

    def place(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaves that rows fall in."""
        p, at = self._projected(x), np.zeros((len(x), self.trees), np.int64)
        for level in range(self.depth):
            at = 2 * at + (p[:, :, level] > self._cut(level, at))
        return at + (np.arange(self.trees) << self.depth)

    def walk(self, q: np.ndarray):
        """The leaves of a unit query, the nearest first, from one queue over all trees."""
        p = self._projected(q[None])[0].tolist()
        cuts = [c.tolist() for c in self.cuts]
        heap = [(0.0, t, 0, 0) for t in range(self.trees)]
        while heap:
            cost, t, level, at = heapq.heappop(heap)
            row = p[t]
            while level < self.depth:
                m = row[level] - cuts[level][t][at if level < NODE_LEVELS else 0]
                near = 2 * at + (m > 0)
                level += 1
                heapq.heappush(heap, (cost + m * m, t, level, near ^ 1))
                at = near
            yield t << self.depth | at

    def search(self, q: np.ndarray, k: int) -> list[int]:
        """The leaves that a query visits: `visits`, and on a small table as many as hold k other rows in one tree."""
        out, seen = [], np.zeros(self.trees, np.int64)
        for leaf in self.walk(q):
            if self.sizes is None:
                if len(out) >= self.visits:
                    break
            else:
                if len(out) >= self.visits and seen.max() > k:
                    break
                seen[leaf >> self.depth] += self.sizes[leaf]
            out.append(leaf)
        return out

    def calibrate(self, queries: np.ndarray, near: list[np.ndarray], recall: float = RECALL) -> None:
        """Sets visits to the fewest leaves that find the share `recall` of the queries' nearest rows, given as unit rows each."""
        if not any(map(len, near)):
            return
        leaves, most = [self.place(n).tolist() for n in near], min(1024, self.leaves)
        while True:
            need = []
            for q, rows in zip(queries, leaves):
                order = {leaf: r + 1 for r, leaf in enumerate(islice(self.walk(q), most))}
                need += [min(order.get(leaf, self.leaves + 1) for leaf in own) for own in rows]
            self.visits = int(np.sort(need)[max(0, int(np.ceil(recall * len(need))) - 1)])
            if self.visits <= most:
                return
            most = min(4 * most, self.leaves)


def true_nearest(v: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> dict[int, list[np.ndarray]]:
    """By brute force over all rows of v, the unit rows of each query's k nearest.

    queries: ids and unit rows by dimension; a stated set, which meets all
    rows in blocks.  Each task keeps k rows a query."""
    asked = ship(v.sparkSession, queries)

    def run(it):
        best: dict[int, tuple] = {}
        for pdf in it:
            for dim, part in pdf.groupby("dim"):
                if dim not in asked():
                    continue
                ids, q = asked()[dim]
                x, own = unit(matrix(part.vec, int(dim))), part.vec_id.to_numpy()
                s = q @ x.T
                s[ids[:, None] == own[None]] = -np.inf
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                score, rows = np.take_along_axis(s, at, 1), x[at]
                if dim in best:
                    score, rows = np.concatenate([best[dim][0], score], axis=1), np.concatenate([best[dim][1], rows], axis=1)
                    at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    score, rows = np.take_along_axis(score, at, 1), np.take_along_axis(rows, at[:, :, None], 1)
                best[dim] = score, rows
        for dim, (score, rows) in best.items():
            a, b = np.nonzero(np.isfinite(score))
            yield pd.DataFrame({"dim": np.full(len(a), dim), "q": a, "score": score[a, b], "vec": [r.tobytes() for r in rows[a, b]]})

    found = v.select("dim", "vec_id", "vec").mapInPandas(run, "dim long, q long, score double, vec binary")
    w = Window.partitionBy("dim", "q").orderBy(F.desc("score"), "vec")
    out: dict[int, list] = {d: [[] for _ in ids] for d, (ids, _) in queries.items()}
    for r in found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("dim", "q", "vec").collect():
        out[r["dim"]][r["q"]].append(np.frombuffer(r["vec"]))
    return {d: [np.array(rows).reshape(-1, d) for rows in per] for d, per in out.items()}


def fit(rows: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS, seed: int = 17, queries: int = QUERIES, **options) -> dict[int, Forest]:
    """Forests of a sample of valid rows, by the dimension; one that the sample lacks is rare and has none.

    Their search is calibrated on some sampled queries and their true neighbours among all rows."""
    got = rows.select("vec_id", "vec", "dim").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).collect()
    sizes = dict(rows.groupBy("dim").count().collect())
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["dim"], []).append((r["vec_id"], bytes(r["vec"])))
    out, asked = {}, {}
    for dim, own in by.items():
        x = unit(matrix([vec for _, vec in own], dim))
        out[dim], asked[dim] = Forest(x, sizes[dim], **options), (np.array([i for i, _ in own[:queries]]), x[:queries])
    for dim, near in true_nearest(rows, asked, k).items():
        out[dim].calibrate(asked[dim][1], near)
    return out


def best_of_bucket(k: int):
    """Cogrouped function: each query's k best of a group's rows in the leaves that it visits."""

    def run(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(q.dim.iloc[0])
        rows = rows.sort_values(["leaf", "vec_id"])
        ids, leaf, x = rows.vec_id.to_numpy(), rows.leaf.to_numpy(), matrix(rows.vec, dim)
        qi, qv = q.query_id.to_numpy(), matrix(q.vec, dim)
        ux, uq = unit(x), unit(qv)
        lists = [np.asarray(v, np.int64) for v in q.leaves]
        asked, owner = np.concatenate(lists), np.repeat(np.arange(len(q)), [len(v) for v in lists])
        order = np.argsort(asked, kind="stable")
        asked, owner = asked[order], owner[order]
        least = np.full(len(q), -np.inf)  # of what a query has found, the k-th best or less
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for one, a, b in zip(*_runs(leaf)):
            at, to = np.searchsorted(asked, [one, one + 1])
            for i in range(at, to, 512):
                own = owner[i : min(i + 512, to)]
                s = uq[own] @ ux[a:b].T
                s[qi[own][:, None] == ids[a:b][None]] = -np.inf
                if b - a >= k:
                    least[own] = np.maximum(least[own], np.partition(s, b - a - k, axis=1)[:, b - a - k])
                u, v = np.nonzero((s >= least[own][:, None] - 1e-9) & np.isfinite(s))  # rounding must not choose among equals
                pairs.append((own[u], v + a))
        if not pairs:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = (np.concatenate(v) for v in zip(*pairs))
        score = np.concatenate([exact_cosine(qv[a[i : i + 100_000]], x[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)] or [np.zeros(0)])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pd.DataFrame({"query_id": qi[a[keep]], "vec_id": ids[b[keep]], "score": score[keep]})

    return run


def _runs(sorted_values: np.ndarray) -> tuple[list, list, list]:
    """The distinct values, and where each begins and ends."""
    found, begin = np.unique(sorted_values, return_index=True)
    return found.tolist(), begin.tolist(), np.append(begin[1:], len(sorted_values)).tolist()


def nearest(rows: DataFrame, every: int = 50, k: int = 5, forests: dict[int, Forest] | None = None, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k nearest found.

    Ties go to the smaller vec_id; a query's own id is no candidate.  Vectors
    that valid_vectors leaves out take no part; a cosine exists between
    vectors of one dimension only, and each dimension has its own forest (one
    so rare that the sample lacks it is a single leaf).  Rows with equal
    vec_id count as one candidate, or one query, with the best score.  Other
    columns are ignored; an empty table gives an empty table; with k
    candidates or fewer all are returned."""
    v = cut(valid_vectors(rows))
    forests = fit(v, k, **options) if forests is None else forests
    known = ship(rows.sparkSession, forests)

    def per_dim(it, fn):
        for pdf in it:
            for dim, part in pdf.groupby("dim", sort=True):
                yield from fn(int(dim), part, known().get(int(dim)), unit(matrix(part.vec, int(dim))))

    def place(it):
        def one(dim, part, forest, x):
            leaves = forest.place(x) if forest else np.zeros((len(x), 1), np.int64)
            yield pd.DataFrame({"dim": part.dim, "vec_id": part.vec_id, "leaf": list(leaves), "vec": part.vec})

        return per_dim(it, one)

    def visit(it):
        def one(dim, part, forest, x):
            out = {"dim": [], "query_id": [], "bucket": [], "leaves": [], "vec": []}
            for i, vec, q in zip(part.vec_id, part.vec, x):
                leaves = np.sort(forest.search(q, k)) if forest else np.zeros(1, np.int64)
                for bucket, a, b in zip(*_runs(leaves >> shift(forest))):
                    for c, value in zip(out, (dim, i, bucket, leaves[a:b], vec)):
                        out[c].append(value)
            yield pd.DataFrame(out)

        return per_dim(it, one)

    def shift(forest):
        return min(BUCKET_BITS, forest.depth) if forest else 0

    # one row a dimension that has a forest
    bits = F.create_map(*[F.lit(x) for d, f in forests.items() for x in (d, shift(f))]) if forests else F.create_map().cast("map<int,int>")
    held = v.select("dim", "vec_id", "vec").mapInPandas(place, "dim long, vec_id long, leaf array<long>, vec binary").select("dim", "vec_id", "vec", F.explode("leaf").alias("leaf"))
    held = held.withColumn("bucket", F.call_function("shiftright", F.col("leaf"), F.coalesce(F.try_element_at(bits, F.col("dim").cast("int")), F.lit(0))))
    asked = cut(v.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "vec").mapInPandas(visit, "dim long, query_id long, bucket long, leaves array<long>, vec binary"))
    # a bucket's rows are dealt to parts and its queries to blocks; nearly all buckets have one of each
    key = ["dim", "bucket"]
    parts = cut(held.groupBy(*key).agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts")).join(asked.groupBy(*key).agg(F.ceil(F.count("*") / GROUP_QUERIES).alias("blocks")), key))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = held.join(parts, key).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("block", upto("blocks"))
    asked = asked.join(parts, key).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("part", upto("parts"))
    key += ["part", "block"]
    found = asked.select(*key, "query_id", "leaves", "vec").groupBy(*key).cogroup(held.select(*key, "vec_id", "leaf", "vec").groupBy(*key)).applyInPandas(best_of_bucket(k), "query_id long, vec_id long, score double")
    # both steps use one shuffle, by the query
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
