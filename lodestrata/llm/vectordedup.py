"""Embedding near-dedup by collision-counting projections (operator 10).

Distinct vectors are projected on orthonormal directions.  They are cut into
blocks along the widest of them, and blocks meet only where their boxes are
within the largest distance that a link allows; a block of many rows is dealt
to parts first.  Within a pair of blocks every projection
is sorted; around each vector's value lies a window; and the windows' members
are counted per pair over all projections, bit-sliced, 64 pairs at a time.
Pairs that reach the calibrated count are verified by their cosine.  No pair
is emitted: a block pair returns each vector's number of links and one edge to
its local component.
"""
from __future__ import annotations

from math import comb, floor, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut, ship
from .components import components, join
from .vectors import exact_cosine, matrix, unit, valid_vectors

THRESHOLD = 0.9
#: Distinct vectors of a block, about.
BLOCK_ROWS = 4096
#: Rows that the widest directions and the blocks are fitted on, at most.
SAMPLE_ROWS = 8192
#: Projections at most; all directions up to that dimension.
PROJECTIONS = 64
#: Half a window, in standard deviations of a linked pair's difference on a direction.
WIDTH = 1.8
#: Recall of the count for pairs at the threshold.
RECALL = 1 - 1e-9
STEP = 64
#: Directions, the sample's widest, that blocks are cut along.
WIDE = 4


class Projections:
    """Orthonormal directions of one dimension, the windows' half width, the count that linked pairs reach, and the blocks."""

    def __init__(self, x: np.ndarray, threshold: float, n_rows: int = 0, most: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, seed: int = 19):
        """x: unit rows, a sample of n_rows, to take the widest directions and the blocks from."""
        d = x.shape[1]
        rng = np.random.default_rng([seed, d])
        wide = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:WIDE] if len(x) > WIDE else rng.normal(size=(min(d, WIDE), d))
        self.directions = np.linalg.qr(np.concatenate([wide, rng.normal(size=(d - min(d, WIDE), d))]).T)[0].T[: min(most, d)]
        self.threshold, m = threshold, min(most, d)
        #: a linked pair's distance, and so its difference on each direction, is no larger
        self.reach = sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        self.width = WIDTH * self.reach / sqrt(d)
        # squares of the differences sum to reach^2 at most, so few can be over width^2
        sure = m - floor(self.reach**2 / self.width**2) if self.width else 0
        p = 2 * NormalDist().cdf(WIDTH) - 1
        tail, c = 1.0, 0
        while c < m and tail >= RECALL:  # tail: chance of at least c collisions
            tail -= comb(m, c) * p**c * (1 - p) ** (m - c)
            c += 1
        self.least = max(sure, c - 1, 0)
        self._split(x @ self.directions[:WIDE].T, n_rows, block_rows)

    def _split(self, p: np.ndarray, n_rows: int, block_rows: int) -> None:
        """Blocks: the sample is halved along its widest direction until a half stands for block_rows rows at most."""
        side, cut_at, child = [], [], []
        low, high = [], []
        least = max(8, block_rows * len(p) / max(n_rows, 1))

        def grow(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            spread = p[at].max(axis=0) - p[at].min(axis=0) if len(at) else np.zeros(p.shape[1])
            j = int(spread.argmax()) if p.shape[1] else 0
            c = float(np.median(p[at, j])) if len(at) > least and spread[j] > 0 else None
            right = p[at, j] > c if c is not None else None
            if right is None or not right.any():
                low.append(lo)
                high.append(hi)
                return -len(low)  # block i is the node -1 - i
            node = len(side)
            side.append(j)
            cut_at.append(c)
            child.append([0, 0])
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[j], lo2[j] = c, c
            child[node] = [grow(at[~right], lo, hi2), grow(at[right], lo2, hi)]
            return node

        n = p.shape[1]
        self.root = grow(np.arange(len(p)), np.full(n, -1.0), np.full(n, 1.0))
        self.side, self.cut_at, self.child = np.array(side, np.int64), np.array(cut_at), np.array(child, np.int64).reshape(-1, 2)
        self.low, self.high = np.array(low), np.array(high)

    def block(self, x: np.ndarray) -> np.ndarray:
        """The blocks of unit rows."""
        p, at = x @ self.directions[:WIDE].T, np.full(len(x), self.root, np.int64)
        while (inner := at >= 0).any():
            i = np.flatnonzero(inner)
            at[i] = self.child[at[i], (p[i, self.side[at[i]]] > self.cut_at[at[i]]).astype(int)]
        return -1 - at

    def within_reach(self, i: int) -> np.ndarray:
        """The blocks from i on that a linked pair may span: boxes no farther apart than reach."""
        gap = np.maximum(0, np.maximum(self.low[i:] - self.high[i], self.low[i] - self.high[i:]))
        return i + np.flatnonzero((gap**2).sum(axis=1) <= self.reach**2)


def projections(sample: dict[int, np.ndarray], sizes: dict[int, int], threshold: float):
    """A function from a dimension to its Projections; one that the sample lacks is rare, and is one block."""
    known = {d: Projections(x, threshold, sizes[d], block_rows=BLOCK_ROWS) for d, x in sample.items()}

    def get(dim: int) -> Projections:
        if dim not in known:
            known[dim] = Projections(np.zeros((0, dim)), threshold)
        return known[dim]

    return get


def _windows(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column its sorted values, and bitmaps of the first 0, STEP, 2 STEP, ... rows in that order."""
    n = len(points)
    steps = -(-n // STEP)
    out = []
    for col in points.T:
        order = np.argsort(col, kind="stable")
        seen = np.zeros((steps + 1, -(-n // 64) * 64), bool)
        seen[np.arange(n) // STEP + 1, order] = True
        np.logical_or.accumulate(seen, axis=0, out=seen)
        out.append((col[order], np.packbits(seen, axis=1, bitorder="little").view(np.uint64)))
    return out


def count_collisions(windows, queries: np.ndarray, width: float, least: int) -> np.ndarray:
    """Bitmaps (queries, words) of the points that at least `least` of a query's windows hold.

    Windows are rounded outwards to STEP ranks, so none is counted too little."""
    planes: list[np.ndarray] = []
    waiting: list[np.ndarray | None] = []

    def add(level: int, x: np.ndarray) -> None:
        if level == len(planes):
            planes.append(x)
            waiting.append(None)
        elif waiting[level] is None:
            waiting[level] = x
        else:
            y, waiting[level] = waiting[level], None
            half = planes[level] ^ y
            carry = (planes[level] & y) | (half & x)
            planes[level] = half ^ x
            add(level + 1, carry)

    for j, (values, before) in enumerate(windows):
        q = queries[:, j]
        lo = np.searchsorted(values, q - width, "left") // STEP
        hi = -(-np.searchsorted(values, q + width, "right") // STEP)
        add(0, before[hi] ^ before[lo])
    level = 0
    while level < len(planes):
        if waiting[level] is not None:
            y, waiting[level] = waiting[level], None
            carry = planes[level] & y
            planes[level] = planes[level] ^ y
            add(level + 1, carry)
        level += 1
    if least >> len(planes):
        return np.zeros_like(planes[0])
    ge = np.full_like(planes[0], ~np.uint64(0))
    for i, p in enumerate(planes):
        ge = p & ge if least >> i & 1 else p | ge
    return ge


def link_blocks(known):
    """Grouped function: counts the links within a part of a block, or between the two parts of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf.dim.iloc[0])
        proj = known()(dim)
        pdf = pdf.sort_values(["second", "node"])
        side, copies = pdf.second.to_numpy(), pdf.copies.to_numpy()
        x = matrix(pdf.vec, dim)
        ux = unit(x)
        p = ux @ proj.directions.T
        first, second = np.flatnonzero(~side), np.flatnonzero(side)
        if pdf.alone.iloc[0]:
            second = first
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        if len(first) and len(second):
            windows = _windows(p[second])
            for k in range(0, len(first), 256):
                q = first[k : k + 256]
                hit = count_collisions(windows, p[q], proj.width, proj.least)
                some = np.unpackbits(np.bitwise_or.reduce(hit, axis=0).view(np.uint8), bitorder="little")[: len(second)].nonzero()[0]
                if not len(some):
                    continue
                to = second[some]
                s = ux[q] @ ux[to].T
                ok = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, some].astype(bool) & (s >= proj.threshold - 1e-9)
                a, b = np.nonzero(ok & (s < proj.threshold + 1e-9))
                ok[a, b] = exact_cosine(x[q[a]], x[to[b]]) >= proj.threshold
                ok &= q[:, None] != to[None]
                links[q] += ok @ copies[to]
                if second is not first:
                    links[to] += copies[q] @ ok
                a, b = np.nonzero(ok)
                join(label, q[a], to[b])
        node = pdf.node.to_numpy()
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        got = links > 0
        return pd.DataFrame({"node": node[got], "links": links[got], "root": least[label[got]]})

    return run


def _block_pairs(counts: DataFrame, known) -> DataFrame:
    """(dim, own, part, i, a, j, b, second): for each part of a block the pairs of parts that it takes part in.

    counts: (dim, own, parts).  Pairs of blocks come from their boxes, on the executors."""

    def partners(it):
        for pdf in it:
            out = [(dim, i, np.array(known()(dim).within_reach(i), np.int64)) for dim, i in zip(pdf.dim.tolist(), pdf.own.tolist())]
            if out:
                n = [len(js) for *_, js in out]
                yield pd.DataFrame({"dim": np.repeat([o[0] for o in out], n), "i": np.repeat([o[1] for o in out], n), "j": np.concatenate([o[2] for o in out])})

    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part = counts.withColumn("a", upto("parts"))
    near = counts.select("dim", "own").mapInPandas(partners, "dim long, i long, j long")
    pair = near.join(part.select("dim", F.col("own").alias("i"), "a"), ["dim", "i"]).join(part.select("dim", F.col("own").alias("j"), F.col("a").alias("b")), ["dim", "j"])
    pair = cut(pair.where((F.col("i") < F.col("j")) | (F.col("a") <= F.col("b"))).select("dim", "i", "a", "j", "b"))
    alone = (F.col("i") == F.col("j")) & (F.col("a") == F.col("b"))
    left = pair.select("*", F.col("i").alias("own"), F.col("a").alias("part"), F.lit(False).alias("second"), alone.alias("alone"))
    return left.union(pair.where(~alone).select("*", F.col("j").alias("own"), F.col("b").alias("part"), F.lit(True).alias("second"), F.lit(False).alias("alone")))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; cosine of at least threshold (over 0) links.

    Vectors of one dimension are compared, whichever it is.  Vectors that
    valid_vectors leaves out link with nothing: n_links 0, component_id their
    own vec_id, kept.  Equal vectors link, and are compared with the rest
    once, by their least vec_id.  Rows with equal vec_id each give a row (rows
    with a null one have a null component).  Other columns are ignored; an
    empty table gives an empty table."""
    spark = rows.sparkSession
    valid = cut(valid_vectors(rows))
    head = valid.select("vec", "dim").orderBy(F.xxhash64("vec_id", F.lit(23)), "vec_id").limit(SAMPLE_ROWS).collect()
    by: dict[int, list] = {}
    for r in head:
        by.setdefault(r["dim"], []).append(bytes(r["vec"]))
    sizes = dict(valid.groupBy("dim").agg(F.count("*")).collect())
    known = ship(spark, projections({d: unit(matrix(v, d)) for d, v in by.items()}, sizes, threshold))

    def place(it):
        for pdf in it:
            for dim, part in pdf.groupby("dim", sort=True):
                yield part.assign(own=known()(int(dim)).block(unit(matrix(part.vec, int(dim)))))

    reps = valid.groupBy("digest", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id())
    reps = cut(reps.mapInPandas(place, "digest binary, dim long, rep long, copies long, vec binary, node long, own long"))
    counts = cut(reps.groupBy("dim", "own").agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).alias("parts")))
    dealt = reps.join(counts, ["dim", "own"]).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    pair = ["dim", "i", "a", "j", "b"]
    grouped = dealt.join(_block_pairs(counts, known), ["dim", "own", "part"]).select(*pair, "alone", "second", "node", "copies", "vec")
    found = cut(grouped.groupBy(*pair).applyInPandas(link_blocks(known), "node long, links long, root long"))
    comp = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(comp, "node", "left")
    info = cut(reps.drop("vec", "own").join(links, "node", "left"))
    least = info.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    info = info.join(least, "component", "left").select("digest", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    good = valid.select("vec_id", "digest", "dim").join(info, ["digest", "dim"]).select("vec_id", "n_links", "component_id")
    # the rest of the rows: one without a valid vector may share its id with one that has
    part = rows.select(F.col("vec_id").cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n")).join(good.groupBy("vec_id").agg(F.count("*").alias("g")), "vec_id", "left")
    rest = part.where("n > coalesce(g, 0)").select("vec_id", F.explode(F.sequence(F.coalesce("g", F.lit(0)) + 1, F.col("n"))).alias("x")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT DISTINCT a AS x, a AS y FROM link UNION SELECT r.x, l.b FROM reach r JOIN link l ON r.y = l.a),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN comp c ON c.x = e.vec_id
"""
