"""Connected components over an edge table: alternating star contraction, until few edges are left."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Edges that one task solves, at most: some 3 MB.
FEW = 200_000


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(r)


def _solved(e: DataFrame) -> DataFrame:
    """(node, component) of few edges, by one task."""

    def run(batches):
        parts = [pdf[["u", "v"]].to_numpy() for pdf in batches]
        uv = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        if len(uv):
            nodes, at = np.unique(uv, return_inverse=True)
            at, label = at.reshape(-1, 2), np.arange(len(nodes))
            join(label, at[:, 0], at[:, 1])
            yield pd.DataFrame({"node": nodes, "component": nodes[label]})

    return e.coalesce(1).mapInPandas(run, "node long, component long")


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    component is the smallest reachable node.  Loops, repeated and reversed
    edges are allowed; edges with a null end are ignored; an empty table gives
    an empty table.  Up to `few` distinct edges are solved by one task.  More
    take rounds of one large star and one small star step: the minimum of a
    neighbourhood is a partial aggregate, and hot nodes only meet joins that
    adaptive execution can split.  Rounds grow with the logarithm of the
    longest path."""
    e = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).select("u", "v").distinct()
    e = cut(e)
    seen = _state(e)
    while seen[0] > few:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    return _solved(e)


def join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the classes of u and v in label (each row's label: the least row of its class)."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        a, b, u, v = a[differ], b[differ], u[differ], v[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label[:] = nxt
