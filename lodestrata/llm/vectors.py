"""Vectors as bytes, and what takes part in cosine operators."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec, dim, digest): components in bytes, of vectors that take part.

    Floats stay floats, all other numbers become doubles.  Null, empty and zero
    vectors, vectors with null or non-finite components and rows without an id
    take no part."""
    single = dict(rows.dtypes)[embedding] == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")

    def run(batches):
        for b in batches:
            vecs = b.column(1)
            flat = vecs.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zeros; null is nan
            at = vecs.offsets.to_numpy()
            total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
            bad, some = total(~np.isfinite(flat)), total(flat != 0)
            start, stop = at[:-1], at[1:]
            good = (bad[stop] == bad[start]) & (some[stop] > some[start]) & vecs.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(good)
            data, w = flat.tobytes(), kind.itemsize
            parts = [data[x * w : y * w] for x, y in zip(start[pick].tolist(), stop[pick].tolist())]
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0).take(pa.array(pick)), "vec": pa.array(parts, pa.binary()), "dim": (stop - start)[pick].astype(np.int64),
                "digest": pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary())})

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), embedding if single else F.col(embedding).cast("array<double>")).mapInArrow(run, "vec_id long, vec binary, dim long, digest binary")


def matrix(column, dim: int) -> np.ndarray:
    """Rows of `dim` doubles from byte strings, each scaled by a power of two to a largest component in [0.5, 1).

    The scale changes no cosine, and squares neither over- nor underflow."""
    data = list(column)
    if not data:
        return np.zeros((0, dim))
    x = np.frombuffer(b"".join(data), "<f4" if len(data[0]) == 4 * dim else "<f8").reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in one order of operations wherever the rows stand."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
