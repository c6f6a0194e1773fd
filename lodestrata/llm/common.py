"""Helpers shared by the corpus operators."""
from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.util import cut, shared_dir  # noqa: F401

#: White space of the text contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, value):
    """A function that gives `value` on executors: it is broadcast with its code and unpacked once a worker."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load():
        if not hasattr(shared, "_unpacked"):
            shared._unpacked = pickle.loads(shared.value)
        return shared._unpacked

    return load


def per_batch(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow where fn maps one RecordBatch to a dict of column lists."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(fn(b))

    return df.mapInArrow(run, schema)


def small_batches(column, chars: int = 1_000_000):
    """The column's texts as lists of about so many characters."""
    part, n = [], 0
    for t in column:
        t = t.as_py()
        part.append(t)
        n += len(t or "") + 50
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def held_out(doc_id, modulus: int, residue: int):
    return F.crc32(doc_id.cast("string")) % modulus == residue
