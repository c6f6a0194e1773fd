"""Bloom filters as sets of bit positions: build, probe, false positives."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bits import shl

BITS, COUNT = 24, 2
#: Filters of up to so many bits (2 MiB, or two million rows of a byte) are broadcast.
BROADCAST_BITS = 24


def positions(h: Column, bits: int = BITS, count: int = COUNT) -> list[Column]:
    """The low parts of a 64-bit hash; bits * count must not be over 64."""
    if bits * count > 64:
        raise ValueError("bits * count is over 64")
    return [F.shiftrightunsigned(h, bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(count)]


def md5_hash(c: Column) -> Column:
    """48 bits of md5 as a hash that other engines have too."""
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("long")


def build(keys: DataFrame, h: Column, bits: int = BITS, count: int = COUNT) -> DataFrame:
    """(byte, value): the filter's bytes that aren't zero; partial aggregates are of bounded size."""
    p = keys.select(F.explode(F.array(*positions(h, bits, count))).alias("p"))
    return p.groupBy(F.shiftright("p", 3).alias("byte")).agg(F.bit_or(shl(F.lit(1), F.col("p").bitwiseAND(F.lit(7)))).alias("value"))


def pack(bloom: DataFrame, bits: int = BITS) -> DataFrame:
    """(filter): the bytes of build() as one binary of 2^(bits - 3) bytes, its serial form."""
    size = 1 << max(0, bits - 3)

    def run(batches):
        data = bytearray(size)
        for pdf in batches:
            for at, value in zip(pdf["byte"], pdf["value"]):
                data[at] = value & 255
        yield pd.DataFrame({"filter": [bytes(data)]})

    return bloom.select("byte", F.col("value").cast("int").alias("value")).coalesce(1).mapInPandas(run, "filter binary")


def unpack(packed: DataFrame) -> DataFrame:
    """The bytes that aren't zero of a packed filter, as build() gives them."""

    def run(batches):
        for pdf in batches:
            for data in pdf["filter"]:
                x = np.frombuffer(data, np.uint8)
                at = np.flatnonzero(x)
                yield pd.DataFrame({"byte": at, "value": x[at].astype(np.int32)})

    return packed.mapInPandas(run, "byte long, value int")


def probe(keys: DataFrame, h: Column, bloom: DataFrame, bits: int = BITS, count: int = COUNT) -> DataFrame:
    """keys with `hit`: whether all positions of a key are set.

    The filter has 2^(bits - 3) bytes at most; up to BROADCAST_BITS it is
    broadcast, and no key is shuffled."""
    out = keys
    for i, p in enumerate(positions(h, bits, count)):
        b = bloom.select(F.col("byte").alias("_b"), F.col("value").alias("_v"))
        b = F.broadcast(b) if bits <= BROADCAST_BITS else b
        out = out.withColumn("_p", p).join(b, F.shiftright("_p", 3) == F.col("_b"), "left")
        out = out.withColumn(f"_h{i}", F.getbit(F.coalesce("_v", F.lit(0)), F.col("_p").bitwiseAND(F.lit(7)).cast("int")) == 1).drop("_b", "_v", "_p")
    hit = F.lit(True)
    for i in range(count):
        hit = hit & F.col(f"_h{i}")
    return out.withColumn("hit", hit).drop(*[f"_h{i}" for i in range(count)])
