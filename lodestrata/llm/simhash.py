"""SimHash near-dedup with pivot distance tables (operator 7).

Every distinct fingerprint gets its Hamming distances to reference
fingerprints (pivots).  The 64 bits are cut into BLOCKS blocks.  Some pivots
are confined to one block: the distance to such a pivot, less the distance to
the zero fingerprint, depends on that block only.  Two fingerprints that
differ in at most LIMIT bits agree on at least BLOCKS - LIMIT blocks, and so
on the relative distances of those blocks' pivots; these are the join keys.
Eight more pivots spread over all bits: a pair whose distances to any of them
differ by more than LIMIT is discarded (triangle inequality), and the
survivors are verified bit by bit.  No pair within the limit is lost.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, per_batch
from .components import components

LIMIT = 2
BLOCKS = 5
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data, k = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], SEED) for a, b in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], "<u8")
    on = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        on += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(on * 2 > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bit pattern as a signed long."""

    def batch(b):
        return {"doc_id": b.column(0), "fp": [_signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, fp long")


def _blocks() -> list[int]:
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def pivots(per_block: int = 6, spread: int = 8, seed: int = 7) -> tuple[list[list[int]], list[int]]:
    """Reference fingerprints: per_block of them inside each block, and spread over all bits."""
    rng = np.random.default_rng(seed)
    draw = lambda: int(rng.integers(0, 1 << 64, dtype=np.uint64))
    return [[draw() & m for _ in range(per_block)] for m in _blocks()], [draw() for _ in range(spread)]


def _distance(fp, p: int):
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("long")))


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints at most limit (0 to LIMIT) bits apart.

    fps: a column fp of distinct values, and rep; a and b are the pair's reps.
    Keys are exploded, never pairs; what leaves the join has been verified."""
    near, far = pivots()
    fp, masks = F.col("fp"), _blocks()
    zero = F.bit_count(fp)
    sets = list(combinations(range(BLOCKS), BLOCKS - LIMIT))
    keys = [F.struct(F.lit(k).cast("byte").alias("k"), F.xxhash64(*[_distance(fp, p) - zero for i in s for p in near[i]]).alias("key")) for k, s in enumerate(sets)]
    # the table of distances to the spread pivots, one byte each
    packed = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(_distance(fp, p).cast("long"), 7 * i) for i, p in enumerate(far)])
    t = fps.select("fp", "rep", packed.alias("d"), F.explode(F.array(*keys)).alias("x")).select("fp", "rep", "d", "x.k", "x.key")
    x, y = t.alias("x"), t.alias("y")
    at = lambda side, i: F.shiftright(F.col(f"{side}.d"), 7 * i).bitwiseAND(F.lit(127))
    close = reduce(lambda p, q: p & q, [F.abs(at("x", i) - at("y", i)) <= limit for i in range(len(far))])
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    # a pair may agree on several keys; only the first counts
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(_signed(sum(masks[i] for i in s))).cast("long")) == 0, k) for k, s in enumerate(sets)])
    hit = (F.col("x.k") == F.col("y.k")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & close & (F.bit_count(diff) <= limit) & (first == F.col("x.k"))
    return x.join(y, hit).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.bit_count(diff).alias("distance"))


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Null and wordless texts have fingerprint zero and link like any other;
    shorter texts hash their whole word sequence.  Rows with equal doc_id each
    give a row; a null doc_id takes part with component_id of its group's
    smallest non-null id (null if there is none).  Further columns of docs are
    ignored.  An empty table gives an empty table."""
    own = cut(fingerprints(docs, shingle))
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    comp = components(links(fps, limit))
    whole = fps.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(whole, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, limit: int = LIMIT) -> DataFrame:
    """docs without those whose group holds a smaller doc_id; of rows with equal doc_id all stay."""
    gone = near_duplicates(docs, shingle, limit).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
