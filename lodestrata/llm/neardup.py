"""Near-dedup of whole documents for the pipeline: SimHash candidates, exact similarity.

Two texts are near duplicates if the sets of their word shingles (WORDS words)
have a Jaccard similarity of at least SIMILAR.  Candidates come from SimHash
fingerprints of BITS bits and pivot distance tables: TABLES sets of KEY random
bits, each with pivots confined to it; a text's distances to a set's pivots,
less those of the zero fingerprint, depend on the set's bits only and are a
join key.  At similarity 0.8 two fingerprints differ in some 0.15 of their
bits (the angle of the shingle sets), so that they agree on at least one of
the sets in all but about `missed()` of the cases; more similar texts are
missed less.  Texts that meet and are within LIMIT on HEAD bits are joined to
clusters, of which only spanning edges are emitted.  All texts of a cluster
are then compared by their shingles, in pairs of blocks of bounded size; no
pair below SIMILAR is linked, and what is emitted are spanning edges again.
"""
from __future__ import annotations

from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, per_batch
from .components import components, join

WORDS = 5
SIMILAR = 0.8
BITS = 256
KEY = 16
TABLES = 96
PIVOTS = 12
HEAD = 128
#: Pairs at SIMILAR differ in 19.4 of HEAD bits in the mean, with a deviation of 4.1; unrelated ones in 64 and 5.7.
LIMIT = 36
#: Tables that are searched first; the rest seek pairs between the clusters so found.
FIRST = 8
#: Texts and bytes of a cluster's block, about.
BLOCK_TEXTS, BLOCK_BYTES = 512, 4_000_000
SALTS = 32
_MIX = np.random.default_rng(29).integers(0, 1 << 64, 4, dtype=np.uint64)


def missed(similar: float = SIMILAR, tables: int = TABLES, key: int = KEY) -> float:
    """Share of pairs of that similarity, and of sets of equal size, that agree on none of the tables' bits."""
    p = acos(2 * similar / (1 + similar)) / pi
    agree = lambda d: comb(BITS - d, key) / comb(BITS, key)
    return sum(comb(BITS, d) * p**d * (1 - p) ** (BITS - d) * (1 - agree(d)) ** tables for d in range(BITS + 1))


def normal(text: str | None) -> bytes:
    """The text's words, A-Z lower-cased, with one space between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingles(data: bytes, words: int = WORDS) -> set[bytes]:
    """All runs of so many words of a normal text; the whole text if it has fewer."""
    size = np.fromiter(map(len, data.split()), np.int64)
    end = np.cumsum(size + 1) - 1
    k = min(words, len(size))
    return {data[a:b] for a, b in zip((end - size)[: len(size) - k + 1].tolist(), end[k - 1 :].tolist())} if k else set()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def fingerprint(data: bytes) -> np.ndarray:
    """BITS / 64 words: the majority of the distinct shingles' bits; a tie goes to the shingle of lowest hash."""
    h = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(data)), np.uint64))
    if not len(h):
        return np.zeros(BITS // 64, np.uint64)
    on, tie = np.zeros(BITS, np.int64), None
    for i in range(0, len(h), 255):
        x = h[i : i + 255, None] ^ _MIX
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(x), BITS // 8), axis=1, bitorder="little")
        on += bits.sum(axis=0, dtype=np.uint8)
        tie = bits[0] > 0 if tie is None else tie
    return np.packbits((2 * on > len(h)) | (2 * on == len(h)) & tie, bitorder="little").view(np.uint64)


def _tables(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix of BITS rows with a pivot in each column, PIVOTS a table, and factors that mix a table's distances."""
    rng = np.random.default_rng(seed)
    m = np.zeros((BITS, TABLES * PIVOTS), np.float32)
    for t in range(TABLES):
        m[rng.choice(BITS, KEY, replace=False)[:, None], np.arange(t * PIVOTS, (t + 1) * PIVOTS)] = rng.integers(0, 2, (KEY, PIVOTS))
    return m, rng.integers(1, 1 << 63, PIVOTS, dtype=np.int64) | 1


_FPS = [f"f{i}" for i in range(BITS // 64)]


def _own(docs: DataFrame, bits: bool) -> DataFrame:
    """(doc_id, th, f0..) or (doc_id, th, words): th is a 64-bit digest of the normal text."""

    def batch(b):
        data = [normal(t.as_py()) for t in b.column(1)]
        out = {"doc_id": b.column(0), "th": np.array([xxhash.xxh3_64_intdigest(d) for d in data], np.uint64).view(np.int64)}
        if not bits:
            return out | {"words": data}
        fp = np.array([fingerprint(d) for d in data]).view(np.int64)
        return out | {n: np.ascontiguousarray(fp[:, i]) for i, n in enumerate(_FPS)}

    rest = ", ".join(f"{n} long" for n in _FPS) if bits else "words binary"
    return per_batch(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), batch, "doc_id long, th long, " + rest)


def _keys(texts: DataFrame, tables: range) -> DataFrame:
    """(bucket, th, f0, f1, comp): a row for each text and table."""

    def run(batches):
        pivots, factor = _tables()
        pivots = pivots[:, tables.start * PIVOTS : tables.stop * PIVOTS]
        table = np.arange(tables.start, tables.stop, dtype=np.int64) << 48
        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            for i in range(0, b.num_rows, 2000):
                c = {n: v[i : i + 2000] for n, v in cols.items()}
                fp = np.ascontiguousarray(np.stack([c[n] for n in _FPS], axis=1))
                sign = 1 - 2 * np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").astype(np.float32)
                d = (sign @ pivots).astype(np.int64).reshape(len(fp), len(tables), PIVOTS) @ factor
                key = (d ^ (d >> 29)) & ((1 << 48) - 1) | table
                rows = {n: np.repeat(c[n], len(tables)) for n in ("th", "f0", "f1", "comp")}
                yield pa.RecordBatch.from_pydict({"bucket": key.ravel()} | rows)

    return texts.select("th", *_FPS, "comp").mapInArrow(run, "bucket long, th long, f0 long, f1 long, comp long")


def _meet(c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket within LIMIT and of different comp: of each row with the first such, and with all after it that aren't in its class yet."""
    bucket, comp = c["bucket"], c["comp"]
    # bitwise_count takes the absolute value of signed numbers
    f0, f1 = c["f0"].view(np.uint64), c["f1"].view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    start = np.repeat(begin, np.diff(np.append(begin, len(bucket))))
    label = np.arange(len(bucket))
    b, k = np.arange(len(bucket)), 0
    pairs = []
    while len(b := b[start[b] + k < b]):
        a = start[b] + k
        apart = label[a] != label[b]
        x, y = a[apart], b[apart]
        near = (np.bitwise_count(f0[x] ^ f0[y]).astype(np.int64) + np.bitwise_count(f1[x] ^ f1[y]) <= LIMIT) & (comp[x] != comp[y])
        if near.any():
            x, y = x[near], y[near]
            pairs.append((x, y))
            join(label, x, y)
        k += 1
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*pairs)) if pairs else (none, none)


def candidates(texts: DataFrame, tables: range = range(TABLES)) -> DataFrame:
    """Distinct (a, b): spanning edges of the texts that share a bucket, are within LIMIT and differ in comp.

    texts: th, f0.., comp.  What a task has joined in one bucket it doesn't name again in another."""

    def run(batches):
        above, held = {}, []

        def top(x):
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def out(parts):
            c = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
            x, y = _meet(c)
            new = []
            for a, b in zip(c["th"][x].tolist(), c["th"][y].tolist()):
                p, q = top(a), top(b)
                if p != q:
                    above[max(p, q)] = min(p, q)
                    new.append((a, b))
            if len(above) > 1_000_000:
                above.clear()
            if new:
                a, b = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            last = int(np.searchsorted(c["bucket"], c["bucket"][-1]))
            if last or held and held[-1]["bucket"][-1] != c["bucket"][0]:
                yield from out(held + [{n: v[:last] for n, v in c.items()}])
                held = []
            held.append({n: v[last:] for n, v in c.items()})
        if held:
            yield from out(held)

    return _keys(texts, tables).repartition("bucket").sortWithinPartitions("bucket", "th").mapInArrow(run, "a long, b long").distinct()


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray], similar: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the sets a[i] and b[j], as arrays of distinct hashes, whose Jaccard similarity is at least `similar`."""
    both = [*a, *b]
    size = np.array([len(x) for x in both])
    row = np.repeat(np.arange(len(both)), size)
    _, column, times = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    some = times > 1  # others are in no intersection
    at = np.cumsum(some) - 1
    row, column = row[some[column]], at[column[some[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(a), len(b)))
    for k in range(0, int(some.sum()), width):
        i, j = np.searchsorted(column, [k, k + width])
        m = np.zeros((len(both), width), np.float32)
        m[row[i:j], column[i:j] - k] = 1
        shared += m[: len(a)] @ m[len(a) :].T
    whole = size[: len(a), None] + size[None, len(a) :]
    return np.nonzero((whole > 0) & (shared >= similar * (whole - shared) - 1e-9))


def _links(similar: float):
    """Grouped function: spanning edges of the similar texts of a block, or of two blocks, of a cluster."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["second", "th"])
        sets = [np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles(bytes(w))), np.uint64)) for w in pdf.words]
        first = int((~pdf.second).sum())
        if pdf.alone.iloc[0]:
            x, y = similar_pairs(sets, sets, similar)
        else:
            x, y = similar_pairs(sets[:first], sets[first:], similar)
            y = y + first
        label, th = np.arange(len(sets)), pdf.th.to_numpy()
        join(label, x, y)
        tied = np.flatnonzero(label != np.arange(len(sets)))
        return pd.DataFrame({"a": th[label[tied]], "b": th[tied]})

    return run


def _verified(docs: DataFrame, texts: DataFrame, clusters: DataFrame, similar: float) -> DataFrame:
    """Spanning edges (a, b) of the texts of each cluster (th, comp) whose shingle sets are at least so similar."""
    known = texts.select("th", "rep").join(clusters, "th")
    reps = known.select(F.col("rep").alias("doc_id")).distinct()
    words = _own(docs.join(reps, "doc_id", "left_semi"), False).join(known.select("th", "comp"), "th").groupBy("th", "comp").agg(F.first("words").alias("words"))
    words = cut(words)
    parts = words.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.octet_length("words")) / BLOCK_BYTES)).alias("parts"))
    # a large cluster meets its number of parts in SALTS places
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = words.withColumn("salt", F.pmod("th", F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"]).withColumn("part", F.pmod(F.xxhash64("th"), F.col("parts")))
    # each text goes once to each part of its cluster, to the first or the second side of that pair
    copy = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    pair = copy.select("comp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("second"), (F.col("part") == F.col("other")).alias("alone"), "th", "words")
    return pair.groupBy("comp", "i", "j").applyInPandas(_links(similar), "a long, b long")


def groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) for every row with a doc_id: the smallest doc_id that near duplicates lead to.

    Texts of equal words are duplicates, so those without words are one group;
    texts shorter than a shingle are duplicates of equal ones only."""
    own = cut(_own(docs, True))
    texts = cut(own.groupBy("th").agg(F.min("doc_id").alias("rep"), *[F.first(n).alias(n) for n in _FPS]))
    found = cut(candidates(texts.withColumn("comp", F.col("th")), range(FIRST)))
    known = components(found)
    rest = cut(texts.join(known, F.col("th") == F.col("node"), "left").select("th", *_FPS, F.coalesce("component", "th").alias("comp")))
    found = cut(found.union(candidates(rest, range(FIRST, TABLES))))
    clusters = cut(components(found).select(F.col("node").alias("th"), F.col("component").alias("comp")))
    comp = components(cut(_verified(docs, texts, clusters, similar)))
    whole = texts.join(comp, F.col("th") == F.col("node"), "left").select("th", "rep", F.coalesce("component", "th").alias("comp"))
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return own.select("doc_id", "th").join(whole.select("th", "comp").join(least, "comp"), "th").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs without those whose group holds a smaller doc_id; rows with a null doc_id and, of equal doc_ids, all rows stay."""
    gone = groups(docs, similar).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
