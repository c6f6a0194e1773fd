"""Quality of hash columns: collisions, distribution, avalanche, independence."""
from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.util import spread
from .bits import flip_bit, get_bit, shl

# The counters below carry their own code to executors, which need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashes that are shipped in one row, and those counted in one step.
SHIPPED, COUNTED = 1 << 16, 1 << 20


def collisions(rows: DataFrame, h: str = "h", bits: int = 32) -> DataFrame:
    """Keys, collisions (keys less distinct hashes), the number expected and whether it holds.

    Up to 32 bits twice the expected number is allowed; beyond, none."""
    n = rows.groupBy(h).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("collisions"))
    expected = F.col("n") * (F.col("n") - 1).cast("double") / F.lit(float(2 ** (bits + 1)))
    ok = F.col("collisions") <= 2 * expected if bits <= 32 else F.col("collisions") == 0
    return n.select("n", "collisions", F.round(expected, 6).alias("expected"), ok.alias("ok"))


def collision_map(rows: DataFrame, key: str, h: str = "h") -> DataFrame:
    """(h, n, keys) of the hashes that several distinct keys have; only those keys are gathered."""
    pairs = rows.select(key, h).distinct()
    several = pairs.groupBy(h).agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(several, h).groupBy(h, "n").agg(F.sort_array(F.collect_list(key)).alias("keys"))


def first_collisions(rows: DataFrame, n: int, h: str = "h") -> DataFrame:
    return rows.groupBy(h).agg(F.count("*").alias("n")).where("n > 1").orderBy(h).limit(n)


def occupancy_collisions(balls: Column, bins: Column) -> Column:
    return balls - bins + bins * F.pow(1 - 1 / bins, balls)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, exact while it fits a long."""
    return F.when(k > n, F.lit(0).cast("long")).when(k == 0, F.lit(1).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1).cast("long"), lambda a, i: (a * (n - k + i) / i).cast("long")))


def choose_up_to(n: Column, k: Column) -> Column:
    """Number of non-empty subsets of up to k of n."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0).cast("long"), lambda a, i: a + F.when(i <= k, choose(n, i)).otherwise(F.lit(0)))


def _score(k: Column, q: Column, bins) -> Column:
    """0 is even; null where no two keys share a bin.  k keys, q the sum of the bins' squared counts."""
    return 1 - ((k * k - 1) / F.nullif(q - k, F.lit(0.0))) / bins


def _turned(words: np.ndarray, start: int, width: int) -> np.ndarray:
    """window32 of 32-bit words."""
    x = (words >> np.uint32(start) | words << np.uint32(32 - start)) if start else words
    return x & np.uint32((1 << width) - 1)


def _cover(starts, more: int) -> dict[int, list[int]]:
    """The starts dealt to windows that are `more` bits wider: {start of such a window: the starts in it}."""
    out: dict[int, list[int]] = {}
    for s in sorted(set(starts)):
        first = next(reversed(out), None)
        if first is None or s > first + more:
            out[s] = [s]
        else:
            out[first].append(s)
    return out


def _inner(bins: np.ndarray, start: int, width: int) -> np.ndarray:
    """The bins of the window of `width` bits from bit `start` of a wider window's."""
    return bins.reshape(-1, 1 << width, 1 << start).sum((0, 2))


def _lanes(rows: DataFrame, h: str, lanes: int, count, schema: str) -> DataFrame:
    """Rows of count(lane, blocks), where blocks yields all hashes of rows: (32-bit words, number of nulls).

    The hashes are packed and every lane, one task, gets all of them: each
    costs four bytes a lane, and no task holds more than a block beside what
    count keeps."""

    def pack(batches):
        held, size, nulls = [], 0, 0

        def row():
            return pa.RecordBatch.from_pydict({"data": pa.array([np.concatenate(held).tobytes() if held else b""], pa.binary()), "nulls": pa.array([nulls], pa.int64())})

        for b in batches:
            c = b.column(0)
            nulls += c.null_count
            held.append((c.drop_null().to_numpy(zero_copy_only=False) & 0xFFFFFFFF).astype(np.uint32))
            size += len(held[-1])
            if size >= SHIPPED:
                yield row()
                held, size, nulls = [], 0, 0
        if size or nulls:
            yield row()

    def blocks(batches):
        held, size, nulls = [], 0, 0
        for b in batches:
            nulls += sum(b.column(1).to_pylist())
            for x in b.column(0):
                held.append(np.frombuffer(x.as_buffer(), np.uint32))
                size += len(held[-1])
                if size >= COUNTED:
                    yield np.concatenate(held), nulls
                    held, size, nulls = [], 0, 0
        if held or nulls:
            yield np.concatenate([np.empty(0, np.uint32), *held]), nulls

    def one(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        lane = first.column(2)[0].as_py()

        def all_batches():
            yield first
            yield from batches

        yield from count(lane, blocks(all_batches()))

    packed = rows.select(F.col(h).cast("long").alias("h")).mapInArrow(pack, "data binary, nulls long")
    each = packed.select("data", "nulls", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return each.repartitionById(lanes, F.col("lane")).mapInArrow(one, schema)


def _windows(rows: DataFrame, width: int, starts, h: str, emit, schema: str) -> DataFrame:
    """Rows of emit(start, bins, nulls) for the windows at all starts.

    A lane counts in an array windows that are three bits wider, and hold those of four starts."""
    wide = min(32, width + 3)
    cover = _cover(starts, wide - width)
    firsts = list(cover)

    def count(lane, blocks):
        first = firsts[lane]
        bins, nulls = np.zeros(1 << wide, np.int64), 0
        for words, none in blocks:
            nulls += none
            bins += np.bincount(_turned(words, first, wide), minlength=1 << wide)
        for s in cover[first]:
            yield from emit(s, _inner(bins, s - first, width), nulls)

    return _lanes(rows, h, len(firsts), count, schema)


def window_counts(rows: DataFrame, width: int, starts=range(32), h: str = "h") -> DataFrame:
    """(start, bin, b): keys of each window; empty bins have no row, missing hashes one of their own."""

    def emit(start, bins, nulls):
        full = np.flatnonzero(bins)
        for i in range(0, len(full), COUNTED):
            part = full[i:i + COUNTED]
            yield pa.RecordBatch.from_pydict({"start": pa.array(np.full(len(part), start, np.int32)), "bin": part.astype(np.int64), "b": bins[part].astype(float)})
        if nulls:
            yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int32()), "bin": pa.array([None], pa.int64()), "b": pa.array([float(nulls)])})

    return _windows(rows, width, starts, h, emit, "start int, bin long, b double")


def folded(counts: DataFrame, width: int, least: int = 8) -> DataFrame:
    """window_counts for each width from `width` down to `least`: the upper half of the bins is added to the lower."""
    w = F.explode(F.array(*[F.lit(i) for i in range(least, width + 1)]))
    each = counts.select("start", "bin", "b", w.alias("width")).withColumn("bin", F.col("bin").bitwiseAND(shl(F.lit(1).cast("long"), F.col("width")) - 1))
    return each.groupBy("start", "width", "bin").agg(F.sum("b").alias("b"))


def window_scores(rows: DataFrame, width: int, starts=range(32), h: str = "h", least: int | None = None) -> DataFrame:
    """(start, width, score) of windows of one width, or of all from it down to `least`: 0 is even.

    A task folds the counts of its starts, the upper half of the bins added to the lower, and sends one row a window."""
    to = width if least is None else least

    def emit(start, bins, nulls):
        for w in range(width, to - 1, -1):
            k, q = int(bins.sum()) + nulls, int((bins * bins).sum()) + nulls * nulls
            yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int32()), "width": pa.array([w], pa.int32()), "k": pa.array([float(k)]), "q": pa.array([float(q)])})
            bins = bins.reshape(2, -1).sum(0)

    t = _windows(rows, width, starts, h, emit, "start int, width int, k double, q double")
    return t.select("start", "width", _score(F.col("k"), F.col("q"), F.pow(F.lit(2.0), "width")).alias("score"))


def widest(n: int, most: int = 20, keys: int = 5) -> int:
    """The largest window width, to `most`, that leaves so many keys a bin."""
    return next((w for w in range(most, 0, -1) if n >= keys << w), 0)


def worst_over_widths(rows: DataFrame, h: str = "h", least: int = 8) -> DataFrame:
    """(start, width, score, biased): the worst window over all starts and widths with five keys a bin; biased from one per cent on.

    Keys are counted once, at the widest windows, and the counts folded; no row with too few keys."""
    w = widest(rows.count())
    return worst_window(window_scores(rows, max(w, least), h=h, least=least).where(F.lit(w >= least))).where("start is not null").withColumn("biased", F.col("score") >= 0.01)


def fast_scores(rows: DataFrame, h: str = "h") -> DataFrame:
    """(worst, mean) of the 16-bit windows at byte starts."""
    return window_scores(rows, 16, range(0, 32, 8), h).agg(F.max("score").alias("worst"), F.avg("score").alias("mean"))


def byte_pairs(rows: DataFrame, starts=range(32), h: str = "h") -> DataFrame:
    """(a, b, score) of the 65,536 bins of two 8-bit windows, a <= b; the order of a pair makes no difference.

    A task counts some 33 pairs in arrays of all bins; no row is made for a key and pair."""
    pairs = [(a, b) for a in starts for b in starts if a <= b]
    per = 33
    n = -(-len(pairs) // per)

    def count(lane, blocks):
        mine = pairs[lane * per:(lane + 1) * per]
        bins, nulls = np.zeros((len(mine), 1 << 16), np.int64), 0
        for words, none in blocks:
            nulls += none
            windows = {s: _turned(words, s, 8).astype(np.uint16) for s in {s for pair in mine for s in pair}}
            for i, (a, b) in enumerate(mine):
                bins[i] += np.bincount(windows[a] | windows[b] << 8, minlength=1 << 16)
        k, q = bins.sum(1) + nulls, (bins * bins).sum(1) + nulls * nulls
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in mine], pa.int32()), "b": pa.array([b for _, b in mine], pa.int32()), "k": k.astype(float), "q": q.astype(float)})

    t = _lanes(rows, h, n, count, "a int, b int, k double, q double")
    return t.select("a", "b", _score(F.col("k"), F.col("q"), 65536.0).alias("score"))


def differential_scores(rows: DataFrame, key: str, hashed, in_bits: int, width: int = 8) -> DataFrame:
    """(in_bit, n, collisions, worst): of the differences of hashes when an input bit is flipped, their collisions and worst window.

    Equal differences are brought together once; each task then counts its own in arrays of wider windows, which
    hold those of several starts, and sends one row an input bit."""
    k = spread(rows.select(F.col(key).alias("k")))
    d = k.select(hashed(F.col("k")).alias("h0"), F.explode(F.sequence(F.lit(0), F.lit(in_bits - 1))).alias("in_bit"), "k")
    d = d.select("in_bit", F.col("h0").bitwiseXOR(hashed(flip_bit(F.col("k"), F.col("in_bit")))).alias("h"))
    same = d.groupBy("in_bit", "h").agg(F.count("*").alias("c"))
    wide = min(32, max(width, 16))
    cover = _cover(range(32), wide - width)

    def count(batches):
        bins, totals = {}, {}
        for b in gathered(batches):
            bit, none = b.column(0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)
            words, c = (b.column(1).fill_null(0).to_numpy() & 0xFFFFFFFF).astype(np.uint32), b.column(2).to_numpy()
            for i in np.unique(bit):
                mine = bit == i
                t = totals.setdefault(i, np.zeros(3, np.int64))
                t += (c[mine].sum(), (mine & ~none).sum(), c[mine & none].sum())
                w, n = words[mine & ~none], c[mine & ~none]
                several = np.flatnonzero(n > 1)
                for s in cover:
                    x = _turned(w, s, wide)
                    to = bins.setdefault((i, s), np.zeros(1 << wide, np.int64))
                    to += np.bincount(x, minlength=1 << wide)
                    np.add.at(to, x[several], n[several] - 1)
        for i, t in totals.items():
            narrow = np.concatenate([_inner(bins[i, s], o, width) for s in cover for o in range(len(cover[s]))])
            yield pa.RecordBatch.from_pydict({"in_bit": pa.array([i], pa.int32()), "totals": pa.array([t.tobytes()], pa.binary()), "bins": pa.array([narrow.tobytes()], pa.binary())})

    def gathered(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= COUNTED:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def merge(batches):
        sums = {}
        for b in batches:
            for i, *parts in zip(*(c.to_pylist() for c in b.columns)):
                sums[i] = [to + np.frombuffer(x, np.int64) for to, x in zip(sums.get(i, (0, 0)), parts)]
        for i, (t, bins) in sums.items():
            n, different, nulls = map(int, t)
            bins = bins.reshape(32, -1)
            q = (bins * bins).sum(1) + nulls * nulls
            yield pa.RecordBatch.from_pydict({"in_bit": pa.array([i] * 32, pa.int32()), "n": pa.array([n] * 32, pa.int64()), "collisions": pa.array([n - different] * 32, pa.int64()), "q": q.astype(float)})

    per = same.mapInArrow(count, "in_bit int, totals binary, bins binary").repartition(min(in_bits, 16), "in_bit")
    t = per.mapInArrow(merge, "in_bit int, n long, collisions long, q double")
    score = _score(F.col("n").cast("double"), F.col("q"), float(1 << width))
    return t.groupBy("in_bit", "n", "collisions").agg(F.max(score).alias("worst"))


def key_list(rows: DataFrame, hashed, key: str, bits: int = 32) -> DataFrame:
    """(n, collisions, expected, ok, start, width, score, biased): all keys hashed, then the collision and the distribution test."""
    h = rows.select(hashed(F.col(key)).alias("h"))
    # nearly all hashes differ, so that a task's size sets the memory it counts them in
    dealt = spread(rows.select(key), 1 << 20).select(hashed(F.col(key)).alias("h"))
    return collisions(dealt, bits=bits).crossJoin(worst_over_widths(h))


def worst_window(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by(F.struct("start", "width", "score"), F.struct(F.col("score"), -F.col("start"), -F.col("width"))).alias("s")).select("s.*")


def flips(rows: DataFrame, key: str, hashed, in_bits: int, out_bits: int) -> DataFrame:
    """Per input bit the number of keys whose output bit differs when it is flipped: (in_bit, out_bit, flips, n).

    hashed maps a column to a hash column.  One row a task and input bit is shuffled."""
    d = rows.select(hashed(F.col(key)).alias("h0"), F.explode(F.sequence(F.lit(0), F.lit(in_bits - 1))).alias("in_bit"), F.col(key).alias("k"))
    d = d.withColumn("x", F.col("h0").bitwiseXOR(hashed(flip_bit(F.col("k"), F.col("in_bit")))))
    t = d.groupBy("in_bit").agg(F.count("*").alias("n"), *[F.sum(get_bit(F.col("x"), j)).alias(f"c{j}") for j in range(out_bits)])
    return t.select("in_bit", "n", F.posexplode(F.array(*[f"c{j}" for j in range(out_bits)])).alias("out_bit", "flips"))


def avalanche(rows: DataFrame, key: str, hashed, in_bits: int, out_bits: int) -> DataFrame:
    f = flips(rows, key, hashed, in_bits, out_bits)
    return f.select("in_bit", "out_bit", "flips", F.round(F.abs(2 * F.col("flips") / F.col("n") - 1), 6).alias("bias"))


def independence(rows: DataFrame, key: str, hashed, in_bits: int, out_bits: int) -> DataFrame:
    """(in_bit, out1, out2, n00, n01, n10, n11) of every pair of output bits, out1 < out2."""
    d = rows.select(F.col(key).alias("k"), hashed(F.col(key)).alias("h0"), F.explode(F.sequence(F.lit(0), F.lit(in_bits - 1))).alias("in_bit"))
    d = d.withColumn("x", F.col("h0").bitwiseXOR(hashed(flip_bit(F.col("k"), F.col("in_bit")))))
    pairs = [(a, b) for a in range(out_bits) for b in range(a + 1, out_bits)]
    bit = lambda j: get_bit(F.col("x"), j)
    t = d.groupBy("in_bit").agg(F.count("*").alias("n"), *[F.sum(bit(j)).alias(f"c{j}") for j in range(out_bits)], *[F.sum(bit(a) * bit(b)).alias(f"p{a}_{b}") for a, b in pairs])
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("out1"), F.lit(b).alias("out2"), F.col(f"c{a}").alias("x"), F.col(f"c{b}").alias("y"), F.col(f"p{a}_{b}").alias("n11")) for a, b in pairs]))
    t = t.select("in_bit", "n", cell.alias("s")).select("in_bit", "n", "s.*")
    return t.select("in_bit", "out1", "out2", (F.col("n") - F.col("x") - F.col("y") + F.col("n11")).alias("n00"), (F.col("y") - F.col("n11")).alias("n01"), (F.col("x") - F.col("n11")).alias("n10"), "n11")


def differential(rows: DataFrame, key: str, hashed, deltas: list[int]) -> DataFrame:
    """(delta, n): keys whose hash doesn't change under an input difference, where more than one does not."""
    d = rows.select(F.col(key).alias("k"), hashed(F.col(key)).alias("h0"), F.explode(F.array(*[F.lit(x).cast("long") for x in deltas])).alias("delta"))
    same = d.where(F.col("h0") == hashed(F.col("k").bitwiseXOR(F.col("delta"))))
    return same.groupBy("delta").agg(F.count("*").alias("n")).where("n > 1")


def checksum(rows: DataFrame, h: str = "h") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.bit_or(h).alias("any"))
