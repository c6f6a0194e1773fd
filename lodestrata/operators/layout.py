"""Layout of sorted runs: varint sizes, front coding, sparse index, offsets, flush."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bits import shl, shr
from ..plans.util import carried, ordered, scratch

#: Rows from one restart to the next.
STRIDE = 51


def varint_len(x: Column) -> Column:
    """Bytes of a non-negative long as a variable-length integer."""
    c = F.when(x < 1 << 7, 1)
    for n in range(7):
        c = c.when(x < 1 << (12 + 8 * n), n + 2)
    return c.otherwise(9)


def varint_hex(x: Column) -> Column:
    """The encoding, as lower-case hex: a length nibble and low bits, then little-endian bytes."""
    low = lambda c, bits: c.bitwiseAND(F.lit((1 << bits) - 1))
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    n = varint_len(x) - 2
    rest = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i < n, two(low(shr(x, 12 + 8 * i), 8))).otherwise(""))
    head = F.concat(two(low(x, 7).bitwiseOR(F.lit(128))), two(F.shiftleft(n.cast("long"), 5).bitwiseOR(low(F.shiftrightunsigned(x, 7), 5))))
    return F.lower(F.when(x < 128, two(x)).otherwise(F.concat(head, F.array_join(rest, ""))))


def varint_value(encoded: Column) -> Column:
    """The long of an encoding of up to seven bytes after the head, in hex."""
    byte = lambda i: F.conv(F.substring(encoded, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("long")
    first, second = byte(0), byte(1)
    n = F.shiftright(second, 5).cast("int")
    rest = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, i: a + F.when(i < n, shl(F.conv(F.substring(encoded, (2 * i + 5).cast("int"), F.lit(2)), 16, 10).cast("long"), 12 + 8 * i)).otherwise(F.lit(0)))
    return F.when(first < 128, first).otherwise(first.bitwiseAND(F.lit(127)) + F.shiftleft(second.bitwiseAND(F.lit(31)), 7) + rest)


def varint_checked(encoded: Column) -> Column:
    """The long of an encoding that may be cut off; null where it is short."""
    size, head = F.length(encoded) / 2, lambda i: F.conv(F.substring(encoded, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("long")
    return F.when((size >= 1) & (head(0) < 128), head(0)).when((size >= 2) & (size >= 2 + F.shiftright(head(1), 5)), varint_value(encoded))


def u64_hex(x: Column) -> Column:
    """The eight little-endian bytes of a long's bit pattern, as lower-case hex."""
    return F.lower(F.concat(*[F.lpad(F.hex(shr(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def u64_value(encoded: Column) -> Column:
    """The long of eight little-endian bytes in hex; null unless there are eight."""
    byte = lambda i: F.conv(F.substring(encoded, 2 * i + 1, 2), 16, 10).cast("long")
    out = byte(0)
    for i in range(1, 8):
        out = out.bitwiseOR(shl(byte(i), 8 * i))
    return F.when(F.length(encoded) == 16, out)


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes of the longest common prefix, by halving; 0 for null."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    x, y = a.cast("binary"), b.cast("binary")
    steps = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def longer(got, i):
        to = got + shl(F.lit(1), i)
        return F.when((to <= n) & (F.substring(x, F.lit(1), to) == F.substring(y, F.lit(1), to)), to).otherwise(got)

    return F.when(n > 0, F.aggregate(steps, F.lit(0), longer)).otherwise(0)


def restarts(run: DataFrame, key: str = "k", stride: int = STRIDE) -> DataFrame:
    """ordered(run) with `restart`: every stride-th row and the last."""
    d = ordered(run, key)
    last = d.agg(F.max("pos")).first()[0]
    return d.withColumn("restart", (F.col("pos") % stride == 0) | (F.col("pos") == F.lit(last)))


def front_coding(run: DataFrame, key: str = "k", stride: int = STRIDE) -> DataFrame:
    """restarts(run) with common_len: bytes shared with the key before, 0 at restarts."""
    d = carried(restarts(run, key, stride), F.col(key), "_prev")
    return d.withColumn("common_len", F.when(F.col("restart"), 0).otherwise(common_prefix(F.col(key), F.col("_prev")))).drop("_prev")


def layout(run: DataFrame, key: str = "k", value: str = "v", stride: int = STRIDE) -> DataFrame:
    """front_coding(run) with each record's size in bytes and offset in the run; a null value is a tombstone."""
    d = front_coding(run, key, stride)
    k, v = F.octet_length(key), F.coalesce(F.octet_length(value), F.lit(0))
    size = varint_len(k) + varint_len(F.col("common_len")) + varint_len(v) + 1 + k - F.col("common_len") + v
    d = carried(d.withColumn("size", size.cast("long")), F.col("size"), "offset", F.sum)
    return d.withColumn("offset", F.col("offset").cast("long"))


def index_lookup(probes: DataFrame, run: DataFrame, key: str = "k", stride: int = STRIDE) -> DataFrame:
    """Each probe with the greatest index key not above it (null below the first)."""
    index = restarts(run, key, stride).where("restart").select(F.col(key), F.col(key).alias("index_key"), F.lit(0).alias("kind"))
    both = index.unionByName(probes.select(key, F.lit(None).cast("string").alias("index_key"), F.lit(1).alias("kind")))
    d = carried(ordered(both, key, "kind"), F.col("index_key"), "found")
    return d.where("kind = 1").select(key, F.col("found").alias("index_key"))


def flush(rows: DataFrame, path: str, key: str = "k") -> DataFrame:
    """Writes the rows that aren't cached as a run sorted by key, with a bloom filter on it; returns the run read back.

    Compaction passes rows whose cached flag is provenance only: drop it first."""
    rows = rows.where(~F.col("cached")).drop("cached") if "cached" in rows.columns else rows
    rows.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.bloom.filter.enabled#" + key, "true").parquet(path)
    return rows.sparkSession.read.parquet(path)


def compact(runs: list[DataFrame], path: str, bottom: bool = False) -> DataFrame:
    """Merges runs, newest first, into one; the bottom level drops tombstones."""
    from .merge import priority_merge

    out = priority_merge([r.drop("cached") for r in runs]).drop("prio")
    return flush(out.where(~F.col("is_deleted")) if bottom else out, path)
