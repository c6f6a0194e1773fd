"""Generated key sets, as tables computed from ranges."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bits import shl, shr


def _digits(n, base: int, size: int, letter):
    """`size` digits of n, the least first, each mapped by letter."""
    return [letter(F.expr(f"(id div {base ** i}) % {base}")) for i in range(size)]


def combination(spark: SparkSession, blocks: list[int], longest: int) -> DataFrame:
    """Every sequence of 1 to longest blocks, as hex of 32-bit words: B + B^2 + ... rows."""
    b = F.array(*[F.lit(f"{x:08X}") for x in blocks])
    one = lambda d: F.element_at(b, (d + 1).cast("int"))
    parts = [spark.range(len(blocks) ** size).select(F.lit(size).alias("n_blocks"), F.concat(*_digits("id", len(blocks), size, one)).alias("key")) for size in range(1, longest + 1)]
    return reduce(lambda a, c: a.union(c), parts)


def permutation(spark: SparkSession, n: int) -> DataFrame:
    """The n! orders of n blocks, by the digits of the row number in the factorial base."""
    from math import factorial

    d = spark.range(factorial(n)).select("id", F.array(*[F.lit(i) for i in range(n)]).alias("left"), F.array().cast("array<int>").alias("key"))
    for i in range(n):
        at = F.expr(f"cast((id div {factorial(n - 1 - i)}) % {n - i} as int)")
        d = d.select("id", F.concat(F.slice("left", F.lit(1), at), F.slice("left", at + 2, F.lit(n))).alias("left"), F.concat("key", F.array(F.element_at("left", at + 1))).alias("key"))
    return d.select(F.array_join("key", "").alias("key"))


def sparse(spark: SparkSession, bits: int, most: int) -> DataFrame:
    """Numbers of up to most set bits among bits: each bit set is extended upwards only."""
    level = spark.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(-1).alias("top"))
    out = level
    for _ in range(most):
        level = level.where(F.col("top") < bits - 1).select("key", F.explode(F.sequence(F.col("top") + 1, F.lit(bits - 1))).alias("i")).select((F.col("key") + shl(F.lit(1).cast("long"), F.col("i"))).alias("key"), F.col("i").alias("top"))
        out = out.union(level)
    return out.select("key")


def window(spark: SparkSession, bits: int, width: int) -> DataFrame:
    """width-bit numbers shifted round to each of `bits` places: bits * 2^width rows."""
    full = (1 << bits) - 1
    d = spark.range(1 << width).select("id", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("start"))
    up = shl(F.col("id"), F.col("start"))
    return d.select("start", up.bitwiseAND(F.lit(full)).bitwiseOR(shr(F.col("id"), bits - F.col("start"))).alias("key"))


def cyclic(spark: SparkSession, n: int, size: int = 4, times: int = 8) -> DataFrame:
    """Keys that repeat a cycle of bytes drawn from md5 of the row number."""
    return spark.range(n).select("id", F.repeat(F.substring(F.md5(F.col("id").cast("string")), 1, 2 * size), times).alias("key"))


def two_bytes(spark: SparkSession, longest: int) -> DataFrame:
    """Keys of 2 to longest bytes of which one or two aren't zero: (size, i, a, j, b), j and b 0 if one."""
    s = spark.range(2, longest + 1).select(F.col("id").cast("int").alias("size"))
    one = s.select("size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).select("size", "i", F.explode(F.sequence(F.lit(1), F.lit(255))).alias("a"))
    two = one.where(F.col("i") < F.col("size") - 1).select("size", "i", "a", F.explode(F.sequence(F.col("i") + 1, F.col("size") - 1)).alias("j")).select("size", "i", "a", "j", F.explode(F.sequence(F.lit(1), F.lit(255))).alias("b"))
    return one.select("size", "i", "a", F.lit(0).alias("j"), F.lit(0).alias("b")).union(two)


def text(spark: SparkSession, charset: str, size: int, prefix: str = "", suffix: str = "") -> DataFrame:
    """prefix, size characters (the least significant first), suffix."""
    letter = lambda d: F.substring(F.lit(charset), (d + 1).cast("int"), F.lit(1))
    return spark.range(len(charset) ** size).select(F.concat(F.lit(prefix), *_digits("id", len(charset), size, letter), F.lit(suffix)).alias("key"))


def zeroes(spark: SparkSession, n: int) -> DataFrame:
    """Keys of 0 to n - 1 zero bytes."""
    return spark.range(n).select(F.col("id").alias("size"), F.unhex(F.repeat(F.lit("00"), F.col("id").cast("int"))).alias("key"))


def seeds(spark: SparkSession, n: int, key: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seed"), F.lit(key).alias("key"))


def strided(rows: DataFrame, column: str, prime: int, n: int) -> DataFrame:
    """The column's access pattern: id * prime mod n."""
    return rows.withColumn("target", F.pmod(F.col(column) * prime, F.lit(n)))


def recurrence(spark: SparkSession, n: int, modulus: int) -> DataFrame:
    """(id, value) of the first n values of c -> (3 c + 1) mod modulus from c = 0, in closed form: (3^i - 1) / 2.

    The power is taken modulo twice the modulus, by squaring; modulus is below 2^30."""
    m = F.lit(2 * modulus).cast("long")
    squares = [pow(3, 1 << i, 2 * modulus) for i in range(max(1, n.bit_length()))]
    picked = F.filter(F.array(*[F.lit(x).cast("long") for x in squares]), lambda _, i: shr(F.col("id"), i).bitwiseAND(F.lit(1)) == 1)
    power = F.aggregate(picked, F.lit(1).cast("long"), lambda a, x: F.pmod(a * x, m))
    return spark.range(1, n + 1).select("id", F.pmod(F.shiftright(power - 1, 1), F.lit(modulus)).alias("value"))


# Fixed values of the xorshift generator: what the seed's halves are mixed with, and its idle steps.
XORSHIFT, XORSHIFT_WIDE, IDLE = 0x498B3BC5, 0x5A05089A, 10


def random_words(seed: Column, n: int, wide: bool = False) -> Column:
    """The first n 32-bit numbers of the xorshift generator of each seed, an array; wide: of 64-bit seeds.

    The numbers of one seed follow from each other: take many seeds, each a
    row, for many numbers."""
    m = F.lit(0xFFFFFFFF)
    start = F.array(seed.bitwiseAND(m).bitwiseXOR(F.lit(XORSHIFT)), F.shiftrightunsigned(seed, 32).bitwiseXOR(F.lit(XORSHIFT_WIDE)) if wide else F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def longer(words, i):
        first, last = F.get(words, i), F.get(words, i + 3)
        t = first.bitwiseXOR(F.shiftleft(first, 11).bitwiseAND(m))
        return F.array_append(words, last.bitwiseXOR(F.shiftrightunsigned(last, 19)).bitwiseXOR(t).bitwiseXOR(F.shiftrightunsigned(t, 8)))

    return F.slice(F.aggregate(F.sequence(F.lit(0), F.lit(IDLE + n)), start, longer), IDLE + 2, n)


def random_longs(seed: Column, n: int, wide: bool = False) -> Column:
    """The first n 64-bit numbers, as bit patterns; each shares a half with the next."""
    words = random_words(seed, n + 1, wide)
    return F.transform(F.slice(words, 1, n), lambda x, i: F.shiftleft(x, 32).bitwiseOR(F.get(words, i + 1)))
