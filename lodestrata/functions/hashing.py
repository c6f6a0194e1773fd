"""Hash functions over byte keys, by name: vectorised ones and Spark's own."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType

from . import longmixers, mixers

U = np.uint64
# Fixed values of the word-mix hash.
SEED = U(0xBC4A78EB0E083FB5)
SHIFT = [U(0xC2D4F379500C363F), U(0xA696A85ADFFCF585), U(0xFCB5791894673FD3), U(0xB828E5548AD84C69)]
SHIFT32 = [U(0xC4AFCA95), U(0xBAF1C985), U(0xEE1ABB0F), U(0xDCBFFDEB)]
OFFSET = [U(0xFF43A9D0C1C914CD), U(0xF049ED58F79E6153)]
MIX = U(0xED27A0E9F72A6D47)
LOW32 = U(0xFFFFFFFF)


def _mix(v):
    v = (v ^ (v >> U(23))) * MIX
    return v ^ (v >> U(47))


def _rotated(v, n: int):
    return (v >> U(n)) | (v << U(64 - n))


def wordmix(keys: list[bytes], half: bool = False) -> np.ndarray:
    """The 64-bit word-mix hash of each key; half: its 32-bit relative.  Keys of one length are hashed together."""
    out = np.zeros(len(keys), U)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        n = int(size)
        width = (n // 8 + 1) * 8
        data = np.frombuffer(b"".join(keys[i].ljust(width, b"\0") for i in at), "<u8").reshape(len(at), -1)
        h = np.full(len(at), SEED ^ U(n * int(SHIFT[0]) % 2**64), U)
        word = 0
        if n >= 32:
            lanes = [h + OFFSET[0] + OFFSET[1], h + OFFSET[0], h.copy(), h - OFFSET[1]]
            while word + 4 <= n // 32 * 4:
                for i in range(4):
                    v = data[:, word + i]
                    v = v ^ (v >> U(23))
                    lane = lanes[i] ^ v ^ (v >> U(47))
                    lanes[i] = lane * SHIFT[i] if not half else ((lane >> U(32)) * SHIFT32[i] & LOW32) << U(32) | (lane & LOW32) * SHIFT32[i] & LOW32
                word += 4
            h = _rotated(lanes[0], 1) ^ _rotated(lanes[1], 3) ^ _rotated(lanes[2], 6) ^ _rotated(lanes[3], 11)
        for i in range(word, n // 8):
            h = (h ^ _mix(data[:, i])) * SHIFT[0]
        h = (h ^ _mix(data[:, n // 8])) * SHIFT[3]
        out[at] = (h ^ (h >> U(32))) & LOW32 if half else _mix(h)
    return out


def bytewise(step, start: int = 0):
    """A 32-bit hash that folds one byte at a time, for keys of one length together."""

    def run(keys: list[bytes], seed: int = 0) -> np.ndarray:
        out = np.zeros(len(keys), U)
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), int(size)).astype(U)
            h = np.full(len(at), U(seed ^ start), U)
            for j in range(int(size)):
                h = step(h, data[:, j])
            out[at] = h
        return out

    return run


def _oaat(h, b):
    h = ((h ^ b) * U(0x5BD1E995)) & LOW32
    return h ^ (h >> U(15))


fnv = bytewise(lambda h, b: ((h ^ b) * U(16777619)) & LOW32, 2166136261)
bernstein = bytewise(lambda h, b: (h * U(33) + b) & LOW32)
oaat = bytewise(_oaat)
VECTOR = {"wordmix64": wordmix, "wordmix32": lambda keys: wordmix(keys, True), "fnv": fnv, "bernstein": bernstein, "oaat": oaat, **mixers.ALL, **longmixers.ALL}
WIDE = mixers.WIDE | longmixers.WIDE


def vectorised(name: str, seed: int | None = None):
    """The named hash as a function of a binary column; a seed goes to those that take one."""
    plain = VECTOR[name]
    fn = plain if seed is None else lambda keys: plain(keys, seed)

    @F.pandas_udf(LongType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fn([bytes(x) if x is not None else b"" for x in s]).astype(U).view(np.int64)).where(s.notna().to_numpy()).astype("Int64")

    return lambda c: run(c.cast("binary"))


def wide(name: str):
    """The named hash of several words as a function from a binary column to an array of longs."""
    fn = WIDE[name]

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        words = fn([bytes(x) if x is not None else b"" for x in s]).astype(U).view(np.int64)
        return pd.Series([w if there else None for w, there in zip(words, s.notna())], dtype=object)

    return lambda c: run(c.cast("binary"))


def le32(hexdigest: Column) -> Column:
    """The first four bytes of a hex digest as a little-endian unsigned integer."""
    return F.conv(F.concat(*[F.substring(hexdigest, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


#: name to a function from a column to a long column; the last ones run in the JVM.
REGISTRY = {n: (lambda c, n=n: vectorised(n)(c)) for n in VECTOR} | {
    "crc32": lambda c: F.crc32(c), "md5_32": lambda c: le32(F.md5(c)), "sha1_32": lambda c: le32(F.sha1(c)), "xxh64": lambda c: F.xxhash64(c), "constant": lambda c: F.lit(0).cast("long"),
}


def verification(fn, width: int = 4) -> int:
    """Code of a seeded hash: keys {}, {0}, {0, 1}, ... with seeds 256, 255, ..., then the list of results."""
    digest = lambda key, seed: fn([key], seed)[0].tobytes()[:width]
    whole = b"".join(digest(bytes(range(i)), 256 - i) for i in range(256))
    return int.from_bytes(digest(whole, 0)[:4], "little")


def wrapping_multiply(a: Column, b) -> Column:
    """a * b modulo 2^64 on bit patterns, in the JVM and without overflow errors, by 32- and 16-bit parts; b is a column or a number."""
    m32, m16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    # 16 bits of b from bit n
    part = (lambda n: F.shiftrightunsigned(b, n).bitwiseAND(m16)) if isinstance(b, Column) else (lambda n: F.lit(b >> n & 0xFFFF))
    ah, al = F.shiftrightunsigned(a, 32), a.bitwiseAND(m32)
    low = lambda p, n: (p * part(n) + F.shiftleft((p * part(n + 16)).bitwiseAND(m16), 16))
    s = low(al, 0)
    carry = F.shiftrightunsigned(s, 32) + F.shiftrightunsigned(al * part(16), 16)
    hi = (carry + low(ah, 0).bitwiseAND(m32) + low(al, 32).bitwiseAND(m32)).bitwiseAND(m32)
    return F.shiftleft(hi, 32).bitwiseOR(s.bitwiseAND(m32))


def multiply32(a: Column, b: int) -> Column:
    """a * b modulo 2^32 of numbers below 2^32, in the JVM and without overflow errors."""
    upper = F.shiftleft((a * F.lit(b >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * F.lit(b & 0xFFFF) + upper).bitwiseAND(F.lit(int(LOW32)))


def finalised32(c: Column) -> Column:
    """The closing mix of Murmur 3 on the low 32 bits of a long column, in the JVM."""
    h = c.bitwiseAND(F.lit(int(LOW32)))
    for down, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = multiply32(h.bitwiseXOR(F.shiftrightunsigned(h, down)), by)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))
