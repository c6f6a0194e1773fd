"""Bits of longs and of byte strings, least significant first; rotations and windows.

The functions on byte strings take bit numbers as columns or numbers, and give
null for null."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

M32 = 0xFFFFFFFF


def shl(c: Column, n) -> Column:
    """c shifted left by n, a column or a number."""
    return F.call_function("shiftleft", c, n.cast("int") if isinstance(n, Column) else F.lit(n))


def shr(c: Column, n) -> Column:
    """c shifted right by n without sign."""
    return F.call_function("shiftrightunsigned", c, n.cast("int") if isinstance(n, Column) else F.lit(n))


def set_bit(c: Column, i: int) -> Column:
    return c.bitwiseOR(F.lit(1 << i))


def clear_bit(c: Column, i: int) -> Column:
    return c.bitwiseAND(F.lit(~(1 << i)))


def flip_bit(c: Column, i) -> Column:
    return c.bitwiseXOR(shl(F.lit(1).cast("long"), i))


def get_bit(c: Column, i) -> Column:
    return shr(c, i).bitwiseAND(F.lit(1))


def parity(c: Column) -> Column:
    return F.bit_count(c) % 2


def rotate_left32(c: Column, n) -> Column:
    m = F.lit(M32)
    return shl(c.bitwiseAND(m), n).bitwiseAND(m).bitwiseOR(shr(c.bitwiseAND(m), 32 - n))


def rotate_right32(c: Column, n) -> Column:
    return rotate_left32(c, 32 - n)


def window32(c: Column, start, width: int) -> Column:
    """`width` bits from bit `start`, wrapping round."""
    return rotate_right32(c, start).bitwiseAND(F.lit((1 << width) - 1))


def _number(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def bytes_of(blob: Column) -> Column:
    """A byte string as an array of numbers."""
    byte = lambda i: F.conv(F.hex(F.substring(blob, i, F.lit(1))), 16, 10).cast("int")
    return F.when(F.octet_length(blob) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.octet_length(blob)), byte))


def blob_of(numbers: Column) -> Column:
    """The byte string of an array of numbers."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def _ring(blob: Column) -> Column:
    """The bytes to wrap round at; one for an empty string, which has no byte to find."""
    return F.greatest(F.octet_length(blob), F.lit(1))


def _bound(values: dict[str, Column], body) -> Column:
    """body of a struct of values, each found once; inside of a lambda an expression is run anew for every element."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), body), F.lit(0))


def _moved(blob: Column, by: Column, wrap: bool) -> Column:
    """The bits of a byte string, each from `by` places above it; past the ends are zeros, or the other end if wrap."""

    def moved(v):
        def at(i):
            return F.get(v.b, F.pmod(i, v["size"])) if wrap else F.when((i >= 0) & (i < v["size"]), F.get(v.b, i)).otherwise(F.lit(0))

        def byte(_, i):
            return shr(at(i + v.whole), v.part).bitwiseOR(shl(at(i + v.whole + 1), 8 - v.part)).bitwiseAND(F.lit(255))

        return blob_of(F.transform(v.b, byte))

    return _bound({"b": bytes_of(blob), "size": F.octet_length(blob), "whole": F.floor(by / 8).cast("int"), "part": F.pmod(by, F.lit(8))}, moved)


def shift_left(blob: Column, n) -> Column:
    return _moved(blob, -_number(n), False)


def shift_right(blob: Column, n) -> Column:
    return _moved(blob, _number(n), False)


def rotate_left(blob: Column, n) -> Column:
    return _moved(blob, -_number(n), True)


def rotate_right(blob: Column, n) -> Column:
    return _moved(blob, _number(n), True)


def window(blob: Column, start, width: int) -> Column:
    """`width` bits, to 32, from bit `start`, wrapping round, as a long; null for an empty string."""

    def found(v):
        five = [shl(F.get(v.b, F.pmod(v["first"] + i, v.ring)).cast("long"), 8 * i) for i in range(5)]
        return shr(sum(five[1:], five[0]), v.part).bitwiseAND(F.lit((1 << width) - 1))

    return _bound({"b": bytes_of(blob), "ring": _ring(blob), "first": F.floor(_number(start) / 8).cast("int"), "part": F.pmod(_number(start), F.lit(8))}, found)


def bit_at(blob: Column, i, wrap: bool = False) -> Column:
    """Bit i of a byte string; past its end 0, or the bit met by wrapping round."""
    i = _number(i)
    byte = F.floor(i / 8).cast("int")
    at = F.pmod(byte, _ring(blob)) if wrap else byte
    there = (at >= 0) & (at < F.octet_length(blob))
    # one byte is read, and only where there is one
    got = F.when(there, F.conv(F.hex(F.substring(blob, at + 1, F.lit(1))), 16, 10).cast("int"))
    return F.when(blob.isNotNull(), F.coalesce(shr(got, F.pmod(i, F.lit(8))).bitwiseAND(F.lit(1)), F.lit(0)))


def _with_bit(blob: Column, i, change) -> Column:
    i = _number(i)

    def changed(v):
        return blob_of(F.transform(v.b, lambda x, at: F.when(at == v.byte, change(x, v.bit)).otherwise(x)))

    return _bound({"b": bytes_of(blob), "byte": F.floor(i / 8), "bit": shl(F.lit(1), F.pmod(i, F.lit(8)))}, changed)


def set_bit_at(blob: Column, i) -> Column:
    """The byte string with bit i set; past its end unchanged, as in the next two."""
    return _with_bit(blob, i, lambda x, bit: x.bitwiseOR(bit))


def clear_bit_at(blob: Column, i) -> Column:
    return _with_bit(blob, i, lambda x, bit: x.bitwiseAND(F.bitwise_not(bit)))


def flip_bit_at(blob: Column, i) -> Column:
    return _with_bit(blob, i, lambda x, bit: x.bitwiseXOR(bit))
