"""Word hashes whose steps depend on a key's length, over keys of one length at once: City, Spooky and the seeded CRC-32."""
from __future__ import annotations

import zlib

import numpy as np

from .mixers import B, _full, _rot, of_length

# Fixed values of City: four primes and the factor of its pair hash.
K0, K1, K2, K3 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557
PAIR = B(0x9DDFEA08EB382D69)
# Fixed values of Spooky: its constant and the rotations of its four rounds.
ODD = 0xDEADBEEFDEADBEEF
MIX_TURNS = (11, 32, 43, 31, 17, 28, 39, 57, 55, 54, 22, 46)
END_TURNS = (44, 15, 34, 21, 38, 33, 10, 13, 38, 53, 42, 54)
SHORT_MIX_TURNS = (50, 52, 30, 41, 54, 48, 38, 37, 62, 34, 5, 36)
SHORT_END_TURNS = (15, 52, 26, 51, 28, 9, 47, 54, 32, 25, 63)
LONG = 192  # bytes from which Spooky keeps twelve words of state


def _right(x, n: int):
    return _rot(x, 64 - n)


def _down(x):
    return x ^ (x >> B(47))


def _pair(u, v):
    a = _down((u ^ v) * PAIR)
    return _down((v ^ a) * PAIR) * PAIR


def _reader(k, kind: str = "<u8"):
    """The words of `kind` at any byte of the keys, as 64-bit numbers."""
    size = np.dtype(kind).itemsize
    return lambda at: np.ascontiguousarray(k[:, at:at + size]).view(kind)[:, 0].astype(B)


def _tiny(k, n: int):
    """City of up to 16 bytes."""
    if n > 8:
        word = _reader(k)
        last = word(n - 8)
        return _pair(word(0), _right(last + B(n), n)) ^ last
    if n >= 4:
        word = _reader(k, "<u4")
        return _pair((word(0) << B(3)) + B(n), word(n - 4))
    if not n:
        return _full(k, K2, B)
    first, middle, last = (k[:, i].astype(B) for i in (0, n >> 1, n - 1))
    return _down((first + (middle << B(8))) * B(K2) ^ (B(n) + (last << B(2))) * B(K3)) * B(K2)


def _chunk(word, at: int, a, b):
    """Two words of state after 32 bytes."""
    w = [word(at + 8 * i) for i in range(4)]
    first = a + w[0]
    mixed = _right(b + first + w[3], 21)
    total = first + w[1] + w[2]
    return total + w[3], mixed + _right(total, 44) + first


def _round(word, at: int, state):
    """City's state of seven words (x, y, z and two pairs) after 64 bytes."""
    x, y, z, (v0, v1), (w0, w1) = state
    x = _right(x + y + v0 + word(at + 8), 37) * B(K1) ^ w1
    y = _right(y + v1 + word(at + 48), 42) * B(K1) + v0 + word(at + 40)
    z = _right(z + w0, 33) * B(K1)
    return z, y, x, _chunk(word, at, v1 * B(K1), x + w0), _chunk(word, at + 32, z + w1, y + word(at + 16))


def _half(word, start, end, at: tuple[int, int]):
    """One of the two halves of City on 33 to 64 bytes."""
    turned, sum_ = _right(start, 37), start + word(at[0])
    turned = turned + _right(sum_, 7)
    sum_ = sum_ + word(at[1])
    return sum_ + end, _right(start + end, 52) + _right(sum_, 31) + turned


def _city(k, n: int):
    if n <= 16:
        return _tiny(k, n)
    word = _reader(k)
    if n <= 32:
        a, b, c, d = word(0) * B(K1), word(8), word(n - 8) * B(K2), word(n - 16) * B(K0)
        return _pair(_right(a - b, 43) + _right(c, 30) + d, a + _right(b ^ B(K3), 20) - c + B(n))
    if n <= 64:
        v0, v1 = _half(word, word(0) + (word(n - 16) + B(n)) * B(K0), word(24), (8, 16))
        w0, w1 = _half(word, word(16) + word(n - 32), word(n - 8), (n - 24, n - 16))
        return _down(_down((v0 + w1) * B(K2) + (w0 + v1) * B(K0)) * B(K0) + v1) * B(K2)
    x, y, z = word(n - 40), word(n - 16) + word(n - 56), _pair(word(n - 48) + B(n), word(n - 24))
    state = (x * B(K1) + word(0), y, z, _chunk(word, n - 64, _full(k, n, B), z), _chunk(word, n - 32, y + B(K1), x))
    for at in range(0, (n - 1) // 64 * 64, 64):
        state = _round(word, at, state)
    x, y, z, v, w = state
    return _pair(_pair(v[0], w[0]) + _down(y) * B(K1) + z, _pair(v[1], w[1]) + x)


@of_length(np.uint8)
def city64(k, n, seed):
    return _pair(_city(k, n) - B(K2), _full(k, seed, B))


def _city128_short(k, n: int, a, b):
    """City's 128 bits of fewer than 128 bytes."""
    word = _reader(k)
    if n <= 16:
        a = _down(a * B(K1)) * B(K1)
        c = b * B(K1) + _tiny(k, n)
        d = _down(a + (word(0) if n >= 8 else c))
    else:
        c = _pair(word(n - 8) + B(K1), a)
        d = _pair(b + B(n), c + word(n - 16))
        a = a + d
        for at in range(0, n - 16, 16):
            a = (a ^ _down(word(at) * B(K1)) * B(K1)) * B(K1)
            b = b ^ a
            c = (c ^ _down(word(at + 8) * B(K1)) * B(K1)) * B(K1)
            d = d ^ c
    a, b = _pair(a, c), _pair(d, b)
    return np.stack([a ^ b, _pair(b, a)], axis=1)


@of_length(np.uint8)
def city128(k, n, seed):
    """128 bits, as two 64-bit columns; the seed is the first of its two words."""
    x, y = _full(k, seed, B), _full(k, 0, B)
    if n < 128:
        return _city128_short(k, n, x, y)
    word = _reader(k)
    z = _full(k, n * K1, B)
    v0 = _right(y ^ B(K1), 49) * B(K1) + word(0)
    v = v0, _right(v0, 42) * B(K1) + word(8)
    w = _right(y + z, 35) * B(K1) + x, _right(x + word(88), 53) * B(K1)
    state, whole = (x, y, z, v, w), n // 128 * 128
    for at in range(0, whole, 64):
        state = _round(word, at, state)
    x, y, z, v, (w0, w1) = state
    x, z = x + _right(v[0] + z, 49) * B(K0), z + _right(w0, 37) * B(K0)
    for at in range(n - 32, whole - 32, -32):  # from the end; the last may begin in bytes already read
        y = _right(x + y, 42) * B(K0) + v[1]
        w0 = w0 + word(at + 16)
        x = x * B(K0) + w0
        z = z + w1 + word(at)
        w1 = w1 + v[0]
        v = _chunk(word, at, v[0] + z, v[1])
    x, y = _pair(x, v[0]), _pair(y + z, w0)
    return np.stack([_pair(x + v[1], w1) + y, _pair(x + w1, y + v[1])], axis=1)


def _spooky_short(k, n: int, seed: int):
    h = [_full(k, seed, B), _full(k, seed, B), _full(k, ODD, B), _full(k, ODD, B)]

    def mix():
        for i, turn in enumerate(SHORT_MIX_TURNS):
            at, near, far = (i + 2) % 4, (i + 3) % 4, i % 4
            h[at] = _rot(h[at], turn) + h[near]
            h[far] = h[far] ^ h[at]

    for i in range(n // 16):  # sixteen bytes go to one half of the state, the next to the other
        if i % 2:
            h[0], h[1] = h[0] + k[:, 2 * i], h[1] + k[:, 2 * i + 1]
        else:
            h[2], h[3] = h[2] + k[:, 2 * i], h[3] + k[:, 2 * i + 1]
            mix()
    at, left = n // 16 * 2, n % 16
    h[3] = _full(k, n << 56, B)
    h[2] = h[2] + (k[:, at] if left else B(ODD))
    if left > 8:
        h[3] = h[3] + k[:, at + 1]
    elif not left:
        h[3] = h[3] + B(ODD)
    for i, turn in enumerate(SHORT_END_TURNS):
        to, of = (i + 3) % 4, (i + 2) % 4
        h[to] = h[to] ^ h[of]
        h[of] = _rot(h[of], turn)
        h[to] = h[to] + h[of]
    return np.stack(h[:2], axis=1)


@of_length(B)
def spooky128(k, n, seed):
    """128 bits, as two 64-bit columns; both words of the seed are equal."""
    if n < LONG:
        return _spooky_short(k, n, seed)
    h = [_full(k, (seed, seed, ODD)[i % 3], B) for i in range(12)]
    blocks = n // 96
    padded = np.zeros((len(k), (blocks + 1) * 12), B)
    padded[:, :k.shape[1]] = k[:, :padded.shape[1]]
    padded[:, -1] |= B(n % 96 << 56)
    for block in range(blocks + 1):
        for i, turn in enumerate(MIX_TURNS):
            h[i] = h[i] + padded[:, block * 12 + i]
            h[(i + 2) % 12] = h[(i + 2) % 12] ^ h[(i + 10) % 12]
            h[(i + 11) % 12] = h[(i + 11) % 12] ^ h[i]
            h[i] = _rot(h[i], turn)
            h[(i + 11) % 12] = h[(i + 11) % 12] + h[(i + 1) % 12]
    for _ in range(3):
        for i, turn in enumerate(END_TURNS):
            last, at, then = (i + 11) % 12, (i + 1) % 12, (i + 2) % 12
            h[last] = h[last] + h[at]
            h[then] = h[then] ^ h[last]
            h[at] = _rot(h[at], turn)
    return np.stack(h[:2], axis=1)


def spooky64(keys, seed: int = 0):
    return spooky128(keys, seed)[:, 0] if keys else np.zeros(0, B)


def spooky32(keys, seed: int = 0):
    return spooky64(keys, seed).astype(np.uint32)


def crc32(keys, seed: int = 0):
    """The CRC-32 that goes on from `seed`."""
    return np.fromiter((zlib.crc32(k, seed) for k in keys), np.uint32, len(keys))


ALL = {f.__name__: f for f in (city64, spooky64, spooky32)} | {"crc32_seeded": crc32}
WIDE = {f.__name__: f for f in (city128, spooky128)}
