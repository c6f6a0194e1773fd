"""Byte-level BPE encoding and decoding (operator 5).

A segment tree over byte positions holds, in each node, the leftmost position
of the lowest pair rank below it.  A merge takes the root's position, joins
the pair there and updates the two pairs that its live neighbours form.
"""
from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .common import per_batch, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE = 600_000
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern; an empty piece has none."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    # a node is rank * 2^32 + position, so that the least is the leftmost of the lowest rank
    get = ranks.get
    tree = [_NONE << 32] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    stop = list(range(1, n + 1))  # of the part that starts here
    start = list(range(-1, n))  # of the part before the one that starts here

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            a = a if a < b else b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1

    def pair(i: int) -> int:
        j = stop[i]
        r = get(piece[i : stop[j]]) if j < n else None
        return _NONE << 32 if r is None else r << 32 | i

    while (top := tree[1]) < _NONE << 32:
        i = top & 0xFFFFFFFF
        j = stop[i]
        stop[i] = end = stop[j]
        if end < n:
            start[end] = i
        put(j, _NONE << 32) if j < n - 1 else None
        put(i, pair(i))
        if start[i] >= 0:
            put(start[i], pair(start[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class Pairs:
    """Which ids two adjacent ids merge into: sorted keys of all splits of the vocabulary's entries."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[w[:i]] << 32 | ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        keys, values = np.array(found or [(-1, -1)], np.int64).T
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; -1 for pairs that don't merge."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], -1)


def encode_many(pieces: list[bytes], single: np.ndarray, pairs: Pairs) -> list[np.ndarray]:
    """encode_piece for pieces of 2 to 129 bytes at once: one segment tree a row, merged in step."""
    m, none = len(pieces), np.int64(1 << 60)
    n = np.fromiter(map(len, pieces), np.int64, m)
    width = 1 << int(n.max() - 2).bit_length() if n.max() > 2 else 1
    rows, cols = np.arange(m), np.arange(width + 1)
    flat = np.zeros((m, width + 1), np.int64)
    flat[cols[None] < n[:, None]] = single[np.frombuffer(b"".join(pieces), np.uint8)]
    tok = flat
    nxt = np.broadcast_to(cols + 1, tok.shape).copy()
    prv = np.broadcast_to(np.arange(-1, width + 1), (m, width + 2)).copy()
    first = pairs(tok[:, :-1], tok[:, 1:])
    first[cols[None, 1:] >= n[:, None]] = -1
    levels = [np.full((m, width + 1), none)]  # its last column is no leaf
    levels[0][:, :width] = np.where(first < 0, none, first << 8 | cols[:-1])
    while (w := levels[-1].shape[1] - (len(levels) == 1)) > 1:
        levels.append(np.minimum(levels[-1][:, 0:w:2], levels[-1][:, 1:w:2]))
    live = rows
    while len(live := live[levels[-1][live, 0] < none]):
        top = levels[-1][live, 0]
        i = top & 255
        j = nxt[live, i]
        end = nxt[live, j]
        tok[live, i] = top >> 8
        nxt[live, i] = end
        prv[live, end] = i
        before = prv[live, i]
        # the pairs that start at i and at the part before it
        r2, p2 = np.concatenate([live, live]), np.concatenate([i, before])
        q2 = np.concatenate([end, i])
        fine = (p2 >= 0) & (q2 < n[r2])
        got = pairs(tok[r2, np.maximum(p2, 0)], tok[r2, np.minimum(q2, width)])
        levels[0][live, j] = none
        ok = p2 >= 0
        levels[0][r2[ok], p2[ok]] = np.where(fine & (got >= 0), got << 8 | p2, none)[ok]
        r3, p3 = np.concatenate([live, live, live]), np.concatenate([i, np.maximum(before, 0), np.minimum(j, width - 1)])
        for low, high in zip(levels, levels[1:]):
            p3 = p3 >> 1
            high[r3, p3] = np.minimum(low[r3, 2 * p3], low[r3, 2 * p3 + 1])
    starts = np.zeros(tok.shape, bool)
    at, open_ = np.zeros(m, np.int64), rows
    while len(open_):
        starts[open_, at[open_]] = True
        at[open_] = nxt[open_, at[open_]]
        open_ = open_[at[open_] < n[open_]]
    return np.split(tok[starts], np.cumsum(starts.sum(axis=1))[:-1])


class Codec:
    """Encoder and decoder of a rank file; the cache holds the ids of at most cache pieces."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.ranks = load_ranks(path)
        top = max(self.ranks.values()) + 1
        self.bytes = [b""] * top
        for b, i in self.ranks.items():
            self.bytes[i] = b
        self.names = [str(i) for i in range(top)]
        self.kind = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.single = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        # \s of the rank file's library is the White_Space property
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces, as bytes of self.kind."""
        out: dict[str, bytes] = {}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            b = s.encode("utf-8", "surrogatepass")
            if len(b) > 1 and b not in self.ranks and len(b) <= 129:
                by.setdefault((len(b) - 2).bit_length(), []).append((s, b))
            else:
                out[s] = np.array(encode_piece(b, self.ranks), self.kind).tobytes()
        for group in by.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                for (s, _), ids in zip(part, encode_many([b for _, b in part], self.single, self.pairs)):
                    out[s] = ids.astype(self.kind).tobytes()
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.cache)
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set(chain.from_iterable(split))
        known, extra = self.cache, self._learn(new)
        known.update(extra)
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), self.kind).tolist() for s in split]
        if len(known) > self.most:
            known.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec: its rank file is read once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def tokenize(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row of docs.

    path: a rank file present on every executor.  Null and empty texts have no
    ids.  Digests are of the decimal ids joined by commas, and of the bytes
    that the ids decode to.  Rows with equal doc_id each give a row; other
    columns are ignored; an empty table gives an empty table."""

    def batch(b):
        c = codec(path, pattern)
        out = {"doc_id": b.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if ids else {})
        for part in small_batches(b.column(1)):
            for got in c.encode_batch(part):
                out["n_tokens"].append(len(got))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(c.names.__getitem__, got)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(got)).hexdigest())
                if ids:
                    out["ids"].append(got)
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), batch, schema)
