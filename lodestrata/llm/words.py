"""Words of texts as indices into a bounded table of per-word values."""
from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np


class WordTable:
    """Maps words to rows of a value matrix; new words get theirs from `values`.

    values takes a list of words and returns an array with a row for each; it
    gets about `chars` characters at a time.  Between batches the table is emptied when it holds over `most` words."""

    def __init__(self, values: Callable[[list[str]], np.ndarray], most: int = 400_000, chars: int = 1_000_000):
        self.values, self.most, self.chars = values, most, chars
        self.index: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def batch(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Row numbers of each text's words (runs of other than white space), and the matrix."""
        split = [t.split() if t else [] for t in texts]
        if len(self.index) > self.most:
            self.index, self.rows = {}, None
        known = self.index
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in known]
        if new or self.rows is None:
            n = len(known)
            known.update(zip(new, range(n, n + len(new))))
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // self.chars
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(new)]
            got = np.concatenate([self.values(new[a:b]) for a, b in zip(cuts, cuts[1:])])
            if self.rows is None:
                self.rows = got
            else:
                if len(known) > len(self.rows):
                    more = np.zeros((max(len(known), 2 * n) - len(self.rows), *got.shape[1:]), got.dtype)
                    self.rows = np.concatenate([self.rows, more])
                self.rows[n : n + len(new)] = got
        return [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in split], self.rows


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bucket(feature: str, size: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % size


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def hashed_grams(words: list[str], sizes, size: int, prefixes=(), suffixes=()) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: (bucket, number of the word) pairs, in no order.

    They are the word, its character n-grams of `sizes` with < and > at its
    ends, and its prefixes and suffixes of so many characters, where it has
    them.  Empty words have none."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    some = np.flatnonzero(n)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer("".join([f"<{words[i]}>" for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = n[some] + 2
    start = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(c)) - start[own]).astype(np.uint64)
    found = [(_mixed(np.add.reduceat(_mixed(c * _A + place * _B), start)), np.arange(len(n)))]
    h = np.zeros(len(c), np.uint64)
    for k in range(1, max([0, *sizes, *prefixes, *suffixes]) + 1):
        if k > len(c):
            break
        h = _mixed((h[: len(c) - k + 1] ^ c[k - 1 :]) * _A)  # of the k characters from each place on
        if k in sizes:
            whole = own[: len(h)] == own[k - 1 :]
            found.append((h[whole], own[: len(h)][whole]))
        long = np.flatnonzero(n - 2 >= k)
        if k in prefixes:
            found.append((_mixed(h[start[long] + 1] + np.uint64(1)), long))
        if k in suffixes:
            found.append((_mixed(h[start[long] + n[long] - 1 - k] + np.uint64(2)), long))
    return np.concatenate([x for x, _ in found]).astype(np.uint64).__mod__(np.uint64(size)).astype(np.int64), some[np.concatenate([o for _, o in found])]


def ragged_sum(matrix: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of matrix[flat] over consecutive stretches; empty stretches give 0."""
    out = np.zeros((len(lengths), *matrix.shape[1:]), matrix.dtype)
    some = lengths > 0
    if len(flat):
        out[some] = np.add.reduceat(matrix[flat], (np.cumsum(lengths) - lengths)[some], axis=0)
    return out
