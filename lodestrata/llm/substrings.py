"""Substring dedup by content-defined chunks (operator 8).

A gear rolling hash over the last eight bytes ends a chunk where it falls
below a bound; so boundaries depend on the text nearby alone, and an
insertion moves no chunk but its own.  A chunk that grows too long is cut at
its lowest hashes.  Chunks are compared by digest; runs of adjacent chunks
that other documents hold too are repeated passages.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

#: A chunk ends at a byte with this chance in 256: about 21 bytes in the mean.
ENDS = 12
#: Bytes of a chunk at most, some four times the mean.
MOST = 96
#: Passages of up to so many words are left alone.  Runs whose whole chunks hold no more are compared byte by byte.
SHORT = 50
#: Asks about one document that are compared with one copy of its text.
PART = 64
#: Documents that are asked for are broadcast up to so many ids (some 100 MB), and joined by a shuffle beyond.
FEW = 1 << 22
_W = 8  # bits of a chunk's size and numbers of words; so a chunk has 255 bytes at most
_GEAR = np.random.default_rng(11).integers(0, 256, 256, dtype=np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def chunk_ends(data: bytes, ends: int = ENDS, most: int = MOST) -> np.ndarray:
    """Offsets behind the chunks of data; the last is its length.

    A chunk that would have over `most` bytes ends at the last of the lowest
    hashes in its first `most`: a text that repeats one word, where the bound
    may never be met, is cut in step with the word wherever it begins."""
    return _ends(data, ends, most)[0]


def _ends(data: bytes, ends: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunks' ends, and which of them cut a chunk that grew too long."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    g = _GEAR[np.frombuffer(data, np.uint8)]
    h = g.copy()
    for j in range(1, min(8, len(g))):
        h[j:] += g[:-j] << np.uint8(j)
    at = np.flatnonzero(h < ends) + 1
    at = at if len(at) and at[-1] == len(data) else np.append(at, len(data))
    begin, more = np.concatenate([[0], at[:-1]]), []
    for i in np.flatnonzero(at - begin > most).tolist():
        start, stop = int(begin[i]), int(at[i])
        while stop - start > most:
            start += most - int(h[start : start + most][::-1].argmin())
            more.append(start)
    every = np.concatenate([at, np.array(more, np.int64)])
    order = np.argsort(every)
    return every[order], order >= len(at)


def _words_near(begins: np.ndarray, s: np.ndarray, e: np.ndarray, forced: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word starts in each chunk, and at most as many as a shared passage may hold before and after it.

    A boundary depends on the eight bytes before it.  So a passage that begins
    before a run of whole chunks begins in the chunk before, or in the seven
    bytes before that; one that ends behind the run ends in the chunk after.
    Where a chunk was cut for its length, one chunk more is counted."""
    w = np.searchsorted(begins, e) - np.searchsorted(begins, s)
    near = np.searchsorted(begins, s) - np.searchsorted(begins, s - 7)
    begins_forced = np.concatenate([[False], forced[:-1]])
    last = np.concatenate([[0], (w + near)[:-1]])  # of the chunk before
    before = w + np.where(begins_forced, last, near)
    after = w + np.where(forced, np.concatenate([w[1:], [0]]), 0)
    return w, np.concatenate([[0], before[:-1]]), np.concatenate([after[1:], [0]])


def _chunks(docs: DataFrame, ends: int, most: int, places: bool) -> DataFrame:
    """(digest, doc_id[, copy][, place]) of every chunk; copy is there if docs has it.

    place packs the chunk's start, its size and the word starts in it, before
    and after it (_words_near), from the highest bits down; all but the start
    have _W bits, which hold the words of two chunks of `most` bytes."""
    if not 0 < most < 1 << _W:
        raise ValueError(f"chunks of {most} bytes don't fit in {_W} bits")

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, cols = zip(*(c.to_pylist() for c in b.columns[:-1])), [[] for _ in names]
            for own, text in zip(ids, b.column(b.num_columns - 1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not data or own[0] is None:
                    continue
                e, forced = _ends(data, ends, most)
                s = np.concatenate([[0], e[:-1]])
                cols[0].append(np.array([digest(data[x:y]) for x, y in zip(s.tolist(), e.tolist())], np.uint64).view(np.int64))
                for c, value in zip(cols[1:], own):
                    c.append(np.full(len(e), value, np.int64))
                if places:
                    blank = _SPACE[np.frombuffer(data, np.uint8)]
                    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
                    w, before, after = _words_near(begins, s, e, forced)
                    cols[-1].append(s << 4 * _W | (e - s) << 3 * _W | w << 2 * _W | before << _W | after)
                if sum(map(len, cols[0][-50:])) > 200_000 or len(cols[0]) >= 2000:
                    yield pa.RecordBatch.from_pydict({n: np.concatenate(c).astype(np.int64) for n, c in zip(names, cols)})
                    cols = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_pydict({n: np.concatenate(c).astype(np.int64) for n, c in zip(names, cols)})

    own = ["doc_id"] + ["copy"] * ("copy" in docs.columns)
    names = ["digest", *own] + ["place"] * places
    return docs.select(*own, "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _left(data: bytes, start: int, words: int) -> bytes:
    """So many words before start; a line end stands for the begin of data."""
    size = 16 * words
    while True:
        size *= 4
        part = data[max(0, start - size) : start]
        spare = part.rsplit(None, words)
        if len(spare) > words:
            return part[len(spare[0]) :]
        if size >= start:
            return b"\n" + part


def _right(data: bytes, start: int, words: int) -> bytes:
    """So many words from start on; a line end stands for the end of data."""
    size = 16 * words
    while True:
        size *= 4
        part = data[start : start + size]
        spare = part.split(None, words)
        if len(spare) > words:
            return part[: len(part) - len(spare[-1])]
        if start + size >= len(data):
            return part + b"\n"


_ASK = "doc_id long, copy long, run long, other long, part long"


def _context(short: int):
    """For each chunk asked about, its bytes and the text on either side as far as short + 1 words."""
    names = [*(x.split()[0] for x in _ASK.split(", ")), "left", "chunk", "right"]
    schema = pa.schema([(n, pa.int64()) for n in names[:5]] + [(n, pa.binary()) for n in names[5:]])

    def run(batches):
        for b in batches:
            rows = []
            for doc, copy, asks, text in zip(*b.columns):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for ask in asks.as_py():
                    start, size = ask["place"] >> 4 * _W, ask["place"] >> 3 * _W & (1 << _W) - 1
                    stop = start + size
                    rows.append((doc.as_py(), copy.as_py(), ask["run"], ask["other"], ask["part"], _left(data, start, short + 1), data[start:stop], _right(data, stop, short + 1)))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _same(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    x = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(x[0]) if len(x) else n


def shared_words(left: bytes, chunk: bytes, right: bytes, other: bytes, enough: float = float("inf")) -> int:
    """Whole words around and in chunk that other holds in a row, at the best of the chunk's places in it.

    The search ends at the first place with more than `enough`."""
    best, at, other = 0, 0, b"\n" + other + b"\n"
    while chunk and best <= enough and (at := other.find(chunk, at)) >= 0:
        l = _same(left[::-1], other[max(0, at - len(left)) : at][::-1])
        r = _same(right, other[at + len(chunk) : at + len(chunk) + len(right)])
        part = left[len(left) - l :] + chunk + right[:r]
        words = len(part.split())
        # a word that goes on beyond the common bytes, in either text, is no whole word
        ends = (part[:1], left[len(left) - l - 1 : len(left) - l], other[at - l - 1 : at - l]), (part[-1:], right[r : r + 1], other[at + len(chunk) + r :][:1])
        words -= sum(not e[0].isspace() and any(x and not x.isspace() for x in e[1:]) for e in ends)
        best, at = max(best, words), at + 1
    return best


def _held(short: int):
    """The runs of which a document shares more than `short` words in a row."""

    def run(batches):
        for b in batches:
            rows = []
            for other, asks, text in zip(*b.columns):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for ask in asks.as_py():
                    if shared_words(ask["left"], ask["chunk"], ask["right"], data, short) > short:
                        rows.append((ask["doc_id"], ask["copy"], ask["run"], other.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "copy", "run", "other"])

    return run


def _small(ids: DataFrame) -> DataFrame:
    """ids to be broadcast where they are few enough, so that texts nobody asks for aren't shuffled."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def _confirmed(short_runs: DataFrame, docs: DataFrame, short: int) -> DataFrame:
    """(doc_id, copy, run, found) for the runs that another document shares more than `short` words with.

    A document's asks travel as one list to its text, which is sent once; the
    asks about one document are dealt to parts of about PART, each with the
    text, so that a document that many ask about is no one task's."""
    asks = short_runs.select("doc_id", "copy", "run", F.explode("held").alias("h")).groupBy("doc_id", "copy", "run", F.col("h.other").alias("other")).agg(F.min("h.place").alias("place"))
    parts = asks.groupBy("other").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = asks.join(parts, "other").withColumn("part", F.pmod(F.xxhash64("doc_id", "copy", "run"), "parts"))
    own = dealt.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("run", "other", "part", "place")).alias("asks"))
    text = docs.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "text").distinct() if "copy" in docs.columns else docs.select(F.col("doc_id").alias("d"), F.lit(0).cast("long").alias("c"), "text")
    mine = text.join(_small(short_runs.select(F.col("doc_id").alias("d")).distinct()), "d", "left_semi")
    around = own.join(mine, (F.col("doc_id") == F.col("d")) & (F.col("copy") == F.col("c"))).select("doc_id", "copy", "asks", "text")
    around = around.mapInArrow(_context(short), f"{_ASK}, left binary, chunk binary, right binary")
    around = around.groupBy("other", "part").agg(F.collect_list(F.struct("doc_id", "copy", "run", "left", "chunk", "right")).alias("asks"))
    theirs = text.join(_small(parts.withColumnRenamed("other", "d")), "d").select("d", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    meet = around.join(theirs, (F.col("other") == F.col("d")) & (F.col("part") == F.col("p"))).select("other", "asks", "text")
    return meet.mapInArrow(_held(short), "doc_id long, copy long, run long, other long").groupBy("doc_id", "copy", "run").agg(F.min("other").alias("found"))


def repeated_passages(docs: DataFrame, short: int = SHORT, ends: int = ENDS, most: int = MOST) -> DataFrame:
    """(doc_id, start, size, n_words, other_doc_id, first): one row per passage that another document holds too.

    A passage is a run of whole repeated chunks with more than `short` words.  A
    run of fewer, which with the words next to it (_words_near) may have more, is
    one if a document that holds one of its chunks shares more than `short`
    words in a row there, compared byte by byte.  start, size and n_words are
    of the whole chunks, start and size in UTF-8 bytes; other_doc_id holds the
    run's first chunk, or the short run's passage; first tells that it is
    greater than doc_id.  Documents without such
    passages have no row.  Null and empty texts and rows with a null doc_id
    have no chunks; rows with equal doc_id count as one document, but the
    places are those of each distinct text; other columns are ignored; an empty table gives an empty table.  A digest's
    documents are only ever folded to the least and the greatest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    h, key = F.xxhash64("text"), ["doc_id"]
    twice = docs.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi and doc_id is not null").select("doc_id")
    if not twice.isEmpty():  # rare: only then rows have to tell the texts of a document apart
        docs = docs.join(twice.withColumn("copy", F.lit(True)), "doc_id", "left").withColumn("copy", F.when(F.col("copy"), h).otherwise(F.lit(0)))
        key += ["copy"]
    span = _chunks(docs, ends, most, False).groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    hit = _chunks(docs, ends, most, True).join(span, "digest")
    # a row is narrow until it has reached its document; one shuffle serves the distinct rows and the windows
    row = hit.select(*key, "place", F.when(F.col("doc_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("other")).repartition(*key).distinct()
    part = lambda i: F.shiftright("place", _W * i).bitwiseAND(F.lit((1 << _W) - 1))
    w = Window.partitionBy(*key).orderBy("place")
    row = row.select(*key, "place", "other", F.shiftright("place", 4 * _W).alias("start"), part(3).alias("size"), part(2).alias("words"))
    new = F.when(F.lag(F.col("start") + F.col("size")).over(w) == F.col("start"), 0).otherwise(1)
    run = row.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.collect_list(F.struct("other", "place")).alias("held")
    out = run.groupBy(*key, "run").agg(F.min("start").alias("start"), F.sum("size").alias("size"), F.sum("words").alias("n_words"), F.min("place").alias("begin"), F.max("place").alias("place"), F.min_by("other", "place").alias("other_doc_id"), held)
    before, after = F.shiftright("begin", _W).bitwiseAND(F.lit((1 << _W) - 1)), part(0)
    out = out.where(F.col("n_words") + before + after > short)
    out = cut(out.withColumn("held", F.when(F.col("n_words") <= short, F.col("held"))).drop("begin", "place"))
    if len(key) == 1:
        out = out.withColumn("copy", F.lit(0).cast("long"))
    short_runs = out.where(F.col("n_words") <= short)
    found = _confirmed(short_runs, docs, short)
    few = short_runs.join(found, ["doc_id", "copy", "run"]).withColumn("other_doc_id", F.col("found"))
    columns = ["doc_id", "start", "size", "n_words", "other_doc_id"]
    return out.where(F.col("n_words") > short).select(columns).union(few.select(columns)).withColumn("first", F.col("other_doc_id") > F.col("doc_id"))
