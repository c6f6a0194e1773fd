"""Line dedup across documents (operator 6), DataFrame functions only.

Hashes of line keys are range-partitioned by (hash, salt) and sorted by
document and position within; one streaming pass per (hash, salt) finds the
first document, and is told where another salt's is smaller.  The salts spread
a line that much of the corpus holds; their number grows with the lines.  What
is returned per document is a run-length keep bitmap, not text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .common import LOWER, SPACE, UPPER, cut

SALTS = 64
#: Lines for which there is one salt more.
LINES_A_SALT = 1 << 20
MIN_CHARS = 10


#: What lower() may change besides A-Z.
CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lower-cased.

    translate goes by character through a map; lower, which is much faster,
    does the same where only A-Z can change."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only | ~F.rlike(bare, F.lit(CASED)), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def salts_for(lines: int, least: int) -> int:
    return least + lines // LINES_A_SALT


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """(doc_id, th, pos): lines whose key is first held by a smaller doc_id.

    th is a hash of the row's text, so that rows with equal doc_id stay apart.
    There are `salts` salts and one more per LINES_A_SALT lines, see salts_for;
    how many never changes the result."""
    line = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    line = line.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where((F.length("key") >= min_chars) & F.col("doc_id").isNotNull())
    line, seen = line.select(F.unhex(F.md5("key")).alias("h"), "doc_id", "th", "pos"), Observation()
    # sampling the ranges reads the lines once more: texts are split but once
    line = cut(line.observe(seen, F.count(F.lit(1)).alias("n")))
    n_salts = salts_for(seen.get.get("n") or 0, salts)
    line = line.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).cast("int")).repartitionByRange("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "pos")
    own = Window.partitionBy("h", "salt").orderBy("doc_id", "pos")
    line = line.withColumn("first_here", F.first("doc_id").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # at most a row a salt is left of a hash; only where another salt's first document is smaller, the pass needs to be told
    every = Window.partitionBy("h")
    firsts = line.withColumn("nth", F.row_number().over(own)).where("nth = 1")
    lower = firsts.select("h", "salt", "first_here", F.min("first_here").over(every).alias("lo")).where("lo < first_here").select("h", "salt", "lo")
    return line.join(lower, ["h", "salt"], "left").where(F.col("doc_id") > F.coalesce("lo", "first_here")).select("doc_id", "th", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """(doc_id, th, n_dropped, runs) for documents that lose lines.

    runs: the bitmap's lengths of drop runs and gaps, as [start, length] of
    each dropped run in line order."""
    d = dropped_lines(docs, min_chars, salts).distinct()
    w = Window.partitionBy("doc_id", "th").orderBy("pos")
    runs = d.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("doc_id", "th", "g").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy("doc_id", "th").agg(F.sum("length").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines of the dropped runs."""
    lines, n = _lines(text), F.size(runs)
    start = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(runs, i)["start"] + F.try_element_at(runs, i)["length"])
    stop = lambda i, all_: F.when(i == n, all_).otherwise(F.try_element_at(runs, i + 1)["start"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i) + 1, stop(i, F.size(lines)) - start(i)))
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))


def _marked(docs: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """docs with _n and _r: lines dropped and their runs, null where none is."""
    marks = keep_bitmaps(docs, min_chars, salts).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("n_dropped").alias("_n"), F.col("runs").alias("_r"))
    return docs.join(marks, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left").drop("_d", "_t")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """docs with text stripped of repeated lines, and n_lines, n_dropped.

    A null or empty text is one empty line.  Keys shorter than min_chars code
    points never count.  The smallest doc_id that holds a key keeps all its
    lines; rows with equal doc_id count as one document; rows with a null
    doc_id keep everything.  Other columns pass through, but for columns of
    docs named n_lines or n_dropped, which are replaced."""
    full = _marked(docs, min_chars, salts)
    return full.withColumns({"n_lines": F.size(_lines(F.col("text"))).cast("long"), "n_dropped": F.coalesce("_n", F.lit(0)).cast("long"), "text": kept_text(F.col("text"), F.col("_r"))}).drop("_n", "_r")


SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
firsts AS (SELECT k, min(doc_id) AS lo FROM lines WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.lo, false) AS gone FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """docs with text stripped of repeated lines and n_chars, where docs has it, counted anew.

    Documents that lose all lines are left out; documents that came without
    lines (null or empty text) stay as they are.  Other columns pass through,
    whatever their names."""
    full = _marked(docs, min_chars, salts).where(F.coalesce("_n", F.lit(0)) < F.size(_lines(F.col("text"))))
    out = full.withColumn("text", kept_text(F.col("text"), F.col("_r"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
