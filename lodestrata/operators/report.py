"""Benchmark series and outlier trimming, and text lint predicates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.util import cut, ordered

POINT = "struct<x:double,y:double>"


def series(points: DataFrame, title: str, x: str, y: str) -> DataFrame:
    """(title, data): the points of each title by x."""
    return points.groupBy(F.col(title).alias("title")).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("data"))


def save_series(s: DataFrame, path: str) -> None:
    s.write.json(path)


def load_series(spark, path: str, multi_line: bool = False) -> DataFrame:
    """(title, x, y) of saved series; multi_line reads one JSON array."""
    s = spark.read.schema(f"title string, data array<{POINT}>").option("multiLine", multi_line).json(path)
    return s.select("title", F.explode("data").alias("p")).select("title", "p.x", "p.y")


def keep_titles(s: DataFrame, family: str, kept: list[str]) -> DataFrame:
    """Drops titles that start with family but for the kept ones."""
    return s.where(~F.col("title").startswith(family) | F.col("title").isin([family + k for k in kept]))


def throughput(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds)


def trim_outliers(samples: DataFrame, value: str) -> DataFrame:
    """The samples below the upper outliers, as (value).

    A prefix of the sorted samples grows by falling powers of two while its
    largest value is within three standard deviations of its mean; so the
    largest sample is always dropped.  Each step is one aggregate."""
    d = cut(ordered(samples.select(value), value).select(value, "pos"))
    n = d.count()
    size, step = 0, 1 << max(0, n.bit_length() - 1)
    while step:
        to = size | step
        if to < n:
            r = d.where(F.col("pos") < to).agg(F.avg(value), F.stddev_pop(value), F.max(value)).first()
            if r[2] <= r[0] + 3 * r[1]:
                size = to
        step >>= 1
    return d.where(F.col("pos") < size).select(value)


def trim_both(samples: DataFrame, value: str, rounds: int = 10, width: float = 3.0) -> DataFrame:
    """The samples left after so many rounds that drop what is over `width` standard deviations from the mean of what is left, as (value)."""
    d = samples.select(value).where(F.col(value).isNotNull())
    for _ in range(rounds):
        a, s = d.agg(F.avg(value), F.stddev_pop(value)).first()
        if a is None:
            break
        d = d.where(F.abs(F.col(value) - F.lit(a)) <= F.lit(width * s))
    return d


# Fixed values of the header rule.
TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "merge", "revert")
HEADER = r"^([a-z]+)\((.*?)\)([!]?): (.*?)$"
BRANCH = r"^[0-9a-z]+(-[0-9a-z]+)*$"
WIDTH = 80


def rectified(s: Column) -> Column:
    """A description in its accepted form."""
    s = F.regexp_replace(s, r"[^\x00-\xFF]", "")
    s = F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
    s = F.regexp_replace(F.btrim(s, F.lit(" \t\n\r\x0b\x0c")), r"[ \t\r\n]+", " ")
    return F.regexp_replace(s, r"[^a-zA-Z0-9]+$", "")


def header_ok(header: Column, scopes, types=TYPES) -> Column:
    """Whether a header has the shape, a known type and scope, and a description in its accepted form."""
    part = lambda i: F.regexp_extract(header, HEADER, i)
    return F.coalesce(header.rlike(HEADER) & part(1).isin(*types) & part(2).isin(*scopes) & (F.length(part(4)) > 0) & (rectified(part(4)) == part(4)), F.lit(False))


def body_ok(text: Column) -> Column:
    """Lines after the first: no white space at their ends, no more than WIDTH characters below 256 and no tabs; no triple and no last line break."""
    lines = F.slice(F.split(text, "\n"), F.lit(2), F.greatest(F.size(F.split(text, "\n")) - 1, F.lit(0)))
    body = F.array_join(lines, "\n")
    fine = F.forall(lines, lambda x: (F.length(x) <= WIDTH) & ~x.rlike(r"[^\x00-\xFF]|\t|[\x09-\x0D\x1C-\x20\x85\xA0]\z"))
    return F.coalesce(fine & ~body.contains("\n\n\n") & ~body.endswith("\n"), F.lit(False))


def branch_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(BRANCH), F.lit(False))
