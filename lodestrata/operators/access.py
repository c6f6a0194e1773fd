"""Reads of ordered key-value tables.  Key predicates reach the scan."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.util import ordered


def point_get(t: DataFrame, k, key: str = "k") -> DataFrame:
    return t.where(F.col(key) == F.lit(k))


def multi_get(t: DataFrame, keys: DataFrame, key: str = "k") -> DataFrame:
    """Rows whose key is in keys (a column of the same name)."""
    return t.join(keys.select(key).distinct(), key, "left_semi")


def range_scan(t: DataFrame, low, high, key: str = "k") -> DataFrame:
    """Rows of low <= key < high; either bound may be None."""
    t = t if low is None else t.where(F.col(key) >= F.lit(low))
    return t if high is None else t.where(F.col(key) < F.lit(high))


def seek_lower_bound(t: DataFrame, k, key: str = "k") -> DataFrame:
    """Rows from the first key not less than k on (an extension: see seek_exact)."""
    return range_scan(t, k, None, key)


def seek_exact(t: DataFrame, k, key: str = "k") -> DataFrame:
    """Rows from k on, but none if k itself is missing."""
    hit = point_get(t, k, key).select(F.lit(1).alias("_hit")).limit(1)
    return seek_lower_bound(t, k, key).withColumn("_hit", F.lit(1)).join(F.broadcast(hit), "_hit", "left_semi").drop("_hit")


def full_scan(t: DataFrame, key: str = "k") -> DataFrame:
    """All rows with their position in key order."""
    return ordered(t, key)


def display(k, v, is_deleted, cached):
    """'k' -> 'v', or removed; bytes that aren't UTF-8 show as ????."""
    text = lambda c: F.when(F.is_valid_utf8(c), c).otherwise("????")
    head = F.concat(F.lit("'"), text(k), F.lit("' -> "))
    tail = F.when(is_deleted, F.lit("removed")).otherwise(F.concat(F.lit("'"), text(v), F.lit("'")))
    return F.concat(head, tail, F.when(cached, F.lit(" [cached]")).otherwise(F.lit("")))
