"""Newest-wins merges of versioned logs.

A log has k, seq, is_deleted and value columns.  A tombstone takes part in
every merge and is dropped only by live_view; an empty value is no tombstone.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def upsert_latest(log: DataFrame, key: str = "k", order: str = "seq") -> DataFrame:
    """The version of greatest `order` per key, with the number of versions it replaced.

    A max_by aggregate is combined before the shuffle, so that a hot key
    sends one row a task."""
    cols = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s"), (F.count("*") - 1).alias("replaced"))
    return best.select(key, "s.*", "replaced")


def upsert_record(log: DataFrame, record: str, kept: list[str], key: str = "k", order: str = "seq") -> DataFrame:
    """(key, record, kept...): the newest record per key; the kept columns (timestamps) are not replaced but their greatest."""
    return log.groupBy(key).agg(F.max_by(record, order).alias(record), *[F.max(c).alias(c) for c in kept])


def live_view(log: DataFrame, key: str = "k", order: str = "seq") -> DataFrame:
    """The latest versions that are no tombstones."""
    return upsert_latest(log, key, order).where(~F.col("is_deleted")).drop("replaced", "is_deleted")


def first_wins(rows: DataFrame, *priority: Column, key: str = "k") -> DataFrame:
    """The row of least priority per key, tombstones included."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*priority)).alias("s")).select(key, "s.*")


def priority_merge(runs: list[DataFrame], key: str = "k") -> DataFrame:
    """Sorted-run merge: one row per key over all runs, the earliest run of the list wins.

    Every key is kept.  Each run must hold a key once."""
    tagged = [r.withColumn("prio", F.lit(i)) for i, r in enumerate(runs)]
    return first_wins(reduce(lambda a, b: a.unionByName(b), tagged), F.col("prio"), key=key)


def level_lookup(rows: DataFrame, key: str = "k") -> DataFrame:
    """First hit per key by level, tier (ascending) and run (descending), then the newest version of it."""
    return first_wins(rows, F.col("level"), F.col("tier"), -F.col("run"), -F.col("seq"), key=key)
