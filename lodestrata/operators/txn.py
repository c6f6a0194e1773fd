"""Timestamp-ordering verdicts over operation logs.

Rejected operations move no timestamps, so a key's verdicts are a sequential
fold.  Rows are partitioned by key and sorted by (key, seq); the fold runs
over the partition as a stream and holds one key's two timestamps.
"""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.util import cut


class KeyState:
    """Read and write timestamps of one key."""

    def __init__(self, ts_read: int = 0, ts_write: int = 0):
        self.ts_read, self.ts_write = ts_read, ts_write

    def apply(self, op: str, ts: int) -> tuple[str, int | None]:
        """The verdict (ok, skip, abort), and the writer that the operation depends on."""
        late = self.ts_write > ts
        if op == "R":
            if late:
                return "abort", None
            dep = self.ts_write
            self.ts_read = max(self.ts_read, ts)
        elif op == "W":
            if self.ts_read > ts:
                return "abort", None
            if late:  # a newer write stands: this one is not needed
                return "skip", None
            self.ts_write, dep = ts, 0
        else:
            if self.ts_read > ts or late:
                return "abort", None
            dep = self.ts_write
            self.ts_read = self.ts_write = ts
        return "ok", dep if dep not in (0, ts) else None


def verdicts(ops: DataFrame) -> DataFrame:
    """(seq, k, ts, op, verdict, dep, ts_read, ts_write): timestamps are the key's after the operation."""

    def fold(batches):
        key, state = None, KeyState()
        for b in batches:
            out = []
            for k, op, ts in zip(b.k, b.op, b.ts):
                if k != key:
                    key, state = k, KeyState()
                out.append((*state.apply(op, ts), state.ts_read, state.ts_write))
            v = pd.DataFrame(out, columns=["verdict", "dep", "ts_read", "ts_write"])
            yield pd.DataFrame({"seq": b.seq, "k": b.k, "ts": b.ts, "op": b.op, "verdict": v.verdict, "dep": v.dep.astype("Int64"), "ts_read": v.ts_read, "ts_write": v.ts_write})

    d = ops.select("seq", "k", "ts", "op").repartition("k").sortWithinPartitions("k", "seq")
    return d.mapInPandas(fold, "seq long, k string, ts long, op string, verdict string, dep long, ts_read long, ts_write long")


def dependencies(v: DataFrame) -> DataFrame:
    """Distinct (ts, dep): transaction ts read what transaction dep wrote."""
    return v.where("dep is not null").select("ts", "dep").distinct()


def status(v: DataFrame) -> DataFrame:
    """(ts, status): aborted if any operation was rejected, else committed."""
    return v.groupBy("ts").agg(F.when(F.max((F.col("verdict") == "abort").cast("int")) == 1, "aborted").otherwise("committed").alias("status"))


def cascade(v: DataFrame) -> DataFrame:
    """(ts) of the transactions that an abort takes down: the aborted ones and all that depend on them, at any remove.

    Each round writes its own front only."""
    v = cut(v)
    deps = cut(dependencies(v))
    fronts = [cut(status(v).where("status = 'aborted'").select("ts"))]
    while not fronts[-1].isEmpty():
        reached = reduce(DataFrame.union, fronts)
        fronts.append(cut(deps.join(fronts[-1].withColumnRenamed("ts", "dep"), "dep", "left_semi").select("ts").distinct().join(reached, "ts", "left_anti")))
    return reduce(DataFrame.union, fronts)


def _valued(v: DataFrame, values: DataFrame) -> DataFrame:
    """Verdicts with the value that each operation brings (null: a tombstone) and whether it wrote."""
    wrote = F.col("op").isin("W", "RW") & (F.col("verdict") == "ok")
    return v.join(values.select("seq", "value"), "seq").withColumn("wrote", wrote)


def read_values(v: DataFrame, values: DataFrame) -> DataFrame:
    """(seq, k, ts, writer, value) of the accepted reads: the operation that wrote what they read, and its value.

    writer is null where nothing was written before, value too for a
    tombstone.  values: (seq, value)."""
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("wrote"), F.struct("seq", "value")), ignorenulls=True).over(w)
    d = _valued(v, values).withColumn("last", last).where(F.col("op").isin("R", "RW") & (F.col("verdict") == "ok"))
    return d.select("seq", "k", "ts", F.col("last.seq").alias("writer"), F.col("last.value").alias("value"))


def undo_log(v: DataFrame, values: DataFrame) -> DataFrame:
    """(ts, seq, k, old_ts_write, old_value): what each accepted write replaced; 0 and null where nothing stood."""
    w = Window.partitionBy("k").orderBy("seq")
    d = _valued(v, values).where("wrote")
    return d.select("ts", "seq", "k", F.lag("ts", 1, 0).over(w).alias("old_ts_write"), F.lag("value").over(w).alias("old_value"))


def rolled_back(v: DataFrame, values: DataFrame) -> DataFrame:
    """(k, seq, ts_write, value): the store once the aborted transactions, and all that depend on them, are undone.

    Their writes count as never done; a later write of another transaction
    stands.  Keys without a write left have no row.  One row a task and key is
    shuffled."""
    v = cut(v)
    left = _valued(v, values).where("wrote").join(cascade(v), "ts", "left_anti")
    return left.groupBy("k").agg(F.max_by(F.struct("seq", F.col("ts").alias("ts_write"), "value"), "seq").alias("s")).select("k", "s.*")
