"""Streaming forms: newest-wins upserts and transaction verdicts over a log."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.txn import KeyState


def upsert_stream(log: DataFrame, key: str = "k", order: str = "seq") -> DataFrame:
    """The latest version per key, for the update or complete output mode; the state is one row a key."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s"), (F.count("*") - 1).alias("replaced")).select(key, "s.*", "replaced")


def verdict_stream(ops: DataFrame) -> DataFrame:
    """Verdicts of operations in their order of arrival (by seq within a batch); the state is a key's two timestamps."""

    def fold(key, batches, state: GroupState):
        s = KeyState(*(state.get if state.exists else (0, 0)))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(int(q), key[0], int(ts), op, s.apply(op, int(ts))[0]) for q, ts, op in zip(rows.seq, rows.ts, rows.op)]
        state.update((s.ts_read, s.ts_write))
        yield pd.DataFrame(out, columns=["seq", "k", "ts", "op", "verdict"])

    return ops.groupBy("k").applyInPandasWithState(fold, "seq long, k string, ts long, op string, verdict string", "ts_read long, ts_write long", "append", GroupStateTimeout.NoTimeout)
