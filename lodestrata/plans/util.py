"""Materialisation and ordered positions."""
from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the context's, or else spark.checkpoint.dir.

    Only a local master may go without, as its executors are on this machine:
    it gets a folder in its warehouse, which is deleted at exit."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}/.checkpoints-{uuid.uuid4().hex}"
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """df dealt to at least two tasks a core and one per so many rows, for work that costs more than its input's bytes tell."""
    tasks = 2 * max(16, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(tasks, -(-df.count() // rows)))


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """df with `part` and the 0-based position `pos` in the order of keys.

    Rows are range-partitioned and sorted, so no task holds a whole table; the
    offsets of the partitions are the only thing computed in one place."""
    d = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_id", F.monotonically_increasing_id())
    d = d.withColumn("part", F.shiftright("_id", 33))
    n = d.groupBy("part").agg(F.count("*").alias("_n"))
    n = n.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    return d.join(F.broadcast(n), "part").withColumn("pos", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_base")


def carried(d: DataFrame, value, name: str, fold=F.max) -> DataFrame:
    """Adds `name`: the fold of `value` over all rows before this one, in the order of ordered().

    Within a partition it is a running window; what earlier partitions hold is
    one value each."""
    w = Window.partitionBy("part").orderBy("pos")
    v = d.withColumn("_v", value)
    per = v.groupBy("part").agg(fold("_v").alias("_p"))
    per = per.select("part", fold("_p").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = v.join(F.broadcast(per), "part").withColumn("_own", fold("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    joined = F.coalesce(F.col("_own"), F.col("_before")) if fold is F.max else F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return both.withColumn(name, joined).drop("_v", "_before", "_own")
