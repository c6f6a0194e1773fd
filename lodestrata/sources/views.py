"""Key-value views over the star-schema tables, as DataFrames and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_orders(spark, sf_dir) -> DataFrame:
    """Unique keys without tombstones, in four disjoint runs."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("sample-key-"), "o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("seq"), F.pmod("o_orderkey", F.lit(4)).alias("run"))


def kv_log(spark, sf_dir) -> DataFrame:
    """Versioned log with tombstones; run 0 to 3 overlap, e is the version's age eighth (7: newest)."""
    ev = table(spark, sf_dir, "events")
    n = max(1, ev.count())
    gone = F.col("event_type") == "error"
    return ev.select(
        F.concat(F.lit("user-"), "user_id", F.lit("-"), F.col("event_id") % 20).alias("k"), F.col("event_id").alias("seq"), gone.alias("is_deleted"), F.when(~gone, F.col("event_type")).alias("v"), F.col("value").alias("amount"),
        F.expr("(event_id div 20) % 4").alias("run"), F.expr(f"(8 * event_id) div {n}").alias("e"))


def levels(log: DataFrame) -> DataFrame:
    """kv_log with the level, tier and run (in its tier) that each version's age puts it in."""
    e = F.col("e")
    return log.drop("run").withColumns({
        "level": F.when(e >= 6, 0).when(e >= 4, 1).otherwise(2), "tier": F.when(e == 4, 1).when(e <= 1, 1).otherwise(0), "run": F.when(e.isin(3, 1), 1).otherwise(0)})


def txn_ops(spark, sf_dir) -> DataFrame:
    """Operation log of transactions (ts) on keys: R, W, RW in the order of seq."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("k"), F.col("user_id") % 50).alias("k"), (F.col("event_id") + (F.col("event_id") * 7919) % 97).alias("ts"),
        F.when(kind.isin("view", "signup"), "R").when(kind.isin("click", "error"), "W").otherwise("RW").alias("op"))


SQL_ORDERS = "kv_orders AS (SELECT 'sample-key-' || o_orderkey AS k, o_orderpriority AS v, o_orderkey AS seq, o_orderkey % 4 AS run FROM orders)"
SQL_LOG = """kv_log AS (SELECT 'user-' || user_id || '-' || (event_id % 20) AS k, event_id AS seq, event_type = 'error' AS is_deleted,
  CASE WHEN event_type <> 'error' THEN event_type END AS v, value AS amount, (event_id // 20) % 4 AS run, 8 * event_id // (SELECT count(*) FROM events) AS e FROM events)"""
SQL_TXN = """txn AS (SELECT event_id AS seq, 'k' || (user_id % 50) AS k, event_id + (event_id * 7919) % 97 AS ts,
  CASE WHEN event_type IN ('view', 'signup') THEN 'R' WHEN event_type IN ('click', 'error') THEN 'W' ELSE 'RW' END AS op FROM events)"""
