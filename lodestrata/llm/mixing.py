"""Mixing sources to target weights (operator 4), DataFrame functions only.

The words of a source, in order of a hash bucket and doc_id, are packed into
blocks of `block` words.  Every slot of the mix draws its source by the target
shares, so that the counts of an output shard are multinomial.  The k-th slot
of a source reads block perm(k mod n) of pass k div n, where perm is a keyed
bijection of that pass on the source's n block numbers (swap-or-not rounds).
A source's slots beyond its quota are left out and missing ones added in a
last shard, and its last block is cut, so that it meets its target.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
BLOCK = 256
SHARDS = 1024
BUCKETS = 1024
ROUNDS = 12
SEED = 20240501
#: Tell rows apart: kh hashes the row, dup numbers rows that are alike.
KEY = ("doc_id", "kh", "dup")
WORD = r"[^ \t-\r]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) of (source, source_size) rows, one a source.

    Weights repeat over the sources by code point, null last.  Resharing the
    excess by weight until none is above its limit ends at target =
    min(limit, level * weight) with one level for all, which is where the sum
    over the sources that reach the limit first leaves the right rest."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    below, above = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(above)
    t = t.withColumn("lv", level)
    # the first source, by limit a weight, whose limit isn't reached sets the level; after it lv only falls
    t = t.withColumn("level", F.max(F.when(F.col("lv") <= F.col("cap") / F.col("w"), F.col("lv"))).over(whole))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of 0 <= x < n."""

    def step(v, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(1)), n) - v, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(v, other), F.lit(2)), F.lit(2)) == 1, other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def _pieces(sized: DataFrame, block: int, buckets: int) -> DataFrame:
    """(s, block, key columns, at, take, first): take words of the row, from its word `first`, lie from word `at` of the block."""
    b = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(buckets)))
    base = b.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    base = base.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("s", "bucket").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    p = b.withColumn("before", F.sum("size").over(inner) - F.col("size")).join(base, ["s", "bucket"]).where("size > 0")
    p = p.select("s", *KEY, "size", (F.col("before") + F.col("base")).alias("lo"))
    p = p.select("*", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(lo + size - 1) div {block}"))).alias("block"))
    start = F.greatest(F.col("lo"), F.col("block") * block)
    return p.select("s", "block", *KEY, (start - F.col("block") * block).cast("int").alias("at"), (F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * block) - start).cast("int").alias("take"), (start - F.col("lo")).alias("first"))


def _slots(t: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """(s, block, pass, upto): the blocks that the mix reads, and how many words of each at most."""
    whole = Window.orderBy("s")
    q = t.where("source_size > 0").select("s", "source_size", F.round("target").cast("long").alias("goal"))
    q = q.withColumn("n", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("full", F.expr("goal div source_size"))
    q = q.withColumn("rest", F.col("goal") - F.col("full") * F.col("source_size"))
    q = q.withColumn("quota", F.col("full") * F.col("n") + F.expr(f"(rest + {block - 1}) div {block}"))
    total = q.agg(F.sum("quota")).first()[0] or 0
    q = q.withColumn("upto", F.sum("quota").over(whole)).withColumns({"hi": F.col("upto") / F.lit(float(max(total, 1))), "lo": (F.col("upto") - F.col("quota")) / F.lit(float(max(total, 1)))})
    spark = t.sparkSession
    # a slot draws u in [0, 1); sources meet it by the part of [0, 1) that u is in
    bins = 1024
    u = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    slot = spark.range(total).select("id", F.expr(f"id div {max(1, -(-total // shards))}").alias("shard"), u.alias("u")).withColumn("bin", F.floor(F.col("u") * bins))
    part = q.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))).alias("bin"))
    drawn = slot.join(part, "bin").where("u >= lo and u < hi").select("s", "shard", "id")
    counts = cut(drawn.groupBy("s", "shard").agg(F.count("*").alias("c")))
    before = counts.select("s", "shard", (F.sum("c").over(Window.partitionBy("s").orderBy("shard")) - F.col("c")).alias("k0"))
    k = drawn.withColumn("k", F.row_number().over(Window.partitionBy("s", "shard").orderBy("id")) - 1).join(before, ["s", "shard"]).select("s", (F.col("k") + F.col("k0")).alias("k"))
    short = q.join(counts.groupBy("s").agg(F.sum("c").alias("c")), "s", "left").withColumn("c", F.coalesce("c", F.lit(0))).where("c < quota").select("s", F.explode(F.sequence(F.col("c"), F.col("quota") - 1)).alias("k"))
    out = k.unionByName(short).join(q.select("s", "n", "quota", "full", "rest"), "s").where("k < quota")
    out = out.withColumn("pass", F.expr("k div n"))
    cut_at = F.when((F.col("pass") == F.col("full")) & (F.col("k") == F.col("quota") - 1), F.col("rest") - (F.pmod("k", "n")) * block).otherwise(F.lit(block))
    return out.select("s", permuted(F.pmod("k", "n"), F.col("n"), F.xxhash64("s", "pass", F.lit(seed))).alias("block"), F.col("pass").cast("int").alias("pass"), cut_at.cast("int").alias("upto"))


def _key(source: Column) -> Column:
    """A string that tells null from any text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.withColumn("kh", F.xxhash64("doc_id", "text", "source"))
    return d.withColumn("dup", F.row_number().over(Window.partitionBy("kh").orderBy("doc_id")))


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights=WEIGHTS, share: float = SHARE, most: int = MAX_PASSES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and what the mix takes of them.

    Returns (rows, taken): rows has KEY, source, size, source_size, target;
    taken has KEY, pass, first, words, one row for each stretch of words that
    the mix takes in a pass.  size counts runs of other than space and U+0009
    to U+000D; null and empty texts have 0 and are never taken; null is a
    source of its own; rows with equal doc_id count apart; an empty table
    gives empty tables; other columns are ignored.  Only ids, sizes and block
    numbers are shuffled."""
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("kh"))
    d = cut(d.withColumn("dup", F.row_number().over(Window.partitionBy("kh").orderBy("doc_id"))).withColumn("s", _key(F.col("source"))))
    t = cut(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("s", _key(F.col("source"))))
    small = t.drop("source")
    rows = d.join(F.broadcast(small) if t.count() <= 10_000 else small, "s")
    read = _pieces(d, block, BUCKETS).join(_slots(t, block, shards, seed), ["s", "block"]).withColumn("words", F.least("take", F.col("upto") - F.col("at"))).where("words > 0")
    return rows, read.select(*KEY, "pass", "first", "words")


def _other(df: DataFrame) -> DataFrame:
    """df with its key columns renamed, as the right side of _same."""
    return df.withColumnsRenamed({c: f"{c}_" for c in KEY})


def _same():
    return (F.col("kh") == F.col("kh_")) & (F.col("dup") - F.col("dup_") == 0) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of docs; see mix."""
    rows, taken = mix(docs, **options)
    n = taken.groupBy(*KEY).agg(F.sum("words").alias("taken"))
    return rows.join(_other(n), _same(), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each pass over a document.

    Its text holds the words taken in that pass, each with the white space
    after it (the whole text, if all are); n_chars, where docs has it, is
    counted anew.  Other columns pass through, whatever their names."""
    _, taken = mix(docs, **options)
    runs = taken.groupBy(*KEY, "pass").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"))
    # docs' columns are kept in a struct, so that none clashes with those of the join
    own = _keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"))
    words = F.regexp_extract_all("text", F.lit(f"{WORD}[ \\t-\\r]*"), F.lit(0))
    text = F.when(F.col("n") == n_words(F.col("text")), F.col("text")).otherwise(F.btrim(F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, (r["first"] + 1).cast("int"), r["words"].cast("int")))), ""), F.lit(SPACE)))
    out = own.join(_other(runs), _same()).select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
