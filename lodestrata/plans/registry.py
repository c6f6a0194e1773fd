"""Registered queries and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bits, hashing, hashstats, keysets
from ..operators import access, bloom, layout, merge, report, txn
from ..sources.views import SQL_LOG, SQL_ORDERS, SQL_TXN, kv_log, kv_orders, levels, table, txn_ops
from .util import ordered, scratch, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


LATEST = "SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY k) AS n FROM kv_log"


@query(f"WITH {SQL_LOG} SELECT k, seq, v, amount FROM ({LATEST}) WHERE rn = 1 AND NOT is_deleted")
def kv_live_view(spark, sf_dir) -> DataFrame:
    return merge.live_view(kv_log(spark, sf_dir)).select("k", "seq", "v", "amount")


@query(f"WITH {SQL_LOG} SELECT k, seq, is_deleted, v, n - 1 AS replaced FROM ({LATEST}) WHERE rn = 1")
def kv_upsert_latest(spark, sf_dir) -> DataFrame:
    return merge.upsert_latest(kv_log(spark, sf_dir)).select("k", "seq", "is_deleted", "v", "replaced")


def _runs(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    return [merge.upsert_latest(log.where(F.col("run") == r)).drop("replaced") for r in range(4)]


@query(f"WITH {SQL_LOG} SELECT k, run, seq, is_deleted, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run, seq DESC) AS rn FROM kv_log) WHERE rn = 1")
def kv_priority_merge(spark, sf_dir) -> DataFrame:
    return merge.priority_merge(_runs(spark, sf_dir)).select("k", "run", "seq", "is_deleted", "v")


@query(f"WITH {SQL_ORDERS} SELECT k, v, run FROM kv_orders")
def kv_merge_disjoint(spark, sf_dir) -> DataFrame:
    t = kv_orders(spark, sf_dir)
    return merge.priority_merge([t.where(F.col("run") == r) for r in range(4)]).select("k", "v", "run")


@query(f"""WITH {SQL_LOG}, lv AS (SELECT k, seq, v, is_deleted, CASE WHEN e >= 6 THEN 0 WHEN e >= 4 THEN 1 ELSE 2 END AS level, CASE WHEN e IN (4, 1, 0) THEN 1 ELSE 0 END AS tier, CASE WHEN e IN (3, 1) THEN 1 ELSE 0 END AS run FROM kv_log)
SELECT k, seq, v, level, tier, run FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, tier, run DESC, seq DESC) AS rn FROM lv) WHERE rn = 1 AND NOT is_deleted""")
def lsm_level_lookup(spark, sf_dir) -> DataFrame:
    return merge.level_lookup(levels(kv_log(spark, sf_dir))).where(~F.col("is_deleted")).select("k", "seq", "v", "level", "tier", "run")


@query(f"WITH {SQL_ORDERS} SELECT k, v, seq FROM kv_orders WHERE k = 'sample-key-42'")
def kv_point_get(spark, sf_dir) -> DataFrame:
    return access.point_get(kv_orders(spark, sf_dir), "sample-key-42").select("k", "v", "seq")


@query(f"WITH {SQL_ORDERS} SELECT k, v FROM kv_orders WHERE k IN (SELECT 'sample-key-' || l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def kv_multi_get(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("sample-key-"), "l_orderkey").alias("k"))
    return access.multi_get(kv_orders(spark, sf_dir), keys).select("k", "v")


@query(f"WITH {SQL_ORDERS} SELECT k, v FROM kv_orders WHERE k >= 'sample-key-2' AND k < 'sample-key-3'")
def kv_range_scan(spark, sf_dir) -> DataFrame:
    return access.range_scan(kv_orders(spark, sf_dir), "sample-key-2", "sample-key-3").select("k", "v")


@query(f"WITH {SQL_ORDERS} SELECT k, v FROM kv_orders WHERE k >= 'sample-key-500' AND EXISTS (SELECT 1 FROM kv_orders WHERE k = 'sample-key-500')")
def kv_seek_exact(spark, sf_dir) -> DataFrame:
    return access.seek_exact(kv_orders(spark, sf_dir), "sample-key-500").select("k", "v")


@query(f"WITH {SQL_ORDERS} SELECT k, v FROM kv_orders WHERE k >= 'sample-key-5x'")
def kv_seek_lower_bound(spark, sf_dir) -> DataFrame:
    return access.seek_lower_bound(kv_orders(spark, sf_dir), "sample-key-5x").select("k", "v")


@query(f"WITH {SQL_ORDERS} SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS pos FROM kv_orders")
def kv_full_scan(spark, sf_dir) -> DataFrame:
    return access.full_scan(kv_orders(spark, sf_dir)).select("k", "v", "pos")


@query("SELECT c_custkey, CASE WHEN encode(c_name) < encode('Customer#000000100') THEN -1 WHEN c_name = 'Customer#000000100' THEN 0 ELSE 1 END AS cmp, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS pos FROM customer")
def kv_byte_order(spark, sf_dir) -> DataFrame:
    name, to = F.encode("c_name", "UTF-8"), F.encode(F.lit("Customer#000000100"), "UTF-8")
    d = ordered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")
    return d.select("c_custkey", F.when(name < to, -1).when(name == to, 0).otherwise(1).alias("cmp"), "pos")


@query(f"WITH {SQL_LOG} SELECT seq, '''' || k || ''' -> ' || CASE WHEN is_deleted THEN 'removed' ELSE '''' || v || '''' END || CASE WHEN run = 0 THEN ' [cached]' ELSE '' END AS shown FROM kv_log")
def kv_format(spark, sf_dir) -> DataFrame:
    return kv_log(spark, sf_dir).select("seq", access.display(F.col("k"), F.col("v"), F.col("is_deleted"), F.col("run") == 0).alias("shown"))


RUN = f"{SQL_ORDERS}, r AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, lag(k) OVER (ORDER BY k) AS prev FROM kv_orders), s AS (SELECT *, pos % 51 = 0 OR pos = n - 1 AS restart FROM r)"
FRONT = f"{RUN}, f AS (SELECT *, CASE WHEN restart THEN 0 ELSE len(list_filter(range(1, least(length(k), length(prev)) + 1), lambda i: left(k, i) = left(prev, i))) END AS common_len FROM s)"


@query(f"WITH {RUN} SELECT k, pos FROM s WHERE restart")
def run_sparse_index(spark, sf_dir) -> DataFrame:
    return layout.restarts(kv_orders(spark, sf_dir)).where("restart").select("k", "pos")


@query(f"WITH {RUN}, p AS (SELECT DISTINCT 'sample-key-' || (event_id * 7) AS k FROM events) SELECT p.k, i.k AS index_key FROM p ASOF LEFT JOIN (SELECT k FROM s WHERE restart) i ON p.k >= i.k")
def run_index_lookup(spark, sf_dir) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(F.concat(F.lit("sample-key-"), F.col("event_id") * 7).alias("k")).distinct()
    return layout.index_lookup(probes, kv_orders(spark, sf_dir).select("k"))


@query(f"WITH {FRONT} SELECT k, pos, common_len FROM f")
def run_front_coding(spark, sf_dir) -> DataFrame:
    return layout.front_coding(kv_orders(spark, sf_dir)).select("k", "pos", "common_len")


@query(f"WITH {FRONT}, z AS (SELECT k, pos, 4 + length(k) - common_len + length(v) AS size FROM f) SELECT k, pos, size, coalesce(sum(size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM z")
def run_layout(spark, sf_dir) -> DataFrame:
    return layout.layout(kv_orders(spark, sf_dir)).select("k", "pos", "size", "offset")


@query("SELECT event_id, CASE WHEN x < 128 THEN 1 WHEN x < 4096 THEN 2 WHEN x < 1048576 THEN 3 WHEN x < 268435456 THEN 4 WHEN x < 68719476736 THEN 5 WHEN x < 17592186044416 THEN 6 ELSE 7 END AS n_bytes FROM (SELECT event_id, event_id * event_id * 37 AS x FROM events)")
def varint_len(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", layout.varint_len(F.col("event_id") * F.col("event_id") * 37).alias("n_bytes"))


@query("""SELECT event_id, CASE WHEN event_id < 128 THEN printf('%02x', event_id) WHEN event_id < 4096 THEN printf('%02x%02x', (event_id & 127) | 128, event_id >> 7)
 ELSE printf('%02x%02x%02x', (event_id & 127) | 128, 32 | ((event_id >> 7) & 31), event_id >> 12) END AS encoded, event_id AS decoded FROM events""")
def varint_roundtrip(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "events").select("event_id", layout.varint_hex(F.col("event_id")).alias("encoded"))
    return d.select("event_id", "encoded", layout.varint_value(F.col("encoded")).alias("decoded"))


@query(f"WITH {SQL_LOG} SELECT k, seq, is_deleted, v FROM ({LATEST}) WHERE rn = 1 AND run <> 0")
def run_flush(spark, sf_dir) -> DataFrame:
    d = merge.upsert_latest(kv_log(spark, sf_dir)).withColumn("cached", F.col("run") == 0).select("k", "seq", "is_deleted", "v", "cached")
    return layout.flush(d, scratch(spark, "run"))


@query(f"WITH {SQL_LOG} SELECT k, run, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run, seq DESC) AS rn FROM kv_log) WHERE rn = 1 AND NOT is_deleted")
def run_compact(spark, sf_dir) -> DataFrame:
    return layout.compact(_runs(spark, sf_dir), scratch(spark, "compact"), bottom=True).select("k", "run", "seq", "v")


def _flushed(spark, sf_dir):
    return layout.flush(kv_orders(spark, sf_dir).select("k", "v", "seq"), scratch(spark, "run"))


@query(f"WITH {SQL_ORDERS} SELECT k, v, seq FROM kv_orders WHERE k = 'sample-key-1000'")
def run_point_get(spark, sf_dir) -> DataFrame:
    """On a flushed run the key reaches the scan: its bloom filter and the row groups' bounds prune it."""
    return access.point_get(_flushed(spark, sf_dir), "sample-key-1000").select("k", "v", "seq")


@query(f"WITH {SQL_ORDERS} SELECT k, v FROM kv_orders WHERE k >= 'sample-key-2' AND k < 'sample-key-3'")
def run_range_scan(spark, sf_dir) -> DataFrame:
    return access.range_scan(_flushed(spark, sf_dir), "sample-key-2", "sample-key-3").select("k", "v")


@query(f"WITH {SQL_LOG} SELECT k, arg_max(v, seq) FILTER (v IS NOT NULL) AS v, max(CASE WHEN v = 'view' THEN seq ELSE 0 END) AS ts_read, max(CASE WHEN v <> 'view' THEN seq ELSE 0 END) AS ts_write FROM kv_log WHERE v IS NOT NULL GROUP BY k")
def kv_record_upsert(spark, sf_dir) -> DataFrame:
    d = kv_log(spark, sf_dir).where("v is not null").withColumns({"ts_read": F.when(F.col("v") == "view", F.col("seq")).otherwise(0), "ts_write": F.when(F.col("v") != "view", F.col("seq")).otherwise(0)})
    return merge.upsert_record(d, "v", ["ts_read", "ts_write"])


# values of all lengths from one to nine bytes, encoded
WIDTHS = """x AS (SELECT event_id, (1::BIGINT << (event_id % 63)::INT) + event_id AS x FROM events),
n AS (SELECT *, CASE WHEN x < 128 THEN 1 WHEN x < 4096 THEN 2 ELSE (2 + ceil((len(bin(x)) - 12) / 8.0))::INT END AS n FROM x),
e AS (SELECT event_id, x, n, CASE WHEN n = 1 THEN printf('%02x', x) ELSE printf('%02x%02x', (x & 127) | 128, ((n - 2) << 5) | ((x >> 7) & 31)) || coalesce(array_to_string([printf('%02x', (x >> (12 + 8 * i)::INT) & 255) FOR i IN range(n - 2)], ''), '') END AS encoded FROM n)"""


@query(f"WITH {WIDTHS} SELECT event_id, encoded, x AS decoded, CASE WHEN event_id % 10 >= n THEN x END AS checked FROM e")
def varint_wide(spark, sf_dir) -> DataFrame:
    """checked decodes the first event_id mod 10 bytes."""
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select(e, layout.varint_hex(bits.shl(F.lit(1).cast("long"), e % 63) + e).alias("encoded"))
    part = F.substring(F.col("encoded"), F.lit(1), (2 * (e % 10)).cast("int"))
    return d.select(e, "encoded", layout.varint_value(F.col("encoded")).alias("decoded"), layout.varint_checked(part).alias("checked"))


@query("SELECT event_id, array_to_string([printf('%02x', (x >> (8 * i)::INT) & 255) FOR i IN range(8)], '') AS encoded, x AS decoded FROM (SELECT event_id, event_id * event_id * event_id * 37 AS x FROM events)")
def u64_roundtrip(spark, sf_dir) -> DataFrame:
    """The words are products modulo 2^64: from event_id 629,000 or so they fit no long, and the SQL has no result."""
    e, square = F.col("event_id"), F.col("square")
    d = table(spark, sf_dir, "events").select(e, hashing.wrapping_multiply(e, e).alias("square"))
    d = d.select(e, hashing.wrapping_multiply(hashing.wrapping_multiply(square, e), 37).alias("x")).select(e, layout.u64_hex(F.col("x")).alias("encoded"))
    return d.select(e, "encoded", layout.u64_value(F.col("encoded")).alias("decoded"))


# layout with values of over 127 bytes, whose length takes two bytes
LONG_RUN = """b AS (SELECT 'sample-key-' || o_orderkey AS k, repeat(o_orderpriority, (o_orderkey % 40)::INT) AS v FROM orders),
r AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, lag(k) OVER (ORDER BY k) AS prev FROM b), s AS (SELECT *, pos % 51 = 0 OR pos = n - 1 AS restart FROM r),
f AS (SELECT *, CASE WHEN restart THEN 0 ELSE len(list_filter(range(1, least(length(k), length(prev)) + 1), lambda i: left(k, i) = left(prev, i))) END AS common_len FROM s)"""


@query(f"WITH {LONG_RUN} SELECT k, pos, 3 + CASE WHEN length(v) < 128 THEN 1 ELSE 2 END + length(k) - common_len + length(v) AS size FROM f")
def run_layout_long(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    run = o.select(F.concat(F.lit("sample-key-"), "o_orderkey").alias("k"), F.expr("repeat(o_orderpriority, cast(o_orderkey % 40 as int))").alias("v"))
    return layout.layout(run).select("k", "pos", "size")


# the word-mix hash of 'key-' and eight digits: one word and a tail of four bytes
W = 1 << 64
HASHED = f"""b AS (SELECT event_id, 'key-' || lpad(event_id::VARCHAR, 8, '0') AS k FROM events),
w AS (SELECT event_id, k, list_sum([ascii(substr(k, i + 1, 1))::UBIGINT << (8 * i)::UBIGINT FOR i IN range(8)])::UBIGINT AS w1, list_sum([ascii(substr(k, i + 9, 1))::UBIGINT << (8 * i)::UBIGINT FOR i IN range(4)])::UBIGINT AS w2 FROM b),
m1 AS (SELECT *, (((xor(w1, w1 >> 23))::UHUGEINT * {int(hashing.MIX)}) % {W})::UBIGINT AS a, (((xor(w2, w2 >> 23))::UHUGEINT * {int(hashing.MIX)}) % {W})::UBIGINT AS b FROM w),
m2 AS (SELECT event_id, k, xor(a, a >> 47) AS a, xor(b, b >> 47) AS b FROM m1),
s1 AS (SELECT event_id, k, b, ((xor(xor({int(hashing.SEED)}::UBIGINT, ((12::UHUGEINT * {int(hashing.SHIFT[0])}) % {W})::UBIGINT), a)::UHUGEINT * {int(hashing.SHIFT[0])}) % {W})::UBIGINT AS h FROM m2),
s2 AS (SELECT event_id, k, ((xor(h, b)::UHUGEINT * {int(hashing.SHIFT[3])}) % {W})::UBIGINT AS h FROM s1),
s3 AS (SELECT event_id, k, ((xor(h, h >> 23)::UHUGEINT * {int(hashing.MIX)}) % {W})::UBIGINT AS h FROM s2),
hashed AS (SELECT event_id, k, xor(h, h >> 47) AS h FROM s3)"""


def _event_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("k"))


@query(f"WITH {HASHED} SELECT event_id, lower(lpad(to_hex(h), 16, '0')) AS h FROM hashed")
def hash_wordmix64(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", F.lower(F.lpad(F.hex(hashing.REGISTRY["wordmix64"](F.col("k"))), 16, "0")).alias("h"))


@query(f"WITH {HASHED} SELECT event_id, (xor(h, h >> 32) & 4294967295)::BIGINT AS h FROM s2")
def hash_wordmix32(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", hashing.REGISTRY["wordmix32"](F.col("k")).alias("h"))


@query("SELECT event_id, (('0x' || substr(md5(k), 7, 2) || substr(md5(k), 5, 2) || substr(md5(k), 3, 2) || substr(md5(k), 1, 2))::BIGINT) AS md5_32, 0::BIGINT AS constant FROM (SELECT event_id, 'key-' || lpad(event_id::VARCHAR, 8, '0') AS k FROM events)")
def hash_registry(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", *[hashing.REGISTRY[n](F.col("k")).alias(n) for n in ("md5_32", "constant")])


FOLD = "list_reduce(list_prepend({start}::BIGINT, [ascii(substr(k, i, 1))::BIGINT FOR i IN range(1, length(k) + 1)]), lambda a, b: {step})"
OAAT = "((xor(a, b) * 1540483477) & 4294967295)"


@query(f"""SELECT event_id, {FOLD.format(start=2166136261, step="(xor(a, b) * 16777619) & 4294967295")} AS fnv, {FOLD.format(start=0, step="(a * 33 + b) & 4294967295")} AS bernstein,
 {FOLD.format(start=0, step=f"xor({OAAT}, {OAAT} >> 15)")} AS oaat, ('0x' || substr(sha1(k), 7, 2) || substr(sha1(k), 5, 2) || substr(sha1(k), 3, 2) || substr(sha1(k), 1, 2))::BIGINT AS sha1_32 FROM (SELECT event_id, 'key-' || lpad(event_id::VARCHAR, 8, '0') AS k FROM events)""")
def hash_bytewise(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", *[hashing.REGISTRY[n](F.col("k")).alias(n) for n in ("fnv", "bernstein", "oaat", "sha1_32")])


@query()
def hash_mixers(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", *[hashing.REGISTRY[n](F.col("k")).alias(n) for n in (*hashing.mixers.ALL, *hashing.longmixers.ALL, "crc32", "xxh64")])


@query()
def hash_mixers_wide(spark, sf_dir) -> DataFrame:
    return _event_keys(spark, sf_dir).select("event_id", *[hashing.wide(n)(F.col("k")).alias(n) for n in hashing.WIDE])


M32 = 0xFFFFFFFF


# the CRC takes a bit a step: a byte, then eight times -1
@query(f"""WITH b AS (SELECT event_id, [ascii(substr(k, i, 1))::UBIGINT FOR i IN range(1, 13)] AS b FROM (SELECT event_id, 'key-' || lpad(event_id::VARCHAR, 8, '0') AS k FROM events)),
w AS (SELECT event_id, flatten([[x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN b]) AS bits, [b[i + 1] + b[i + 2] * 256 + b[i + 3] * 65536 + b[i + 4] * 16777216 FOR i IN range(0, 12, 4)] AS w FROM b),
x AS (SELECT event_id, bits, [(xor(x, x >> 24) * 1540483477) & {M32} FOR x IN [(x * 1540483477) & {M32} FOR x IN w]] AS two,
 [((((x << 15) & {M32}) | (x >> 17)) * 461845907) & {M32} FOR x IN [(x * 3432918353) & {M32} FOR x IN w]] AS three FROM w),
h AS (SELECT event_id, bits, list_reduce(list_prepend(12::UBIGINT, two), lambda a, x: xor((a * 1540483477) & {M32}, x)) AS two,
 xor(list_reduce(list_prepend(0::UBIGINT, three), lambda a, x: ((((xor(a, x) << 13) & {M32}) | (xor(a, x) >> 19)) * 5 + 3864292196) & {M32}), 12::UBIGINT) AS three FROM x),
f AS (SELECT event_id, bits, (xor(two, two >> 13) * 1540483477) & {M32} AS two, (xor(three, three >> 16) * 2246822507) & {M32} AS three, ((xor(event_id, event_id >> 16))::UBIGINT * 2246822507) & {M32} AS own FROM h),
g AS (SELECT event_id, bits, xor(two, two >> 15) AS two, (xor(three, three >> 13) * 3266489909) & {M32} AS three, (xor(own, own >> 13) * 3266489909) & {M32} AS own FROM f)
SELECT event_id, two::BIGINT AS murmur2, xor(three, three >> 16)::BIGINT AS murmur3a, xor(own, own >> 16)::BIGINT AS fmix32,
 xor(list_reduce(list_prepend({M32}::BIGINT, bits), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), {M32}) AS crc32,
 xor(list_reduce(list_prepend(xor({M32}, 1234)::BIGINT, bits), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), {M32}) AS crc32_seeded FROM g""")
def hash_words(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return _event_keys(spark, sf_dir).select("event_id", hashing.REGISTRY["murmur2"](k).alias("murmur2"), hashing.REGISTRY["murmur3a"](k).alias("murmur3a"), hashing.finalised32(F.col("event_id")).alias("fmix32"),
                                             hashing.REGISTRY["crc32"](k).alias("crc32"), hashing.vectorised("crc32_seeded", 1234)(k).alias("crc32_seeded"))


# Murmur 3 in two 64-bit words, of the same keys: they are all tail
def _times(x: str, y: int) -> str:
    return f"((({x})::UHUGEINT * {y}) % {W})::UBIGINT"


def _turned(x: str, n: int) -> str:
    return f"({_times(x, 1 << n)} | (({x}) >> {64 - n}))"


def _plus(x: str, y: str) -> str:
    return f"((({x})::UHUGEINT + ({y})) % {W})::UBIGINT"


MURMUR = f"""a0 AS (SELECT event_id, {_times('w1', 0x87C37B91114253D5)} AS a, {_times('w2', 0x4CF5AD432745937F)} AS b FROM w),
a1 AS (SELECT event_id, {_turned('a', 31)} AS a, {_turned('b', 33)} AS b FROM a0),
a2 AS (SELECT event_id, xor({_times('a', 0x4CF5AD432745937F)}, 12::UBIGINT) AS a, xor({_times('b', 0x87C37B91114253D5)}, 12::UBIGINT) AS b FROM a1),
a3 AS (SELECT event_id, {_plus('a', 'b')} AS a, b FROM a2), a4 AS (SELECT event_id, a, {_plus('a', 'b')} AS b FROM a3),
a5 AS (SELECT event_id, {_times('xor(a, a >> 33)', 0xFF51AFD7ED558CCD)} AS a, {_times('xor(b, b >> 33)', 0xFF51AFD7ED558CCD)} AS b FROM a4),
a6 AS (SELECT event_id, {_times('xor(a, a >> 33)', 0xC4CEB9FE1A85EC53)} AS a, {_times('xor(b, b >> 33)', 0xC4CEB9FE1A85EC53)} AS b FROM a5),
a7 AS (SELECT event_id, xor(a, a >> 33) AS a, xor(b, b >> 33) AS b FROM a6), a8 AS (SELECT event_id, {_plus('a', 'b')} AS a, b FROM a7)"""


@query(f"WITH {HASHED}, {MURMUR} SELECT event_id, lower(lpad(to_hex(a), 16, '0') || lpad(to_hex({_plus('a', 'b')}), 16, '0')) AS h FROM a8")
def hash_murmur128(spark, sf_dir) -> DataFrame:
    d = _event_keys(spark, sf_dir).select("event_id", hashing.wide("murmur3f")(F.col("k")).alias("w"))
    return d.select("event_id", F.lower(F.concat(*[F.lpad(F.hex(F.col("w")[i]), 16, "0") for i in range(2)])).alias("h"))


@query(f"WITH {HASHED} SELECT event_id, (h & 16777215)::BIGINT AS p0, ((h >> 24) & 16777215)::BIGINT AS p1 FROM hashed")
def bloom_positions(spark, sf_dir) -> DataFrame:
    d = _event_keys(spark, sf_dir).withColumn("h", hashing.REGISTRY["wordmix64"](F.col("k")))
    p = bloom.positions(F.col("h"))
    return d.select("event_id", p[0].alias("p0"), p[1].alias("p1"))


BLOOM = f"""{SQL_ORDERS}, pos AS (SELECT k, unnest([('0x' || substr(md5(k), 7, 6))::BIGINT, ('0x' || substr(md5(k), 1, 6))::BIGINT]) AS p FROM kv_orders),
probe AS (SELECT event_id, 'sample-key-' || event_id AS k FROM events),
pp AS (SELECT event_id, k, ('0x' || substr(md5(k), 7, 6))::BIGINT IN (SELECT p FROM pos) AND ('0x' || substr(md5(k), 1, 6))::BIGINT IN (SELECT p FROM pos) AS hit FROM probe)"""


@query(f"WITH {BLOOM} SELECT p >> 3 AS byte, bit_or(1 << (p & 7)::INT) AS value FROM pos GROUP BY 1")
def bloom_build(spark, sf_dir) -> DataFrame:
    return bloom.build(kv_orders(spark, sf_dir), bloom.md5_hash(F.col("k")))


@query("""WITH p AS (SELECT unnest([('0x' || substr(md5(k), 9, 4))::BIGINT, ('0x' || substr(md5(k), 5, 4))::BIGINT]) AS p FROM (SELECT 'sample-key-' || o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0)),
b AS (SELECT p >> 3 AS byte, bit_or(1 << (p & 7)::INT) AS value FROM p GROUP BY 1)
SELECT count(*) AS size, md5(unhex(string_agg(printf('%02x', coalesce(value, 0)), '' ORDER BY i))) AS digest, count(value) AS used FROM range(8192) t(i) LEFT JOIN b ON b.byte = i""")
def bloom_packed(spark, sf_dir) -> DataFrame:
    """Of a filter of 2^16 bits in its serial form: bytes, digest and, read back, the bytes that aren't zero."""
    run = kv_orders(spark, sf_dir).where("run = 0")
    packed = bloom.pack(bloom.build(run, bloom.md5_hash(F.col("k")), 16), 16)
    used = bloom.unpack(packed).agg(F.count("*").alias("used"))
    return packed.select(F.octet_length("filter").cast("long").alias("size"), F.md5("filter").alias("digest")).crossJoin(used)


def _probed(spark, sf_dir):
    built = bloom.build(kv_orders(spark, sf_dir), bloom.md5_hash(F.col("k")))
    probes = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("sample-key-"), "event_id").alias("k"))
    return bloom.probe(probes, bloom.md5_hash(F.col("k")), built)


@query(f"WITH {BLOOM} SELECT event_id, k, hit FROM pp")
def bloom_probe(spark, sf_dir) -> DataFrame:
    return _probed(spark, sf_dir).select("event_id", "k", "hit")


@query(f"WITH {BLOOM} SELECT event_id % 10 AS batch, count(*) AS n, count(*) FILTER (hit AND k NOT IN (SELECT k FROM kv_orders)) AS false_positives, round(avg(CASE WHEN hit AND k NOT IN (SELECT k FROM kv_orders) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM pp GROUP BY 1")
def bloom_fp_rate(spark, sf_dir) -> DataFrame:
    d = _probed(spark, sf_dir).join(kv_orders(spark, sf_dir).select("k", F.lit(True).alias("there")), "k", "left")
    wrong = F.when(F.col("hit") & F.col("there").isNull(), 1).otherwise(0)
    return d.groupBy((F.col("event_id") % 10).alias("batch")).agg(F.count("*").alias("n"), F.sum(wrong).alias("false_positives"), F.round(F.avg(wrong), 6).alias("rate"))


VERDICTS = f"""{SQL_TXN}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM txn),
fold AS (SELECT k, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS ts, NULL::VARCHAR AS op, NULL::VARCHAR AS verdict, NULL::BIGINT AS dep, 0::BIGINT AS r, 0::BIGINT AS w FROM (SELECT DISTINCT k FROM txn)
 UNION ALL SELECT o.k, o.rn, o.seq, o.ts, o.op,
  CASE WHEN o.op = 'R' THEN CASE WHEN f.w > o.ts THEN 'abort' ELSE 'ok' END WHEN o.op = 'W' THEN CASE WHEN f.r > o.ts THEN 'abort' WHEN f.w > o.ts THEN 'skip' ELSE 'ok' END ELSE CASE WHEN f.r > o.ts OR f.w > o.ts THEN 'abort' ELSE 'ok' END END,
  CASE WHEN f.w NOT IN (0, o.ts) AND ((o.op = 'R' AND f.w <= o.ts) OR (o.op = 'RW' AND f.r <= o.ts AND f.w <= o.ts)) THEN f.w END,
  CASE WHEN o.op = 'R' AND f.w <= o.ts THEN greatest(f.r, o.ts) WHEN o.op = 'RW' AND f.r <= o.ts AND f.w <= o.ts THEN o.ts ELSE f.r END,
  CASE WHEN o.op = 'W' AND f.r <= o.ts AND f.w <= o.ts THEN o.ts WHEN o.op = 'RW' AND f.r <= o.ts AND f.w <= o.ts THEN o.ts ELSE f.w END
 FROM fold f JOIN o ON o.k = f.k AND o.rn = f.rn + 1),
v AS (SELECT seq, k, ts, op, verdict, dep, r AS ts_read, w AS ts_write FROM fold WHERE rn > 0)"""
R = f"WITH RECURSIVE {VERDICTS}"


def _verdicts(spark, sf_dir):
    return txn.verdicts(txn_ops(spark, sf_dir))


@query(f"{R} SELECT seq, k, ts, verdict, ts_read, ts_write FROM v WHERE op = 'R'")
def txn_read_check(spark, sf_dir) -> DataFrame:
    return _verdicts(spark, sf_dir).where("op = 'R'").select("seq", "k", "ts", "verdict", "ts_read", "ts_write")


@query(f"{R} SELECT seq, k, ts, verdict, ts_read, ts_write FROM v WHERE op = 'W'")
def txn_write_check(spark, sf_dir) -> DataFrame:
    return _verdicts(spark, sf_dir).where("op = 'W'").select("seq", "k", "ts", "verdict", "ts_read", "ts_write")


@query(f"{R} SELECT seq, k, ts, verdict, ts_read, ts_write FROM v WHERE op = 'RW'")
def txn_rw_check(spark, sf_dir) -> DataFrame:
    return _verdicts(spark, sf_dir).where("op = 'RW'").select("seq", "k", "ts", "verdict", "ts_read", "ts_write")


@query(f"{R} SELECT DISTINCT ts, dep FROM v WHERE dep IS NOT NULL")
def txn_deps(spark, sf_dir) -> DataFrame:
    return txn.dependencies(_verdicts(spark, sf_dir))


@query(f"{R} SELECT ts, CASE WHEN bool_or(verdict = 'abort') THEN 'aborted' ELSE 'committed' END AS status FROM v GROUP BY ts")
def txn_status(spark, sf_dir) -> DataFrame:
    return txn.status(_verdicts(spark, sf_dir))


@query(f"{R}, hit AS (SELECT DISTINCT ts FROM v WHERE verdict = 'abort' UNION SELECT v.ts FROM v JOIN hit ON v.dep = hit.ts) SELECT ts FROM hit")
def txn_cascade(spark, sf_dir) -> DataFrame:
    return txn.cascade(_verdicts(spark, sf_dir))


# what each accepted write puts: nothing (a tombstone) for errors
VALUED = """x AS (SELECT v.*, CASE WHEN e.event_type <> 'error' THEN e.event_type || '-' || v.seq END AS value, v.op IN ('W', 'RW') AND v.verdict = 'ok' AS wrote FROM v JOIN events e ON e.event_id = v.seq)"""


def _values(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(t != "error", F.concat(t, F.lit("-"), F.col("event_id"))).alias("value"))


@query(f"""{R}, {VALUED}, l AS (SELECT *, last_value(CASE WHEN wrote THEN seq END IGNORE NULLS) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM x)
SELECT l.seq, l.k, l.ts, l.writer, w.value FROM l LEFT JOIN x w ON w.seq = l.writer WHERE l.op IN ('R', 'RW') AND l.verdict = 'ok'""")
def txn_read_value(spark, sf_dir) -> DataFrame:
    return txn.read_values(_verdicts(spark, sf_dir), _values(spark, sf_dir))


@query(f"{R}, {VALUED} SELECT ts, seq, k, coalesce(lag(ts) OVER w, 0) AS old_ts_write, lag(value) OVER w AS old_value FROM x WHERE wrote WINDOW w AS (PARTITION BY k ORDER BY seq)")
def txn_undo_log(spark, sf_dir) -> DataFrame:
    return txn.undo_log(_verdicts(spark, sf_dir), _values(spark, sf_dir))


@query(f"""{R}, {VALUED}, hit AS (SELECT DISTINCT ts FROM v WHERE verdict = 'abort' UNION SELECT v.ts FROM v JOIN hit ON v.dep = hit.ts)
SELECT k, seq, ts AS ts_write, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM x WHERE wrote AND ts NOT IN (SELECT ts FROM hit)) WHERE rn = 1""")
def txn_rollback(spark, sf_dir) -> DataFrame:
    return txn.rolled_back(_verdicts(spark, sf_dir), _values(spark, sf_dir))


def md5_bits(c, size: int):
    """`size` (a multiple of 4, to 60) bits of md5 of a column's text."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, size // 4), 16, 10).cast("long")


def _text_hash(spark, sf_dir, size: int):
    return table(spark, sf_dir, "documents").select(F.col("text").alias("key"), md5_bits(F.col("text"), size).alias("h"))


@query("SELECT count(*) AS n, count(*) - count(DISTINCT substr(md5(text), 1, 4)) AS collisions, round(count(*) * (count(*) - 1)::DOUBLE / 131072, 6) AS expected, count(*) - count(DISTINCT substr(md5(text), 1, 4)) <= 2 * (count(*) * (count(*) - 1)::DOUBLE / 131072) AS ok FROM documents")
def hash_collisions(spark, sf_dir) -> DataFrame:
    return hashstats.collisions(_text_hash(spark, sf_dir, 16), bits=16)


@query("SELECT ('0x' || h)::BIGINT AS h, count(*) AS n, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT 'sample-key-' || o_orderkey AS key, substr(md5('sample-key-' || o_orderkey), 1, 4) AS h FROM orders) GROUP BY 1 HAVING count(*) > 1")
def hash_collision_map(spark, sf_dir) -> DataFrame:
    d = kv_orders(spark, sf_dir).select(F.col("k").alias("key"), md5_bits(F.col("k"), 16).alias("h"))
    return hashstats.collision_map(d, "key").withColumn("keys", F.array_join("keys", ","))


@query("SELECT h, n FROM (SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::BIGINT AS h, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY h LIMIT 20)")
def hash_first_collisions(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(md5_bits(F.col("o_orderkey"), 16).alias("h"))
    return hashstats.first_collisions(d, 20)


@query("""SELECT p_partkey, p_size, round(n * (n - 1) / 131072.0, 6) AS pairs, round(n - 256 + 256 * pow(1 - 1 / 256.0::DOUBLE, n), 6) AS occupancy,
 CASE WHEN p_size < 3 THEN 0 ELSE (p_size::BIGINT * (p_size - 1) * (p_size - 2)) // 6 END AS triples FROM (SELECT p_partkey, p_size, p_partkey::DOUBLE AS n FROM part)""")
def hash_expected(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round(n * (n - 1) / 131072.0, 6).alias("pairs"), F.round(hashstats.occupancy_collisions(n, F.lit(256.0)), 6).alias("occupancy"), hashstats.choose(F.col("p_size"), F.lit(3)).alias("triples"))


DIST = """h AS (SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT AS h FROM orders),
b AS (SELECT s AS start, (((h >> s) | ((h & ((1::BIGINT << s) - 1)) << (32 - s))) & 255) AS bin, count(*)::DOUBLE AS b FROM h, range(32) t(s) GROUP BY 1, 2),
w AS (SELECT start::INT AS start, 8 AS width, round(1 - ((sum(b) * sum(b) - 1) / nullif(sum(b * b) - sum(b), 0)) / 256, 6) AS score FROM b GROUP BY start)"""


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(md5_bits(F.col("o_orderkey"), 32).alias("h"))
    return hashstats.window_scores(d, 8).withColumn("score", F.round("score", 6))


@query(f"WITH {DIST} SELECT * FROM w")
def hash_distribution(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir)


# scores of all windows of the widths that leave five keys a bin
WIDE = """m AS (SELECT count(*) AS n, least(20, floor(log2(count(*) / 5.0))::INT) AS most FROM {table}),
h AS (SELECT ('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT AS h FROM {table}),
c AS (SELECT s AS start, width, (((h >> s) | ((h & ((1::BIGINT << s) - 1)) << (32 - s))) & ((1::BIGINT << width) - 1)) AS bin, count(*)::DOUBLE AS b FROM h, range(32) t(s), (SELECT unnest(range(8, most + 1)) AS width FROM m) GROUP BY 1, 2, 3),
w AS (SELECT start::INT AS start, width::INT AS width, 1 - ((sum(b) * sum(b) - 1) / nullif(sum(b * b) - sum(b), 0)) / pow(2.0, width) AS score FROM c GROUP BY start, width)"""
ORDERS = WIDE.format(table="orders", key="o_orderkey")
WORST = "SELECT start, width, round(score, 6) AS score, score >= 0.01 AS biased FROM w ORDER BY w.score DESC, start, width LIMIT 1"


def _order_hashes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(md5_bits(F.col("o_orderkey"), 32).alias("h"))


@query(f"WITH {ORDERS} {WORST}")
def hash_worst_window(spark, sf_dir) -> DataFrame:
    return hashstats.worst_over_widths(_order_hashes(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {ORDERS} SELECT start::INT AS start, width::INT AS width, bin, b FROM c WHERE start = 0")
def hash_fold(spark, sf_dir) -> DataFrame:
    d = _order_hashes(spark, sf_dir)
    w = max(8, hashstats.widest(d.count()))
    return hashstats.folded(hashstats.window_counts(d, w, [0]), w).select("start", "width", "bin", "b")


@query(f"""WITH h AS (SELECT ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT AS h FROM orders),
c AS (SELECT s, ((h >> s) | ((h & ((1::BIGINT << s) - 1)) << (32 - s))) & 65535 AS bin, count(*)::DOUBLE AS b FROM h, range(0, 32, 8) t(s) GROUP BY 1, 2),
w AS (SELECT 1 - ((sum(b) * sum(b) - 1) / nullif(sum(b * b) - sum(b), 0)) / 65536 AS score FROM c GROUP BY s)
SELECT round(max(score), 6) AS worst, round(avg(score), 6) AS mean FROM w""")
def hash_distribution_fast(spark, sf_dir) -> DataFrame:
    return hashstats.fast_scores(_order_hashes(spark, sf_dir)).select(F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))


TURN = "((h >> {s}) | ((h & ((1::BIGINT << {s}) - 1)) << (32 - {s})))"


@query(f"""WITH h AS (SELECT ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT AS h FROM customer),
c AS (SELECT a, b, ({TURN.format(s='a')} & 255) | (({TURN.format(s='b')} & 255) << 8) AS bin, count(*)::DOUBLE AS n FROM h, range(32) t(a), range(32) u(b) WHERE a <= b GROUP BY 1, 2, 3)
SELECT a::INT AS a, b::INT AS b, round(1 - ((sum(n) * sum(n) - 1) / nullif(sum(n * n) - sum(n), 0)) / 65536, 6) AS score FROM c GROUP BY 1, 2""")
def hash_bytepair(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(md5_bits(F.col("c_custkey"), 32).alias("h"))
    return hashstats.byte_pairs(d).withColumn("score", F.round("score", 6))


@query(f"""WITH h AS (SELECT i::INT AS in_bit, xor(('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT, ('0x' || substr(md5(xor(c_custkey, 1::BIGINT << i)::VARCHAR), 1, 8))::BIGINT) AS h FROM customer, range(20) t(i)),
c AS (SELECT in_bit, s, {TURN.format(s='s')} & 255 AS bin, count(*)::DOUBLE AS b FROM h, range(32) t(s) GROUP BY 1, 2, 3),
w AS (SELECT in_bit, 1 - ((sum(b) * sum(b) - 1) / nullif(sum(b * b) - sum(b), 0)) / 256 AS score FROM c GROUP BY in_bit, s),
n AS (SELECT in_bit, count(*) AS n, count(*) - count(DISTINCT h) AS collisions FROM h GROUP BY 1)
SELECT n.in_bit, n, collisions, round(max(score), 6) AS worst FROM n JOIN w USING (in_bit) GROUP BY ALL""")
def hash_diff_distribution(spark, sf_dir) -> DataFrame:
    return hashstats.differential_scores(table(spark, sf_dir, "customer"), "c_custkey", lambda c: md5_bits(c, 32), 20).withColumn("worst", F.round("worst", 6))


@query(f"""WITH {ORDERS}, k AS (SELECT count(*) AS n, count(*) - count(DISTINCT h) AS collisions, count(*) * (count(*) - 1)::DOUBLE / 8589934592 AS expected FROM h)
SELECT n, collisions, round(expected, 6) AS expected, collisions <= 2 * expected AS ok, start, width, score, biased FROM k, ({WORST})""")
def hash_key_list(spark, sf_dir) -> DataFrame:
    return hashstats.key_list(table(spark, sf_dir, "orders"), lambda c: md5_bits(c, 32), "o_orderkey").withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey, p_size, k::INT AS k, (list_reduce(list_prepend(1::BIGINT, range(1, k + 1)), lambda a, i: a * (p_size - k + i) // i))::BIGINT AS chosen,
 list_sum([(list_reduce(list_prepend(1::BIGINT, range(1, j + 1)), lambda a, i: a * (p_size - j + i) // i))::BIGINT FOR j IN range(1, k + 1)])::BIGINT AS up_to
 FROM (SELECT p_partkey, p_size, least(p_size, 1 + p_partkey % 6) AS k FROM part WHERE p_size >= 1)""")
def hash_choose(spark, sf_dir) -> DataFrame:
    k = F.least(F.col("p_size"), (1 + F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").where("p_size >= 1").select("p_partkey", "p_size", k.alias("k"), hashstats.choose(F.col("p_size"), k).alias("chosen"), hashstats.choose_up_to(F.col("p_size"), k).alias("up_to"))


@query("SELECT count(*) AS n, bit_xor(('0x' || substr(md5(text), 1, 8))::BIGINT) AS \"xor\", bit_or(('0x' || substr(md5(text), 1, 8))::BIGINT) AS \"any\" FROM documents")
def hash_checksum(spark, sf_dir) -> DataFrame:
    return hashstats.checksum(_text_hash(spark, sf_dir, 32))


FLIP = """x AS (SELECT i::INT AS in_bit, xor(('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT, ('0x' || substr(md5(xor(event_id, 1::BIGINT << i)::VARCHAR), 1, 8))::BIGINT) AS x FROM events, range({n}) t(i))"""


@query(f"WITH {FLIP.format(n=20)} SELECT in_bit, j::INT AS out_bit, sum((x >> j) & 1)::BIGINT AS flips, round(abs(2 * sum((x >> j) & 1)::DOUBLE / count(*) - 1), 6) AS bias FROM x, range(32) t(j) GROUP BY 1, 2")
def hash_avalanche(spark, sf_dir) -> DataFrame:
    return hashstats.avalanche(table(spark, sf_dir, "events"), "event_id", lambda c: md5_bits(c, 32), 20, 32)


@query(f"""WITH {FLIP.format(n=8)} SELECT in_bit, a::INT AS out1, b::INT AS out2, count(*) FILTER ((x >> a) & 1 = 0 AND (x >> b) & 1 = 0) AS n00, count(*) FILTER ((x >> a) & 1 = 0 AND (x >> b) & 1 = 1) AS n01,
 count(*) FILTER ((x >> a) & 1 = 1 AND (x >> b) & 1 = 0) AS n10, count(*) FILTER ((x >> a) & 1 = 1 AND (x >> b) & 1 = 1) AS n11 FROM x, range(8) t(a), range(8) u(b) WHERE a < b GROUP BY 1, 2, 3""")
def hash_bic(spark, sf_dir) -> DataFrame:
    return hashstats.independence(table(spark, sf_dir, "events"), "event_id", lambda c: md5_bits(c, 32), 8, 8)


@query("""SELECT d AS delta, count(*) AS n FROM events, (SELECT (1::BIGINT << i) + CASE WHEN j < i THEN 1::BIGINT << j ELSE 0 END AS d FROM range(12) t(i), range(12) u(j) WHERE j <= i)
 WHERE substr(md5(event_id::VARCHAR), 1, 2) = substr(md5(xor(event_id, d)::VARCHAR), 1, 2) GROUP BY 1 HAVING count(*) > 1""")
def hash_differential(spark, sf_dir) -> DataFrame:
    deltas = [(1 << i) + (1 << j if j < i else 0) for i in range(12) for j in range(i + 1)]
    return hashstats.differential(table(spark, sf_dir, "events"), "event_id", lambda c: md5_bits(c, 8), deltas)


@query("SELECT 1 AS n_blocks, printf('%08X', a) AS key FROM range(4) t(a) UNION ALL SELECT 2, printf('%08X%08X', a, b) FROM range(4) t(a), range(4) u(b) UNION ALL SELECT 3, printf('%08X%08X%08X', a, b, c) FROM range(4) t(a), range(4) u(b), range(4) w(c)")
def keyset_combination(spark, sf_dir) -> DataFrame:
    return keysets.combination(spark, [0, 1, 2, 3], 3)


@query("SELECT concat(a, b, c, d, e) AS key FROM range(5) t(a), range(5) u(b), range(5) v(c), range(5) w(d), range(5) x(e) WHERE len(list_distinct([a, b, c, d, e])) = 5")
def keyset_permutation(spark, sf_dir) -> DataFrame:
    return keysets.permutation(spark, 5)


@query("SELECT i AS key FROM range(1 << 16) t(i) WHERE bit_count(i) <= 3")
def keyset_sparse(spark, sf_dir) -> DataFrame:
    return keysets.sparse(spark, 16, 3)


@query("SELECT s::INT AS start, ((i << s) & 1048575) | (i >> (20 - s)) AS key FROM range(1 << 10) t(i), range(20) u(s)")
def keyset_window(spark, sf_dir) -> DataFrame:
    return keysets.window(spark, 20, 10)


@query("SELECT i AS id, repeat(substr(md5(i::VARCHAR), 1, 8), 8) AS key FROM range(10000) t(i)")
def keyset_cyclic(spark, sf_dir) -> DataFrame:
    return keysets.cyclic(spark, 10000)


@query("""SELECT size::INT AS size, i::INT AS i, a::INT AS a, 0 AS j, 0 AS b FROM range(2, 4) s(size), range(3) t(i), range(1, 256) u(a) WHERE i < size
 UNION ALL SELECT size::INT, i::INT, a::INT, j::INT, b::INT FROM range(2, 4) s(size), range(3) t(i), range(1, 256) u(a), range(3) v(j), range(1, 256) w(b) WHERE i < j AND j < size""")
def keyset_twobytes(spark, sf_dir) -> DataFrame:
    return keysets.two_bytes(spark, 3)


@query("SELECT concat('Foo', substr('abcdefghij', a::INT + 1, 1), substr('abcdefghij', b::INT + 1, 1), substr('abcdefghij', c::INT + 1, 1), 'Bar') AS key FROM range(10) t(a), range(10) u(b), range(10) v(c)")
def keyset_text(spark, sf_dir) -> DataFrame:
    return keysets.text(spark, "abcdefghij", 3, "Foo", "Bar")


@query("SELECT i AS size, md5(repeat(chr(0), i::INT)) AS h FROM range(1024) t(i)")
def keyset_zeroes(spark, sf_dir) -> DataFrame:
    return keysets.zeroes(spark, 1024).select("size", F.md5("key").alias("h"))


@query("SELECT i AS seed, 'sample-key' AS key FROM range(100000) t(i)")
def keyset_seed(spark, sf_dir) -> DataFrame:
    return keysets.seeds(spark, 100000, "sample-key")


@query("""SELECT event_id, bit_count(event_id)::INT AS ones, bit_count(event_id)::INT % 2 AS parity, (event_id >> 3) & 1 AS bit3, event_id | 32 AS set5, event_id & ~4::BIGINT AS clear2, xor(event_id, 128) AS flip7, event_id << 3 AS up3, event_id >> 2 AS down2,
 ((event_id << 13) | (event_id >> 19)) & 4294967295 AS left13, ((event_id >> 7) | (event_id << 25)) & 4294967295 AS right7, (((event_id >> 4) | (event_id << 28)) & 4294967295) & 63 AS window4, to_hex(event_id) AS hex FROM events""")
def bit_ops(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e, F.bit_count(e).alias("ones"), bits.parity(e).alias("parity"), bits.get_bit(e, 3).alias("bit3"), bits.set_bit(e, 5).alias("set5"), bits.clear_bit(e, 2).alias("clear2"), bits.flip_bit(e, 7).alias("flip7"), F.shiftleft(e, 3).alias("up3"), F.shiftrightunsigned(e, 2).alias("down2"), bits.rotate_left32(e, 13).alias("left13"), bits.rotate_right32(e, 7).alias("right7"), bits.window32(e, 4, 6).alias("window4"), F.hex(e).alias("hex"))


PACKED = "array_to_string([printf('%02X', list_sum([b[8 * j + i + 1] << i FOR i IN range(8)])::INT) FOR j IN range(16)], '')"


def _packed(bit: str) -> str:
    """The hex of 128 bits, each an expression in i."""
    return f"(SELECT {PACKED} FROM (SELECT [({bit}) FOR i IN range(128)] AS b))"


@query(f"""WITH k AS (SELECT c_custkey, (c_custkey * 7 % 131)::INT AS n, md5(c_custkey::VARCHAR) AS key FROM customer),
v AS (SELECT *, flatten([[(('0x' || substr(key, 2 * j + 1, 2))::INT >> i) & 1 FOR i IN range(8)] FOR j IN range(16)]) AS v FROM k)
SELECT c_custkey, n, {_packed("CASE WHEN i >= n THEN v[i - n + 1] ELSE 0 END")} AS up, {_packed("CASE WHEN i + n < 128 THEN v[i + n + 1] ELSE 0 END")} AS down,
 {_packed("v[(i - n + 256) % 128 + 1]")} AS turned_up, {_packed("v[(i + n) % 128 + 1]")} AS turned_down,
 {_packed("CASE WHEN i = n THEN 1 ELSE v[i + 1] END")} AS with_set, {_packed("CASE WHEN i = n THEN 0 ELSE v[i + 1] END")} AS with_clear, {_packed("CASE WHEN i = n THEN 1 - v[i + 1] ELSE v[i + 1] END")} AS with_flip,
 list_sum([v[(n + i) % 128 + 1]::BIGINT << i FOR i IN range(20)])::BIGINT AS window20, CASE WHEN n < 128 THEN v[n + 1] ELSE 0 END AS bit, v[n % 128 + 1] AS bit_wrapped FROM v""")
def bit_blobs(spark, sf_dir) -> DataFrame:
    b, n = F.unhex(F.md5(F.col("c_custkey").cast("string"))), (F.col("c_custkey") * 7 % 131).cast("int")
    moved = {"up": bits.shift_left, "down": bits.shift_right, "turned_up": bits.rotate_left, "turned_down": bits.rotate_right, "with_set": bits.set_bit_at, "with_clear": bits.clear_bit_at, "with_flip": bits.flip_bit_at}
    d = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", n.alias("n"), b.alias("b"))
    b, n = F.col("b"), F.col("n")
    return d.select("c_custkey", "n", *[F.hex(f(b, n)).alias(name) for name, f in moved.items()], bits.window(b, n, 20).alias("window20"), bits.bit_at(b, n).alias("bit"), bits.bit_at(b, n, wrap=True).alias("bit_wrapped"))


@query("SELECT 'rate-' || event_type AS title, (user_id % 20)::DOUBLE AS x, round(count(*) / sum(value), 6) AS y FROM events WHERE event_type NOT IN ('view', 'error') GROUP BY 1, 2")
def bench_series(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("rate-"), "event_type").alias("t"), (F.col("user_id") % 20).alias("b")).agg(report.throughput(F.count("*"), F.sum("value")).alias("y"))
    path = scratch(spark, "series")
    report.save_series(report.keep_titles(report.series(p, "t", "b", "y"), "rate-", ["click", "purchase", "signup"]), path)
    return report.load_series(spark, path).withColumn("y", F.round("y", 6))


@query("""WITH RECURSIVE o AS (SELECT value, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING)),
f AS (SELECT 1073741824::BIGINT AS x, 0::BIGINT AS size UNION ALL SELECT f.x >> 1, CASE WHEN o.rn < o.n AND o.value <= o.a + 3 * o.s THEN f.size | f.x ELSE f.size END FROM f LEFT JOIN o ON o.rn = (f.size | f.x) WHERE f.x > 0)
SELECT count(*) AS kept, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, max(value) AS most FROM o WHERE rn <= (SELECT max(size) FROM f WHERE x = 0)""")
def bench_outliers(spark, sf_dir) -> DataFrame:
    d = report.trim_outliers(table(spark, sf_dir, "events"), "value")
    return d.agg(F.count("*").alias("kept"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.max("value").alias("most"))


ROUNDS = "".join(f", r{i} AS (SELECT value FROM r{i - 1}, (SELECT avg(value) AS a, stddev_pop(value) AS s FROM r{i - 1}) WHERE abs(value - a) <= 3 * s)" for i in range(1, 11))


@query(f"WITH r0 AS (SELECT value FROM events WHERE value IS NOT NULL){ROUNDS} SELECT count(*) AS kept, round(min(value), 6) AS least, round(max(value), 6) AS most FROM r10")
def bench_outliers_both(spark, sf_dir) -> DataFrame:
    return report.trim_both(table(spark, sf_dir, "events"), "value").agg(F.count("*").alias("kept"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query("WITH RECURSIVE c AS (SELECT 1::BIGINT AS id, 1::BIGINT AS value UNION ALL SELECT id + 1, (value * 3 + 1) % 921544879 FROM c WHERE id < 5000) SELECT id, value FROM c")
def keyset_recurrence(spark, sf_dir) -> DataFrame:
    return keysets.recurrence(spark, 5000, 921544879)


@query(f"""WITH RECURSIVE g AS (SELECT c_custkey AS seed, 0 AS i, xor(c_custkey, 1233861573) & {M32} AS x, 0::BIGINT AS y, 0::BIGINT AS z, 0::BIGINT AS w FROM customer
 UNION ALL SELECT seed, i + 1, y, z, w, xor(xor(w, w >> 19), xor(xor(x, (x << 11) & {M32}), xor(x, (x << 11) & {M32}) >> 8)) FROM g WHERE i < 14) SELECT seed, i - 11 AS i, x AS word FROM g WHERE i > 10""")
def keyset_xorshift(spark, sf_dir) -> DataFrame:
    seed = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(seed.alias("seed"), F.posexplode(keysets.random_words(seed, 4)).alias("i", "word"))


HEADERS = """h AS (SELECT event_id, list_extract(['feat', 'fix', 'docs', 'nope', 'merge'], (1 + event_id % 5)::INT) || '(' || list_extract(['*', 'sstable', 'other'], (1 + event_id % 3)::INT) || ')' || list_extract(['', '!'], (1 + event_id % 2)::INT) || ': '
 || list_extract(['add a key', 'Add a key', 'add  a key', 'add a key.', 'add é', ''], (1 + event_id % 7 % 6)::INT) AS header FROM events)"""
SCOPES = ("*", "sstable")


@query(f"""WITH {HEADERS}, p AS (SELECT *, regexp_extract(header, '^([a-z]+)\\((.*?)\\)([!]?): (.*)$', ['a', 'b', 'c', 'd']) AS g FROM h),
r AS (SELECT *, regexp_replace(g.d, '[^\\x{{00}}-\\x{{FF}}]', '', 'g') AS d FROM p)
SELECT event_id, header, g.a IN ('feat', 'fix', 'docs', 'style', 'refactor', 'perf', 'test', 'build', 'ci', 'chore', 'merge', 'revert') AND g.b IN ('*', 'sstable') AND length(g.d) > 0
 AND regexp_replace(regexp_replace(trim(lower(d[1]) || d[2:]), '[ \\t\\r\\n]+', ' ', 'g'), '[^a-zA-Z0-9]+$', '') = g.d AS ok FROM r""")
def text_header_ok(spark, sf_dir) -> DataFrame:
    e, pick = F.col("event_id"), lambda words, i: F.element_at(F.array(*map(F.lit, words)), (1 + i).cast("int"))
    header = F.concat(pick(["feat", "fix", "docs", "nope", "merge"], e % 5), F.lit("("), pick(["*", "sstable", "other"], e % 3), F.lit(")"), pick(["", "!"], e % 2), F.lit(": "), pick(["add a key", "Add a key", "add  a key", "add a key.", "add é", ""], e % 7 % 6))
    return table(spark, sf_dir, "events").select(e, header.alias("header"), report.header_ok(header, SCOPES).alias("ok"))


@query("SELECT event_id, (event_id * 921544879) % (SELECT count(*) FROM events) AS target FROM events")
def bench_access_pattern(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id")
    return keysets.strided(ev, "event_id", 921544879, ev.count())


@query(r"""SELECT conv_id, turn, len(ls) - 1 AS n_body, regexp_full_match(ls[1], '([a-z]+)\((.*?)\)([!]?): (.*?)') AS header_shape,
 len(list_filter(ls[2:], lambda x: regexp_matches(x, '[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}]$') OR length(x) > 80 OR regexp_matches(x, '[^\x{00}-\x{FF}]|\t'))) = 0 AND NOT contains(array_to_string(ls[2:], chr(10)), chr(10) || chr(10) || chr(10)) AND NOT ends_with(array_to_string(ls[2:], chr(10)), chr(10)) AS body_ok,
 regexp_full_match(role, '[0-9a-z]+(-[0-9a-z]+)*') AS branch_ok FROM (SELECT *, string_split(text, chr(10)) AS ls FROM conversations)""")
def text_header_lint(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.size(F.split(t, "\n")) - 1).alias("n_body"), F.element_at(F.split(t, "\n"), 1).rlike(report.HEADER).alias("header_shape"), report.body_ok(t).alias("body_ok"), report.branch_ok(F.col("role")).alias("branch_ok"))
