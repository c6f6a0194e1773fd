import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import bits, hashing, hashstats, keysets, longmixers, mixers
from lodestrata.operators import access, bloom, layout, merge, report, txn
from lodestrata.plans import registry
from lodestrata.plans.util import ordered
from lodestrata.sources.views import txn_ops
from lodestrata.streaming import upsert
from tests.conftest import DATA


def test_verification_codes():
    assert hashing.verification(lambda k, s: hashing.wordmix(k), 8) == 0xF55EC779
    assert hashing.verification(lambda k, s: hashing.wordmix(k, True)) == 0x56ECF74D
    for fn, code in ((hashing.fnv, 0xE3CBBE91), (hashing.bernstein, 0xBDB4B640), (hashing.oaat, 0x5363BD98)):
        assert hashing.verification(fn) == code


@pytest.mark.parametrize("key,value", [(b"", 0xA41F176187D1591B), (b"a", 0x52E9A349449FA14F), (b"sample-key-0", 0x24F417C8F8F8AFF2), (bytes(range(32)), 0xFFD9D74C536C5E23), (bytes(range(45)), 0xF4ED6918F1010924)])
def test_wordmix_vectors(key, value):
    assert int(hashing.wordmix([key])[0]) == value


@pytest.mark.parametrize("name,width,code", [("murmur2", 4, 0x27864C1E), ("murmur2a", 4, 0x7FBD4396), ("murmur2_64", 8, 0x1F0D3804), ("murmur2_64_by_32", 8, 0xDD537C05), ("murmur3a", 4, 0xB0F57EE3), ("murmur3f", 16, 0x6384BA69), ("murmur3c", 16, 0xB3ECE62A), ("fasthash64", 8, 0x03280FE7), ("fasthash32", 4, 0xCE25265D), ("superfast", 4, 0x980ACD1D), ("crap8", 4, 0x743E97A1), ("lookup3", 4, 0x3D83917A)])
def test_mixer_codes(name, width, code):
    assert hashing.verification(getattr(mixers, name), width) == code


@pytest.mark.parametrize("size,value", [(0, 0x726FDB47DD0E0E31), (15, 0xA129CA6149BE45E5)])
def test_siphash_vectors(size, value):
    half = lambda start: int.from_bytes(bytes(range(start, start + 8)), "little")
    assert int(mixers.siphash([bytes(range(size))], half(0), second=half(8))[0]) == value


def test_wide_hash_columns(spark):
    d = spark.createDataFrame([(b"abc",), (None,), (b"",)], "k binary")
    got = [r[0] for r in d.select(hashing.wide("murmur3c")(F.col("k"))).collect()]
    assert got[0] == [int(x) for x in mixers.murmur3c([b"abc"])[0]] and got[1] is None and got[2] == [0, 0, 0, 0]


def test_hash_columns_take_null_and_mixed_lengths(spark):
    d = spark.createDataFrame([("a",), (None,), ("x" * 70,), ("",)], "s string")
    got = [r[0] for r in d.select(hashing.REGISTRY["wordmix64"](F.col("s"))).collect()]
    assert got[1] is None and got[0] % 2**64 == 0x52E9A349449FA14F and got[3] % 2**64 == 0xA41F176187D1591B


def test_wrapping_multiply(spark):
    rng = random.Random(1)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [0, -1, 2**63 - 1, -(2**63)]
    b = 0xED27A0E9F72A6D47
    d = spark.createDataFrame([(v,) for v in values], "a long")
    for r in d.select("a", hashing.wrapping_multiply(F.col("a"), b).alias("p")).collect():
        assert r.p % 2**64 == r.a * b % 2**64


def test_varint_vectors(spark):
    golden = {0: "00", 127: "7f", 128: "8001", 4095: "ff1f", 4096: "802001", 1 << 20: "80400001"}
    d = spark.createDataFrame([(k,) for k in golden], "x long").select("x", layout.varint_hex(F.col("x")).alias("h")).withColumn("y", layout.varint_value(F.col("h")))
    assert {r.x: r.h for r in d.collect()} == golden and all(r.x == r.y for r in d.collect())
    far = [2**i | 2**j for i in range(0, 60, 7) for j in range(0, 60, 5)]
    d = spark.createDataFrame([(x,) for x in far], "x long").select("x", layout.varint_hex(F.col("x")).alias("h"), layout.varint_len(F.col("x")).alias("n"))
    assert all(len(r.h) == 2 * r.n and r.x == r.y for r in d.withColumn("y", layout.varint_value(F.col("h"))).collect())


def test_merge_keeps_every_key_and_is_idempotent(spark):
    run = lambda keys, tag: spark.createDataFrame([(k, 1, False, f"{tag}{k}") for k in keys], "k string, seq int, is_deleted boolean, v string")
    a, b = run("ac", "1"), run("cd", "2")
    got = {r.k: r.v for r in merge.priority_merge([a, b]).collect()}
    assert got == {"a": "1a", "c": "1c", "d": "2d"}
    again = merge.priority_merge([merge.priority_merge([a, b]).drop("prio"), b])
    assert {r.k: r.v for r in again.collect()} == got


def test_tombstone_shadows_and_empty_value_stays(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, None), ("b", 1, True, None), ("b", 2, False, "")], "k string, seq int, is_deleted boolean, v string")
    assert [(r.k, r.v) for r in merge.live_view(log).collect()] == [("b", "")]


def test_disjoint_runs_keep_nine_thousand(spark):
    runs = [spark.range(1000 + i, 10000, 4).select(F.concat(F.lit("sample-key-"), "id").alias("k")) for i in range(4)]
    assert merge.priority_merge(runs).count() == 9000


def test_seek(spark):
    t = spark.createDataFrame([("a",), ("c",), ("d",)], "k string")
    keys = lambda d: sorted(r.k for r in d.collect())
    assert keys(access.seek_exact(t, "c")) == ["c", "d"] and keys(access.seek_exact(t, "b")) == []
    assert keys(access.seek_lower_bound(t, "b")) == ["c", "d"] and keys(access.range_scan(t, None, "c")) == ["a"]


def test_display(spark):
    d = spark.createDataFrame([("k", None, True, True), ("k", "v", False, False)], "k string, v string, d boolean, c boolean")
    assert [r[0] for r in d.select(access.display(*map(F.col, "kvdc"))).collect()] == ["'k' -> removed [cached]", "'k' -> 'v'"]


def test_one_row_run_is_found(spark):
    run = spark.createDataFrame([("m", "v")], "k string, v string")
    probes = spark.createDataFrame([("a",), ("m",), ("z",)], "k string")
    assert {r.k: r.index_key for r in layout.index_lookup(probes, run).collect()} == {"a": None, "m": "m", "z": "m"}


def test_layout_offsets(spark):
    run = spark.range(500).select(F.format_string("key-%05d", "id").alias("k"), F.repeat(F.lit("v"), (F.col("id") % 200).cast("int")).alias("v"))
    r = sorted(layout.layout(run).collect(), key=lambda r: r.pos)
    assert [x.pos for x in r] == list(range(500)) and [x.k for x in r] == sorted(x.k for x in r)
    at = 0
    for x in r:
        assert x.offset == at and x.common_len == (0 if x.restart else len(x.k) - len(x.k.lstrip()) or x.common_len)
        at += x.size
    assert [x.pos for x in r if x.restart] == [*range(0, 500, 51), 499]


def test_ordered_is_a_permutation(spark):
    d = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    r = sorted(ordered(d, "k").collect(), key=lambda r: r.pos)
    assert [x.pos for x in r] == list(range(1000)) and [x.k for x in r] == sorted(x.k for x in r)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("test-string-"), "id").alias("k"))
    h = hashing.REGISTRY["wordmix64"](F.col("k"))
    built = bloom.build(keys.withColumn("h", h), F.col("h"))
    assert bloom.probe(keys.withColumn("h", h), F.col("h"), built).where("not hit").count() == 0
    with pytest.raises(ValueError):
        bloom.positions(F.lit(1), 33, 2)


def test_txn_counts(spark):
    got = {(r.op, r.verdict): r["count"] for r in txn.verdicts(txn_ops(spark, "/root/testdata/sf0.01")).groupBy("op", "verdict").count().collect()}
    assert got == {("R", "ok"): 3366, ("R", "abort"): 633, ("W", "ok"): 2980, ("W", "skip"): 370, ("W", "abort"): 670, ("RW", "ok"): 1473, ("RW", "abort"): 508}


def test_serial_log_rejects_nothing(spark):
    ops = spark.range(300).select(F.col("id").alias("seq"), F.concat(F.lit("k"), F.col("id") % 7).alias("k"), (F.col("id") + 1).alias("ts"), F.element_at(F.array(*map(F.lit, ("R", "W", "RW"))), (F.col("id") % 3 + 1).cast("int")).alias("op"))
    assert {r.verdict for r in txn.verdicts(ops).collect()} == {"ok"}


def test_cascade_reaches_through_dependencies(spark):
    v = spark.createDataFrame([(1, "abort", None), (2, "ok", 1), (3, "ok", 2), (4, "ok", None)], "ts long, verdict string, dep long")
    assert sorted(r.ts for r in txn.cascade(v).collect()) == [1, 2, 3]


def test_streams_agree_with_batches(spark, tmp_path):
    ops = txn_ops(spark, "/root/testdata/sf0.001")
    ops.coalesce(1).write.parquet(str(tmp_path / "ops"))
    q = upsert.verdict_stream(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seq, r.verdict) for r in spark.table("verdicts").collect()}
    assert got == {(r.seq, r.verdict) for r in txn.verdicts(ops).collect()} and got


def test_outliers(spark):
    d = spark.createDataFrame([(float(i % 10),) for i in range(200)] + [(1e6,)], "value double")
    assert report.trim_outliers(d, "value").agg(F.max("value")).first()[0] < 10
    assert report.trim_outliers(d.limit(0), "value").count() == 0


def test_lint(spark):
    cases = {"feat(memtable): add a seek": True, "feat(memtable): Add a seek": False, "feat(nowhere): add": False, "hello": False, "fix(*)!: keep rows": True, "fix(*): keep rows.": False, "odd(*): x": False}
    d = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.ok for r in d.select("h", report.header_ok(F.col("h"), ("*", "memtable")).alias("ok")).collect()} == cases
    bodies = {"h": True, "h\n\nfine": True, "h\nends \nx": False, "h\n" + "x" * 81: False, "h\na\tb": False, "h\n": True, "h\na\n": False, "h\na\n\n\nb": False, "h\n日": False}
    d = spark.createDataFrame([(k,) for k in bodies], "t string")
    assert {r.t: r.ok for r in d.select("t", report.body_ok(F.col("t")).alias("ok")).collect()} == bodies


def test_keyset_sizes(spark):
    assert keysets.two_bytes(spark, 4).count() == 255**2 * (1 + 3 + 6) + 255 * (2 + 3 + 4)
    assert keysets.permutation(spark, 6).distinct().count() == 720
    assert keysets.sparse(spark, 10, 10).distinct().count() == 1024


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flushed_run_prunes_and_pushes_down(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("key-%05d", "id").alias("k"), F.col("id").alias("seq"), F.lit(False).alias("is_deleted"), F.md5(F.col("id").cast("string")).alias("v"), (F.col("id") % 5 == 0).alias("cached"))
    run = layout.flush(rows, str(tmp_path / "run"))
    assert run.count() == 1600
    p = plan(access.point_get(run, "key-00042").select("seq"))
    assert "EqualTo(k,key-00042)" in p and "ReadSchema: struct<k:string,seq:bigint>" in p
    p = plan(access.range_scan(run, "key-00100", "key-00200").select("k"))
    assert "GreaterThanOrEqual(k,key-00100)" in p and "ReadSchema: struct<k:string>" in p


def test_key_filter_goes_below_a_merge(spark, tmp_path):
    paths = []
    for i in range(2):
        spark.range(100).select(F.format_string("k%03d", "id").alias("k"), F.lit(i).alias("seq"), F.lit(False).alias("is_deleted"), F.lit(str(i)).alias("v")).write.parquet(str(tmp_path / str(i)))
        paths.append(spark.read.parquet(str(tmp_path / str(i))))
    got = merge.priority_merge(paths).where("k = 'k007'")
    assert plan(got).count("EqualTo(k,k007)") == 2 and [r.v for r in got.collect()] == ["0"]


def test_merge_combines_before_the_shuffle(spark):
    p = plan(merge.upsert_latest(spark.createDataFrame([("a", 1, False, "x")], "k string, seq int, is_deleted boolean, v string")))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_max_by" in p


def test_body_rule_on_line_ends(spark):
    bodies = {"h\nfine": True, "h\nblank ": False, "h\ncr\r": False, "h\nff\x0c": False, "h\nnbsp\u00a0": False, "h\nnel\x85": False, "h\nmore than one": True, "h": True}
    d = spark.createDataFrame([(k,) for k in bodies], "h string")
    assert {r.h: r.ok for r in d.select("h", report.body_ok(F.col("h")).alias("ok")).collect()} == bodies


def test_prefixes_by_halving(spark):
    rng = random.Random(3)
    rows = [("", ""), (None, "a"), ("a", None), ("abc", "abc"), ("é", "è"), ("x" * 1000, "x" * 999 + "y")] + [tuple("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in "xy") for _ in range(200)]
    d = spark.createDataFrame(rows, "a string, b string")

    def want(a, b):
        x, y = (a or "").encode(), (b or "").encode()
        return next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))

    assert [r.n for r in d.select(layout.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [want(*r) for r in rows]


def test_short_varints_are_null(spark):
    d = spark.createDataFrame([("",), ("7f",), ("80",), ("8000",), ("8020",), ("802001",), ("ffff" + "ff" * 6,), ("ffff" + "ff" * 7,)], "e string")
    assert [r.v is None for r in d.select(layout.varint_checked(F.col("e")).alias("v")).collect()] == [True, False, True, False, True, False, True, False]


def test_reads_of_a_flushed_run_are_pushed_down(spark):
    plan = registry.QUERIES["run_point_get"](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(k,sample-key-1000)" in plan


def test_probes_are_not_shuffled(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("k"))
    built = bloom.build(keys, bloom.md5_hash(F.col("k")), 16)
    plan = bloom.probe(keys, bloom.md5_hash(F.col("k")), built, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestrata.plans import util

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(ValueError):
        util.shared_dir(SimpleNamespace(sparkContext=sc))


@pytest.mark.parametrize("name,width,code", [("city64", 8, 0x25A20825), ("city128", 16, 0x6531F54E), ("spooky32", 4, 0x3F798BBB), ("spooky64", 8, 0xA7F955F1), ("spooky128", 16, 0x8D263080), ("crc32", 4, 0x3719DB20)])
def test_long_mixers(name, width, code):
    assert hashing.verification(getattr(longmixers, name), width) == code
    assert len(getattr(longmixers, name)([])) == 0


def test_blob_bits_equal_big_integers(spark):
    rows = [(b"", 0), (b"\x81", 0), (b"\x81", 3), (bytes(range(200, 213)), 0), (bytes(range(200, 213)), 29), (bytes(range(200, 213)), 104), (bytes(range(13)), 500), (None, 3)]
    d = spark.createDataFrame([(bytearray(b) if b is not None else None, n) for b, n in rows], "b binary, n int")
    b, n = F.col("b"), F.col("n")
    got = d.select("b", "n", bits.shift_left(b, n).alias("up"), bits.shift_right(b, n).alias("down"), bits.rotate_left(b, n).alias("left"), bits.rotate_right(b, n).alias("right"), bits.set_bit_at(b, n).alias("one"), bits.clear_bit_at(b, n).alias("zero"), bits.flip_bit_at(b, n).alias("flip"),
                   bits.window(b, n, 32).alias("window"), bits.bit_at(b, n).alias("bit"), bits.bit_at(b, n, wrap=True).alias("wrapped")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.b is None:
            assert all(r[c] is None for c in ("up", "down", "left", "right", "one", "zero", "flip", "window", "bit"))
            continue
        size, v = 8 * len(r.b), int.from_bytes(r.b, "little")
        whole, turn = (1 << size) - 1, r.n % size if size else 0
        right = (v >> turn | v << (size - turn)) & whole
        want = {"up": v << r.n & whole, "down": v >> r.n, "left": (v << turn | v >> (size - turn)) & whole, "right": right, "one": (v | 1 << r.n) & whole, "zero": v & ~(1 << r.n), "flip": (v ^ 1 << r.n) & whole}
        assert {c: int.from_bytes(r[c], "little") for c in want} == want and all(len(r[c]) == len(r.b) for c in want)
        assert r.bit == v >> r.n & 1
        if size:
            again = sum(((v >> (turn + i) % size) & 1) << i for i in range(32))
            assert r.window == again and r.wrapped == right & 1


def test_xorshift(spark):
    def words(seed, n, y):
        x, z, w, out = 0x498B3BC5 ^ seed & 0xFFFFFFFF, 0, 0, []
        for i in range(10 + n):
            t = (x ^ x << 11) & 0xFFFFFFFF
            x, y, z, w = y, z, w, w ^ w >> 19 ^ t ^ t >> 8
            out.append(x)
        return out[10:]

    seeds = [0, 1, 7, 2**32 - 1, 2**40 + 5]
    got = spark.createDataFrame([(s,) for s in seeds], "s long").select("s", keysets.random_words(F.col("s"), 6).alias("a"), keysets.random_words(F.col("s"), 6, True).alias("b"), keysets.random_longs(F.col("s"), 5).alias("c")).collect()
    for r in got:
        assert r.a == words(r.s, 6, 0) and r.b == words(r.s, 6, 0x5A05089A ^ r.s >> 32)
        assert [x % 2**64 for x in r.c] == [a << 32 | b for a, b in zip(r.a, r.a[1:])]


def test_fmix32_equals_numpy(spark):
    import numpy as np

    values = [0, 1, 2**31, 2**32 - 1, 123456789]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(hashing.finalised32(F.col("v"))).collect()
    assert [r[0] for r in got] == mixers.fmix32(np.array(values, np.uint32)).tolist()


def _window(h, s, width):
    return (h >> s | h << 32 - s) & (1 << width) - 1


def _score(bins, bits):
    """The score of each bin's keys; None where no two keys share a bin."""
    counts = Counter(bins)
    k, q = float(sum(counts.values())), float(sum(c * c for c in counts.values()))
    return 1 - ((k * k - 1) / (q - k)) / 2.0 ** bits if q > k else None


def _hashes(spark, n, parts=3):
    """Uneven 32-bit hashes and two nulls."""
    rng = random.Random(n)
    h = [rng.choice([rng.getrandbits(32), rng.getrandbits(6) << 13, 0xFFFFFFFF]) for _ in range(n)] + [None, None]
    return h, spark.createDataFrame([(x,) for x in h], "h long").repartition(parts)


def test_byte_pairs(spark):
    h, d = _hashes(spark, 400)
    got = hashstats.byte_pairs(d)
    assert len(got._jdf.queryExecution().toString()) < 20_000  # the plan made a row a pair, and ran a small driver out of memory
    want = {(a, b): _score([None if x is None else _window(x, a, 8) | _window(x, b, 8) << 8 for x in h], 16) for a in range(32) for b in range(a, 32)}
    assert {(r.a, r.b): r.score for r in got.collect()} == want


def test_blob_bits_find_the_bytes_once(spark):
    data = random.Random(1).randbytes(5000)
    d = spark.createDataFrame([(bytearray(data),)], "b binary")
    got = d.select(bits.rotate_left(F.col("b"), F.lit(11)).alias("r"))
    assert got._jdf.queryExecution().analyzed().toString().count("conv(") == 1  # within the lambda they were found anew for every byte
    v = int.from_bytes(data, "little")
    assert int.from_bytes(got.first().r, "little") == (v << 11 | v >> 40000 - 11) & (1 << 40000) - 1


def test_roundtrips_of_large_ids(spark, duck, tmp_path):
    ids = [0, 1048575, 1048576, 5999999, 1 << 27, 1 << 28, (1 << 40) + 12345, 2**63 - 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r for r in registry.u64_roundtrip(spark, str(tmp_path)).collect()}
    for i in ids:
        word = (i ** 3 * 37 % 2**64).to_bytes(8, "little")
        assert (got[i].encoded, got[i].decoded) == (word.hex(), int.from_bytes(word, "little", signed=True))
    short = {r.event_id: r for r in registry.varint_roundtrip(spark, str(tmp_path)).collect()}
    assert all(short[i].decoded == i and len(short[i].encoded) % 2 == 0 for i in ids)
    # beyond three bytes the SQL of varint_wide holds, which varint_roundtrip's doesn't reach
    wide = registry.WIDTHS.replace("(1::BIGINT << (event_id % 63)::INT) + event_id", "event_id").replace("FROM events", f"FROM (SELECT unnest({ids})::BIGINT AS event_id)")
    assert dict(duck.sql(f"WITH {wide} SELECT event_id, encoded FROM e").fetchall()) == {i: short[i].encoded for i in ids}


def test_differential_scores(spark):
    rng = random.Random(2)
    keys = [rng.randrange(1 << 20) for _ in range(300)] + [7, 7, None, None]
    weak = lambda c: (c * 2654435761 + 77) % 2**32
    got = hashstats.differential_scores(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), "k", weak, 6).collect()
    assert len(got) == 6
    for r in got:
        h = [None if k is None else weak(k) ^ weak(k ^ 1 << r.in_bit) for k in keys]
        # like in SQL a missing hash is no distinct one, and has a bin of its own
        assert (r.n, r.collisions) == (len(h), len(h) - len(set(h) - {None}))
        assert r.worst == max(_score([None if x is None else _window(x, s, 8) for x in h], 8) for s in range(32))


def test_windows_over_widths(spark):
    h, d = _hashes(spark, 3000)
    w = hashstats.widest(len(h))
    plan = hashstats.window_scores(d, w, least=w - 2)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text and "struct(" not in text  # a row a key and start was made and all bins of all starts grouped by each task
    want = {(s, v): _score([None if x is None else _window(x, s, v) for x in h], v) for s in range(32) for v in range(w - 2, w + 1)}
    assert {(r.start, r.width): r.score for r in plan.collect()} == want
    worst = hashstats.worst_over_widths(d, least=w - 2).first()
    assert (worst.start, worst.width) == min(want, key=lambda k: (-want[k], *k)) and worst.score == max(want.values())
    counts = Counter((s, None if x is None else _window(x, s, 11)) for x in h for s in (0, 30))
    assert {(r.start, r.bin): r.b for r in hashstats.window_counts(d, 11, [0, 30]).collect()} == counts
    assert hashstats.worst_over_widths(d.limit(5)).count() == 0
