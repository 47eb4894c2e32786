"""Goldens of hashing, layout, metrics, chunks and the filter."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import chunk, hashing, layout, metrics
from palimpsest.functions.cuckoo import Cuckoo, maybe_in


def unsigned(df, column):
    return [int(r[0]) for r in df.orderBy("i").select(hashing.unsigned(F.col(column))).collect()]


def test_mix64(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 42)], "i int, x long")
    want = [0, 6238072747940578789, 12058926934050108962]
    assert unsigned(hashing.with_mix64(df, F.col("x"), "h"), "h") == want
    assert unsigned(df.withColumn("h", hashing.mix64_arrow("x")), "h") == want


def tokens(prefix, n=32):
    return [((prefix * 2654435761) ^ i) & 0xFFFFFFFF for i in range(n)]


def test_hash_path(spark):
    rows = [(0, 1, tokens(1), 0), (1, 7, tokens(7), 0), (2, 42, tokens(42), 0), (3, 7, tokens(7, 17), 0), (4, 7, tokens(7, 64)[32:], 1), (5, 7, [], 1)]
    df = spark.createDataFrame(rows, "i int, p long, t array<long>, g int")
    want = [3526506465539433749, 16539589661102655433, 3468298330635458505, 18228852216627952817, 16770436328523005501, 7912320091617323034]
    assert unsigned(hashing.with_hash_path(df, F.col("p"), F.col("t"), F.col("g"), "h"), "h") == want


def test_path_of_two_groups(spark):
    df = spark.createDataFrame([(0, 7, tokens(7, 64))], "i int, p long, t array<long>")
    got = hashing.with_path_hashes(df, F.col("p"), F.col("t"), "h").select(F.transform("h", hashing.unsigned)).first()[0]
    assert got == ["16539589661102655433", "16770436328523005501"]


def test_key_strings(spark):
    df = spark.createDataFrame([(0, "page_000"), (1, "nope"), (2, "")], "i int, k string")
    assert unsigned(hashing.with_hash64(df, F.col("k"), "h"), "h") == [121657335517966667, 4943533927674187869, 17665956581633026203]
    abc = spark.createDataFrame([(0, "abc")], "i int, k string")
    assert unsigned(hashing.with_fnv64(abc, F.col("k"), "h"), "h") == [16654208175385433931]


def test_stand_in_tokens_and_routes(spark):
    df = spark.createDataFrame([(7,)], "s long")
    assert hashing.with_stand_in_tokens(df, F.col("s"), "t", 3).first().t == [283524, 300362, 317201]
    p = spark.createDataFrame([(1,), (7,), (42,)], "p long")
    for n, want in ((2, [1, 0, 0]), (8, [5, 4, 2])):
        assert [r.dev for r in hashing.routed(p, F.col("p"), n).orderBy("p").collect()] == want


def test_unsigned_mod(spark):
    values = [0, 1, -1, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for n in (2, 7, 8, 1000):
        got = {r.x: r.m for r in df.select("x", hashing.unsigned_mod(F.col("x"), n).alias("m")).collect()}
        assert got == {v: (v % 2**64) % n for v in values}


LAYOUT = {
    "llama-3.1-8b": (131072, 4194304, 262144, 262144, 262144, 4194304), "qwen2.5-1.5b": (28672, 917504, 262144, 262144, 262144, 917504),
    "deepseek-v3": (70272, 2248704, 294912, 262144, 262144, 2248704), "falcon-7b": (8192, 262144, 262144, 262144, 262144, 262144),
    "gemma-2-9b": (344064, 11010048, 262144, 262144, 262144, 11010048), "glm-4-9b": (40960, 1310720, 262144, 262144, 262144, 1310720),
}


def test_layouts(spark):
    for r in layout.tuned(layout.presets(spark)).collect():
        assert r.alignment == 4096 and r.batch_min <= r.stripe_threshold and r.dram_entry_max >= r.group_bytes
        assert r.stripe_unit % 4096 == 0 and r.stripe_unit % r.group_layer_bytes == 0
        if r["name"] in LAYOUT:
            assert (r.token_bytes, r.group_bytes, r.stripe_unit, r.stripe_threshold, r.batch_min, r.dram_entry_max) == LAYOUT[r["name"]]


def test_special_kinds(spark):
    base = layout.PRESETS[0]
    rows = [("ssm", "SSM", *base[2:]), ("swa", "SWA", *base[2:9], 4096, 0, 32), ("hybrid", "HYBRID", *base[2:10], 4, 32), ("sparse", "SPARSE", *base[2:7], 512, 64, 0, 0, 32)]
    df = layout.with_bytes(spark.createDataFrame(rows, layout.FIELDS)).withColumn("c", layout.context_bytes(F.lit(100000).cast("long")))
    got = {r["name"]: r for r in df.collect()}
    assert got["ssm"].c == 0 and got["swa"].c == 4096 * 131072 and got["hybrid"].kv_layers == 4 and got["sparse"].token_layer_bytes == 1152


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (900, 1100, 3000, 5000)], "ns long")
    h = metrics.histogram(df, F.col("ns"))
    assert sorted((r.bucket, r.n) for r in h.collect()) == [(9, 1), (10, 1), (11, 1), (12, 1)]
    assert metrics.summary(h).first().avg == 2500
    p = {r.p: r.value for r in metrics.percentiles(h, [25, 50, 100]).collect()}
    assert p == {25: 1024, 50: 2048, 100: 8192}
    other = metrics.histogram(spark.createDataFrame([(900,)], "ns long"), F.col("ns"))
    assert metrics.merged(h.unionByName(other)).agg(F.sum("n")).first()[0] == 5


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (2**31, 31), (2**40, 31)], "v long, b int")
    assert df.where(metrics.bucket(F.col("v")) != F.col("b")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=5000), max_size=6), st.integers(0, 2**64 - 1))
def test_chunk_round_trip(records, prefix):
    c = chunk.encode(prefix, 3, 9, records)
    assert len(c) % 4096 == 0 and chunk.valid(c)
    assert [c[o:o + n] for _, o, n in chunk.parse(c)] == records
    torn = bytearray(c)
    torn[len(c) // 2] ^= 1
    assert not chunk.valid(bytes(torn))


def test_chunk_rejects():
    assert not chunk.valid(None) and not chunk.valid(b"") and not chunk.valid(b"x" * 4096) and not chunk.valid(b"x" * 10)


def test_crc(spark):
    assert spark.sql("select crc32(cast('123456789' as binary))").first()[0] == 3421780262


def test_cuckoo():
    f = Cuckoo(4096)
    keys = np.arange(1, 3001, dtype=np.uint64)
    assert all(f.insert(int(k)) for k in keys)
    for k in keys[:1500]:
        assert f.delete(int(k))
    assert f.contains(keys[1500:]).all() and f.count == 1500
    assert f.contains(np.arange(10**6, 10**6 + 100_000, dtype=np.uint64)).mean() < 0.10
    tiny = Cuckoo(1)
    assert not all(tiny.insert(k) for k in range(1, 200))


def test_cuckoo_join(spark):
    probes, keys = spark.range(1000).selectExpr("id AS k"), spark.range(0, 1000, 7).selectExpr("id AS k")
    got = {r.k for r in maybe_in(probes, F.col("k"), keys, "k").collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 300


def test_rank_suffix(spark):
    df = spark.createDataFrame([("a/b", False, "1", "4", "0", 1), ("a/b", True, "1", "4", "2", 3), (None, True, "1", "4", "0", 1)], "m string, l boolean, tr string, ts string, pr string, ps int")
    got = [r[0] for r in df.select(hashing.rank_suffix(F.col("m"), F.col("l"), F.col("tr"), F.col("ts"), F.col("pr"), F.col("ps"))).collect()]
    assert got == ["_a-b-1_4", "_a-b-3_2", ""]


def test_format_ns(spark):
    df = spark.createDataFrame([(999,), (1500,), (2_300_000,), (4_560_000_000,)], "n long")
    assert [r[0] for r in df.select(metrics.format_ns(F.col("n"))).collect()] == ["999ns", "1.5us", "2.3ms", "4.5s"]


def test_as_rows_of_mixed_types(spark):
    one = spark.createDataFrame([(1, 0.5)], "a long, b double")
    assert {r.metric: r.value for r in metrics.as_rows(one).collect()} == {"a": "1", "b": "0.5"}


def test_arrow_twin_matches_columns(spark):
    df = spark.range(200).withColumn("x", F.xxhash64("id"))
    both = hashing.with_mix64(df, F.col("x"), "h").withColumn("g", hashing.mix64_arrow("x"))
    assert both.where("h <> g").count() == 0

