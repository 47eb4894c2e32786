"""Small cases of state, tier, allocator, collection, recovery, sources and streams."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import alloc, durability, gc, index, oplog, placement, sequences, state, tier, tokens
from palimpsest.operators.running import running_sum
from palimpsest.plans import views
from palimpsest.sources.config import Config, geometry_ok, region_pages
from palimpsest.sources.store import Store, read_config_texts, write_metrics_csv
from palimpsest.sources.workload import keys
from palimpsest.streaming import streams

LOG = "seq long, now_s long, op string, prefix_id long, group_idx int, payload_len long, expire_ts long"


def log(spark, *rows):
    return spark.createDataFrame([(k, 100 + k, op, p, g, 64, e) for k, (op, p, g, e) in enumerate(rows, 1)], LOG)


def outcomes(df):
    return [r.outcome for r in state.point_in_time(df).orderBy("seq").collect()]


def test_put_get_evict(spark):
    df = log(spark, ("PUT", 1, 0, 0), ("GET", 1, 0, 0), ("GET", 999, 0, 0), ("EVICT", 1, 0, 0), ("GET", 1, 0, 0), ("EVICT", 1, 0, 0), ("PUT", 1, 0, 0), ("GET", 1, 0, 0), ("GET", 1, 1, 0))
    assert outcomes(df) == ["OK", "HIT", "ENOENT", "OK", "EVICTED", "ENOENT", "OK", "HIT", "EVICTED"]


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_stretches_change_nothing(spark, sf_dir, chunk):
    ops = oplog.read(spark, sf_dir)
    a, b = (state.point_in_time(ops, c).select("seq", "outcome", "live", "tombstoned") for c in (None, chunk))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(spark, inclusive):
    df = spark.range(50).selectExpr("id * 3 AS seq", "id % 2 AS k", "id AS v")
    got = running_sum(df, ["k"], F.col("v"), "s", inclusive, stretch=10)
    rows, total = sorted((r.seq, r.k, r.v, r.s) for r in got.collect()), [0, 0]
    for _, k, v, s in rows:
        assert s == total[k] + v * inclusive
        total[k] += v


def test_prefix_zero_has_no_tombstone(spark):
    assert outcomes(log(spark, ("PUT", 0, 0, 0), ("EVICT", 0, 0, 0), ("GET", 0, 0, 0))) == ["OK", "OK", "ENOENT"]


def test_expiry_is_strict(spark):
    df = log(spark, ("PUT", 1, 0, 102), ("GET", 1, 0, 0), ("GET", 1, 0, 0))
    assert outcomes(df) == ["OK", "HIT", "ENOENT (expired)"]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert state.outcome_counts(empty).count() == 0 and state.leaves(empty).count() == 0


def test_reopen_forgets_tombstones(spark):
    df = log(spark, ("PUT", 1, 0, 0), ("EVICT", 1, 0, 0), ("GET", 1, 0, 0), ("GET", 1, 0, 0))
    assert [r.outcome for r in state.reopened(df, 3).collect()] == ["ENOENT"]


def test_batch_exists_hole(spark):
    leaf = spark.createDataFrame([(1, g, g) for g in (0, 1, 3, 4)], "prefix_id long, group_idx int, ver long")
    wanted = spark.createDataFrame([("a", g, 1, g) for g in range(5)] + [("b", 0, 1, 0), ("b", 1, 1, 1)], "batch string, pos int, prefix_id long, group_idx int")
    assert {r.batch: r.prefix_len for r in state.batch_exists(wanted, leaf).collect()} == {"a": 2, "b": 2}


def test_longest_prefix_with_hole(spark):
    text = " ".join(f"t{i}" for i in range(320))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    a = tokens.addresses(docs, tokens.tokens_of(), "doc_id")
    assert a.count() == 10
    assert tokens.stored_prefix(a, a).first().stored_prefix == 10
    assert tokens.stored_prefix(a, a.where("group_idx <> 4")).first().stored_prefix == 4


def test_shared_prefix_diverges(spark):
    base = [f"t{i}" for i in range(128)]
    docs = spark.createDataFrame([(k, " ".join(base + [f"{k}-{i}" for i in range(64)])) for k in (1, 2)], "doc_id long, text string")
    s = tokens.shared_addresses(tokens.addresses(docs, tokens.tokens_of(), "doc_id"))
    assert sorted((r.group_idx, r.copies) for r in s.collect()) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1), (4, 1), (5, 1), (5, 1)]


def test_null_and_empty_texts_have_one_empty_token(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert tokens.split_groups(docs, tokens.tokens_of(), "doc_id").where("n_tokens = 1").count() == 2


def test_stripes(spark):
    puts = spark.createDataFrame([(1, 5, 126 * 65536), (2, 5, 126 * 68 * 1024), (3, 5, 2 * 262144 + 123), (4, 5, 1 << 20)], "seq long, prefix_id long, payload_len long")
    parts = placement.stripe_parts(puts, 4)
    assert {r.seq: r["count"] for r in parts.groupBy("seq").count().collect()} == {1: 32, 2: 34, 3: 1, 4: 1}
    small = placement.stripe_parts(puts.where("seq = 3"), 4, threshold=1 << 18)
    assert [r.part_len for r in small.orderBy("part").collect()] == [262144, 262144, 123]
    assert parts.groupBy("seq").agg(F.sum("part_len").alias("s")).join(puts, "seq").where("s <> payload_len").count() == 0


def test_hits_ascend_and_decay(spark):
    hits = spark.createDataFrame([(5, 2)] * 10, "prefix_id long, group_idx int")
    got = {(r.prefix_id, r.depth): r.hits for r in index.ascended_hits(hits).collect()}
    assert got == {(0, 0): 10, (5, 1): 10, (5, 2): 10, (5, 3): 10}
    ticks = spark.createDataFrame([("k", 1, 64), ("k", 6, 0)], "k string, tick long, hits long")
    assert index.decay_by_tick(ticks, "k").first().hits == 2
    hot = {r.group_idx: r.hot for r in index.hot_paths(index.ascended_hits(hits), 9).collect()}
    assert all(hot.values())


def test_sieve_keeps_its_budget():
    s = tier.Sieve(128 << 10)
    for k in range(20):
        assert s.put((k, 0), 1, 0, 8272)
    assert s.bytes <= 128 << 10 and len(s.table) <= 15 and s.evictions >= 5 and (19, 0) in s.table


def test_sieve_versions():
    s = tier.Sieve(1 << 20)
    s.put((1, 0), 5, 0, 100)
    s.put((1, 0), 6, 0, 100)
    s.put((1, 0), 5, 0, 100)
    assert s.get((1, 0), 6, 0) and not s.get((1, 0), 5, 0) and not s.get((1, 0), 4, 0)
    s.put((2, 0), 1, 10, 100)
    assert s.get((2, 0), 1, 10) and not s.get((2, 0), 1, 11)
    s.drop((1, 0))
    assert not s.get((1, 0), 6, 0)
    assert not s.put((3, 0), 1, 0, (8 << 20) + 1)


def test_sieve_spares_the_visited():
    s = tier.Sieve(300)
    for k in range(3):
        s.put((k, 0), 1, 0, 100)
    s.get((0, 0), 1, 0)
    s.put((3, 0), 1, 0, 100)
    assert (0, 0) in s.table and (1, 0) not in s.table


def test_shards_halve():
    assert tier.shards_for(64 << 20) == 64 and tier.shards_for(8 << 20) == 8 and tier.shards_for(1000) == 1


def test_batches():
    assert alloc.batches([10, 10, 60, 1], 64 * 4096, 1 << 30) == [[0, 1, 2], [3]]
    assert alloc.batches([10, 100], 1 << 30, 64 * 4096) == [[0], [1]]
    assert len(alloc.batches([1] * 1025, 1 << 40, 1 << 40)) == 3


def test_allocation_fits_regions(spark):
    parts = spark.range(500).selectExpr("0 AS dev", "id AS seq", "0 AS part", "3L AS part_pages")
    rows = alloc.allocate(parts, 128, 4, batch_min=8 * 4096).orderBy("seq").collect()
    assert all(r.page >= 1 and r.page + 3 <= 128 for r in rows) and rows[-1].epoch > 4
    assert len({(r.epoch, r.page) for r in rows}) == 500


def test_recovery_equals_fold(spark, sf_dir):
    ops = oplog.read(spark, sf_dir)
    for cut in (0, 137, 900, 10**9):
        got = durability.recover(durability.checkpoint(ops, F.lit(cut)), ops.where(F.col("seq") > cut))
        assert durability.difference(got, state.leaves(ops)).count() == 0


def test_valid_prefix_stops_at_the_first_torn(spark):
    j = spark.createDataFrame([(k, "a", k != 3) for k in range(6)], "seq long, s string, ok boolean")
    assert durability.valid_prefix(j, F.col("ok"), "s").count() == 3


def test_superblock(spark):
    b = spark.createDataFrame([(0, 0, 5, 1, True), (0, 1, 6, 1, False), (0, 2, 5, 2, True)], "dev int, slot int, epoch long, fmt_ts long, valid boolean")
    assert durability.newest_superblock(b, "dev").first().slot == 2


def regions(spark):
    return spark.createDataFrame([(0, e, b, e * 10, e * 10 + 5) for e, b in ((1, 100), (2, 0), (3, 50), (4, 7))], "dev int, epoch long, live_bytes long, base_s long, close_s long")


def test_collection(spark):
    r = regions(spark)
    assert gc.victims(r).first().epoch == 2
    assert [x.epoch for x in gc.epoch_trim(r, F.lit(1000), 5).collect()] == [2]
    assert sorted(x.epoch for x in gc.oldest_generations(r, F.lit(1000), 0, 2).collect()) == [1, 2]
    assert gc.oldest_generations(r, F.lit(1000), 10**6, 2).count() == 0


def test_pinned_leaves_survive(spark):
    leaf = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "ver long, dev int, epoch long")
    gone = spark.createDataFrame([(0, 5)], "dev int, epoch long")
    assert [x.ver for x in gc.drop_regions(leaf, gone, F.col("ver") == 1).collect()] == [1]


def test_checkpoint_trigger(spark):
    j = spark.createDataFrame([(1, 100, False, 0), (2, 4000, False, 0), (3, 1, True, 0), (4, 1, False, 2)], "i int, u int, l boolean, d int")
    assert [r.i for r in j.where(gc.checkpoint_due(F.col("u"), F.col("l"), F.col("d"))).collect()] == [2, 3, 4]


def test_sequences(spark):
    seqs = spark.createDataFrame([(1, [5, 6, 7]), (2, [5, 6, 7])], "sequence_id long, tokens array<long>")
    saved = sequences.save(seqs, F.lit(4096), F.lit(100), first_seq=1)
    leaf = state.leaves(saved)
    assert saved.select("prefix_id").distinct().count() == 2 and sequences.has(seqs, leaf).count() == 2
    gone = saved.unionByName(sequences.evict(seqs.where("sequence_id = 1"), F.lit(200), first_seq=10))
    assert [r.sequence_id for r in sequences.has(seqs, state.leaves(gone)).collect()] == [2]
    assert sequences.restore(seqs, leaf).where("payload_len = 4096").count() == 2


def test_views(spark, sf_dir):
    views.register(spark, sf_dir, "v_")
    assert spark.sql("SELECT count(*) FROM v_outcomes WHERE outcome = 'HIT'").first()[0] == spark.sql("SELECT sum(hits) FROM v_prefixes").first()[0]
    assert spark.sql("SELECT log2_bucket(1024)").first()[0] == 10 and spark.sql("SELECT payload_pages(4097)").first()[0] == 2


def test_profile_command(spark, capsys, tmp_path):
    from palimpsest.__main__ import main

    (tmp_path / "c.json").write_text('{"num_hidden_layers": 32, "num_attention_heads": 32, "num_key_value_heads": 8, "hidden_size": 4096}')
    assert main(["--list"]) == 0 and main(["llama-3.1-8b"]) == 0 and main(["--config", str(tmp_path / "c.json")]) == 0 and main(["none"]) == 1
    assert capsys.readouterr().out.count("token_bytes: 131072") == 2


def test_latch(spark):
    t = spark.createDataFrame(list(enumerate([10, 81, 75, 71, 60, 75, 90])), "tick long, live_bytes long")
    rows = gc.watermark_latch(t, 100, 80, 60).orderBy("tick").collect()
    assert [x.draining for x in rows] == [0, 1, 1, 1, 0, 0, 1] and sum(x.triggered for x in rows) == 2


def test_config():
    assert Config().validated() and Config(stripe_unit=0).resolved().stripe_unit == 262144
    for bad in (Config(max_layers=257), Config(batch_min_bytes=4608), Config(batch_min_bytes=2 << 20, stripe_threshold=1 << 20), Config(evict_tomb_cap=3), Config(dram_alloc_backend=4)):
        with pytest.raises(ValueError):
            bad.validated()
    assert Config.from_json(Config(region_cnt=9).to_json()).region_cnt == 9
    with pytest.raises(ValueError):
        Config.from_json('{"unknown": 1}')


def test_geometry():
    assert geometry_ok(0) and geometry_ok(512) and geometry_ok(4096) and not geometry_ok(256) and not geometry_ok(1000)
    assert region_pages(1202, Config(region_cnt=6)) == 200 and region_pages(10, Config()) == 64


def test_store(spark, tmp_path, sf_dir):
    store = Store(spark, str(tmp_path / "s"))
    ops = oplog.read(spark, sf_dir).where("op <> 'GET'").withColumn("dev", (F.col("prefix_id") % 2).cast("int")).withColumn("epoch", F.lit(1).cast("long"))
    store.append_journal(ops)
    assert store.journal().count() == ops.count()
    assert "PartitionFilters: [isnotnull(dev" in store.journal(0)._jdf.queryExecution().toString()
    store.write_snapshot(state.leaves(ops), 1)
    store.write_snapshot(state.leaves(ops).limit(1), 2)
    assert store.snapshot().count() == 1
    assert store.trim(0, 1) and store.journal().where("dev = 0").count() == 0
    assert store.clear()


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"num_hidden_layers": 2}')
    assert read_config_texts(spark, str(tmp_path / "c.json")).first().json.startswith("{")
    write_metrics_csv(spark.createDataFrame([("a", 1)], "metric string, value long"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().metric == "a"


@pytest.mark.parametrize("kind", ["uniform", "zipf", "sequential"])
def test_workload(spark, kind):
    k = keys(spark, 500, 20, kind)
    assert k.count() == 500 and k.where("key < 1 OR key > 20").count() == 0
    assert k.exceptAll(keys(spark, 500, 20, kind)).count() == 0


def test_stream_equals_batch(spark, sf_dir):
    stream = streams.available(streams.keyed_outcomes(streams.read(spark, sf_dir)), "append").select("seq", "outcome")
    batch = state.point_in_time(oplog.read(spark, sf_dir)).select("seq", "outcome")
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_session_ends_before_the_gap_is_over(spark, tmp_path):
    """Gaps to the last operation: one second less, the same, none, one second more, a microsecond less, the same."""
    times = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:59:59"), (1, "2024-01-01 11:59:59"), (1, "2024-01-01 11:59:59"), (1, "2024-01-01 18:00:00")]
    times += [(2, "2024-01-01 00:00:00.5"), (2, "2024-01-01 06:00:00.499999"), (2, "2024-01-01 12:00:00.499999")]
    spark.createDataFrame(times, "prefix_id long, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("prefix_id long, at timestamp").parquet(str(tmp_path / "t"))
    got = sorted(tuple(r) for r in streams.available(streams.sessions(stream), "complete").collect())
    day = 1704067200
    assert got == [
        (1, day, day + 43199, 2), (1, day + 43199, day + 64799, 2), (1, day + 64800, day + 86400, 1),
        (2, day, day + 43200, 2), (2, day + 43200, day + 64800, 1),
    ]


def test_pushdown_and_pruning(spark, sf_dir):
    plan = state.outcome_counts(oplog.read(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "CartesianProduct" not in plan


def _mix64(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def test_tier_against_lists(spark, sf_dir):
    """SIEVE with a plain list as queue, per shard, over the log's accesses."""
    budget, n = 4 << 20, 4
    accesses = tier.accesses_of(state.point_in_time(oplog.read(spark, sf_dir))).orderBy("seq").collect()
    shards = [{"queue": [], "hand": None, "hits": 0, "misses": 0, "evictions": 0, "rejected": 0} for _ in range(n)]
    for r in accesses:
        s, key = shards[_mix64((r.prefix_id ^ (r.group_idx << 32)) & ((1 << 64) - 1)) % n], (r.prefix_id, r.group_idx)
        queue = s["queue"]
        at = next((k for k, e in enumerate(queue) if e["key"] == key), None)

        def unlink(k):
            if s["hand"] is queue[k]:
                s["hand"] = queue[k + 1] if k + 1 < len(queue) else None
            del queue[k]

        if r.kind == "invalidate":
            if at is not None:
                unlink(at)
            continue
        if at is not None and queue[at]["ver"] == r.ver and not (queue[at]["expire"] and queue[at]["expire"] < r.now_s):
            queue[at]["visited"] = True
            s["hits"] += 1
            continue
        s["misses"] += 1
        if r.cost <= tier.ENTRY_HEAD or r.cost > min(tier.ENTRY_MAX, budget) or r.cost > budget // n:
            s["rejected"] += 1
            continue
        if at is not None:
            if queue[at]["ver"] >= r.ver:
                continue
            unlink(at)
        fresh = {"key": key, "ver": r.ver, "expire": r.expire_ts, "cost": r.cost, "visited": False}
        queue.append(fresh)
        while sum(e["cost"] for e in queue) > budget // n:
            e = s["hand"] or queue[0]
            k = queue.index(e)
            after = queue[k + 1] if k + 1 < len(queue) else None
            if e is fresh or e["visited"]:
                e["visited"] = e["visited"] and e is fresh
                s["hand"] = after
            else:
                del queue[k]
                s["hand"] = after
                s["evictions"] += 1
    got = {r.shard: r for r in tier.simulate(tier.accesses_of(state.point_in_time(oplog.read(spark, sf_dir))), budget).collect()}
    for k, s in enumerate(shards):
        if k in got:
            r = got[k]
            assert (r.hits, r.misses, r.evictions, r.rejected, r.entries, r.bytes) == (s["hits"], s["misses"], s["evictions"], s["rejected"], len(s["queue"]), sum(e["cost"] for e in s["queue"]))
    assert sum(r.evictions for r in got.values()) > 0


def test_allocation_against_a_loop(spark, sf_dir):
    parts = placement.stripe_parts(oplog.read(spark, sf_dir).where("op = 'PUT'"), 4)
    want = []
    by_dev = {}
    for r in parts.collect():
        by_dev.setdefault(r.dev, []).append((r.seq, r.part, r.part_pages))
    for dev, rows in by_dev.items():
        rows.sort()
        batch, used, number, region, epoch, cursor, waiting = [], 0, 0, 0, 1, 1, []
        for row in [*rows, None]:
            if batch and (row is None or len(batch) >= 512 or used >= 256 << 10 or used + row[2] * 4096 > 4 << 20):
                if cursor + sum(x[2] for x in batch) > 2048:
                    region, epoch, cursor = (region + 1) % 8, epoch + 1, 1
                for seq, part, pages in batch:
                    want.append((dev, seq, part, pages, number, region, epoch, cursor))
                    cursor += pages
                batch, used, number = [], 0, number + 1
            if row is not None:
                batch.append(row)
                used += row[2] * 4096
    got = [tuple(r) for r in alloc.allocate(parts, 2048, 8).collect()]
    assert sorted(got) == sorted(want) and max(r[6] for r in got) > 1


def test_long_logs_are_cut_into_stretches(spark, sf_dir, monkeypatch):
    ops = oplog.read(spark, sf_dir)
    whole = sorted(map(str, state.point_in_time(ops).collect()))
    monkeypatch.setattr(state, "STRETCH", 20)
    monkeypatch.setattr(state, "SMALL_LOG", 0)
    assert state._stretch(ops) == 20
    assert sorted(map(str, state.point_in_time(ops).collect())) == whole


def test_zipf_keys_by_ranges(spark, monkeypatch):
    from palimpsest.sources import workload

    whole = sorted(map(tuple, workload.keys(spark, 3000, 500, "zipf").collect()))
    monkeypatch.setattr(workload, "BROADCAST_KEYS", 10)
    monkeypatch.setattr(workload, "STRETCH", 64)
    assert sorted(map(tuple, workload.keys(spark, 3000, 500, "zipf").collect())) == whole


def test_config_class_from_its_schema():
    from dataclasses import asdict

    from palimpsest.sources import config

    made = config.generated(config.schema_json())
    assert asdict(made()) == asdict(Config()) and made(region_cnt=9).region_cnt == 9
    with pytest.raises(ValueError):
        config.generated('[{"name": "x", "type": "list", "default": 0}]')
