"""Further queries: lookups that count, saved sequences, stores and their files, replay with trims, full counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import cuckoo, hashing, layout, metrics
from palimpsest.operators import durability, gc, index, oplog, placement, sequences, state, tier
from palimpsest.plans import views
from palimpsest.plans.catalogue import (
    _CONFIGS, _COUNTERS, _FNV, _NODES, _PARTS, N_DEV, OPS, PLACED, STATE, _addressed, _batches, _hash_sql, _located_leaves, _ops, _placed, _regions, _table, query)
from palimpsest.sources import config, store
from palimpsest.streaming import streams

RING = 4

_TOKENS = "list_transform(range(g * 32, least(80, g * 32 + 32)), lambda i: (user_id * 2654435761 + i * 7919) % 2147483647)"
_TOKEN_BYTES = f"flatten(list_transform({_TOKENS}, lambda t: [CAST(t % 256 AS UHUGEINT), CAST(t // 256 % 256 AS UHUGEINT), CAST(t // 65536 % 256 AS UHUGEINT), CAST(t // 16777216 % 256 AS UHUGEINT)]))"
_GROUP_START = "xor((xor(14695981039346656037::UHUGEINT, CAST(user_id AS UHUGEINT)) * 2) % 18446744073709551616::UHUGEINT, CAST(g AS UHUGEINT))"


@query(_hash_sql(f"SELECT user_id, g, {_FNV.format(start=_GROUP_START, bytes=_TOKEN_BYTES)} AS h0 FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0, 1, 2]) AS g)", "user_id, g") + "SELECT user_id, CAST(g AS INTEGER) AS group_idx, CAST(h AS VARCHAR) AS path FROM d")
def path_hashes(spark, sf_dir):
    """Hashes of all groups of a sequence of 80 tokens; the last group is partial."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.expr("transform(sequence(0, 79), i -> (user_id * 2654435761L + i * 7919) % 2147483647)").alias("tokens"))
    return hashing.with_path_hashes(users, F.col("user_id"), F.col("tokens"), "h").select("user_id", F.posexplode("h").alias("group_idx", "x")).select("user_id", "group_idx", hashing.unsigned(F.col("x")).alias("path"))


@query("SELECT p_partkey, CAST(b AS INTEGER) AS block, b IN (0, 512, 1024, 2048, 4096) AS valid FROM (SELECT p_partkey, [0, 512, 1000, 4096, 8192, 2048, 513, 1024][1 + p_partkey % 8] AS b FROM part)")
def geometry_valid(spark, sf_dir):
    block = F.element_at(F.array(*[F.lit(b) for b in (0, 512, 1000, 4096, 8192, 2048, 513, 1024)]), (1 + F.col("p_partkey") % 8).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", block.alias("block"), store.geometry_valid(block).alias("valid"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 262144 ELSE s_suppkey % 3 * 65536 END AS stripe_unit, CASE WHEN s_suppkey % 2 = 0 THEN 1048576 ELSE 524288 END AS stripe_threshold, 262144::BIGINT AS batch_min_bytes, CASE WHEN s_suppkey % 5 = 0 THEN 8388608 ELSE s_suppkey % 5 * 1000 END AS dram_entry_max_bytes, 4096::BIGINT AS region_align_bytes FROM supplier")
def layout_defaults(spark, sf_dir):
    k = F.col("s_suppkey")
    given = _table(spark, sf_dir, "supplier").select("s_suppkey", (k % 3 * 65536).alias("stripe_unit"), (k % 2 * 524288).alias("stripe_threshold"), F.lit(0).alias("batch_min_bytes"), (k % 5 * 1000).alias("dram_entry_max_bytes"), F.lit(None).cast("long").alias("region_align_bytes"))
    return given.select("s_suppkey", *config.resolved_columns())


@query("SELECT p_partkey, budget, CAST(greatest(1, list_max(list_filter([64, 32, 16, 8, 4, 2, 1], lambda n: n = 1 OR budget // n >= 1048576))) AS INTEGER) AS shards FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 1500000 AS budget FROM part)")
def tier_shards(spark, sf_dir):
    budget = F.col("p_size").cast("long") * 1500000
    return _table(spark, sf_dir, "part").select("p_partkey", budget.alias("budget"), tier.shards_of(budget).alias("shards"))


@query(OPS + "SELECT seq, payload_len // 64 % 4096 > 3276 OR seq % 50 = 0 OR seq % 97 = 0 AS due FROM ops WHERE op <> 'GET'")
def checkpoint_due(spark, sf_dir):
    due = gc.checkpoint_due(F.expr("payload_len div 64 % 4096"), F.col("seq") % 50 == 0, F.when(F.col("seq") % 97 == 0, 1).otherwise(0))
    return _ops(spark, sf_dir).where("op <> 'GET'").select("seq", due.alias("due"))


# CRC-32 bit by bit: a table of 256 remainders, then a step a byte.
_CRC = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
c AS (SELECT c_custkey, list_transform(string_split(c_name || c_mktsegment, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM customer),
p AS (SELECT c_custkey, 'value' AS kind, b FROM c UNION ALL SELECT c_custkey, 'pages', list_resize(b, 4096, 0) FROM c WHERE c_custkey % 50 = 1)
SELECT c_custkey, kind, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(tab[CAST(xor(h, x) & 255 AS BIGINT) + 1], h >> 8)), 4294967295::BIGINT) AS crc FROM p, t"""


@query(_CRC)
def payload_crc(spark, sf_dir):
    """The check of values, and (every fiftieth, which are many steps in SQL) of their zero-padded pages."""
    from palimpsest.functions import chunk

    value = F.concat("c_name", "c_mktsegment").cast("binary")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", value.alias("v"))
    whole = rows.select("c_custkey", F.lit("value").alias("kind"), F.crc32("v").alias("crc"))
    return whole.unionByName(rows.where("c_custkey % 50 = 1").select("c_custkey", F.lit("pages").alias("kind"), chunk.pages_crc(F.col("v")).alias("crc")))


# Lookups.

_PROBES = ", w AS (SELECT prefix_id, pos AS group_idx FROM (SELECT DISTINCT prefix_id FROM ops), (SELECT unnest([0, 1, 2, 3]) AS pos))"


@query(STATE + _PROBES + "SELECT CAST(w.prefix_id AS BIGINT) AS prefix_id, w.group_idx FROM w SEMI JOIN leaf ON leaf.prefix_id = w.prefix_id AND leaf.group_idx = w.group_idx")
def exists_keys(spark, sf_dir):
    return state.exists(_batches(spark, sf_dir).select(*oplog.ADDRESS), state.leaves(_ops(spark, sf_dir)))


@query(STATE + _PROBES + "SELECT w.prefix_id, w.group_idx FROM w ANTI JOIN leaf ON leaf.prefix_id = w.prefix_id AND leaf.group_idx = w.group_idx")
def absent_keys(spark, sf_dir):
    return state.absent(_batches(spark, sf_dir).select(*oplog.ADDRESS), state.leaves(_ops(spark, sf_dir)))


@query(STATE + _PROBES + """, a AS (SELECT prefix_id, count(*) AS n FROM outcomes WHERE outcome = 'HIT' GROUP BY prefix_id), b AS (SELECT w.prefix_id, count(*) AS n FROM w JOIN leaf USING (prefix_id, group_idx) GROUP BY w.prefix_id)
SELECT prefix_id, coalesce(a.n, 0) AS get_hits, coalesce(b.n, 0) AS probe_hits, coalesce(a.n, 0) + coalesce(b.n, 0) AS hits FROM a FULL JOIN b USING (prefix_id)""")
def lookup_hits(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return state.lookup_hits(ops, _batches(spark, sf_dir).select(*oplog.ADDRESS), state.leaves(ops))


@query(OPS + """, r AS (SELECT prefix_id, group_idx, seq // 2 AS ver, CAST((seq + s) % 2 AS INTEGER) AS slot, payload_len FROM ops, (SELECT unnest([0, 1]) AS s) WHERE op = 'PUT' AND (s = 0 OR seq % 3 = 0)),
n AS (SELECT prefix_id, group_idx, max(ver) AS ver FROM r GROUP BY ALL), h AS (SELECT prefix_id, group_idx, ver, slot, max(payload_len) AS payload_len FROM r JOIN n USING (prefix_id, group_idx, ver) GROUP BY ALL)
SELECT prefix_id, group_idx, ver, count(*) AS slots, CAST(sum(payload_len) AS BIGINT) AS bytes FROM h GROUP BY ALL""")
def published_slots(spark, sf_dir):
    """Two neighbouring PUTs share a version, and each fills one slot, every third one both."""
    rows = _ops(spark, sf_dir).where("op = 'PUT'").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).where("s = 0 OR seq % 3 = 0")
    return state.published(rows.select(*oplog.ADDRESS, F.expr("seq div 2").alias("ver"), ((F.col("seq") + F.col("s")) % 2).cast("int").alias("slot"), "payload_len"))


def _saved(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    tokens = F.transform(F.sequence(F.lit(0), F.col("n").cast("int")), lambda i: (F.col("conv_id") * F.lit(2654435761) + i.cast("long") * F.lit(7919)) % F.lit(2147483647))
    return c.select(F.col("conv_id").alias("sequence_id"), tokens.alias("tokens"), "size")


_SAVED = "SELECT conv_id AS sequence_id, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS size FROM conversations GROUP BY conv_id"


@query(f"SELECT sequence_id, sequence_id % 3 <> 0 AS present, CASE WHEN sequence_id % 3 <> 0 THEN size ELSE -1 END AS payload_len FROM ({_SAVED})")
def saved_sequences(spark, sf_dir):
    """Every conversation is saved, every third one evicted; then all are looked for and restored."""
    saved = _saved(spark, sf_dir)
    puts = sequences.save(saved, F.col("size"), F.lit(100), 1)
    drops = sequences.evict(saved.where("sequence_id % 3 = 0"), F.lit(200), 1 << 60)
    leaf = state.leaves(puts.unionByName(drops))
    back = sequences.restore(saved, leaf).select("sequence_id", F.coalesce("payload_len", F.lit(-1)).cast("long").alias("payload_len"))
    held = sequences.has(saved, leaf).select("sequence_id", F.lit(True).alias("present"))
    return back.join(held, "sequence_id", "left").select("sequence_id", F.coalesce("present", F.lit(False)).alias("present"), "payload_len")


@query(_NODES + "SELECT CAST(depth AS INTEGER) AS depth, address, docs FROM n ORDER BY depth, address LIMIT 100")
def radix_visit(spark, sf_dir):
    """The visitor stops after 100 nodes."""
    return index.visit(index.nodes(_addressed(spark, sf_dir)), 100).select("depth", "address", "docs")


# Stores and files.

@query(PLACED + "SELECT CAST(dev AS INTEGER) AS dev, epoch, count(*) AS records, CAST(sum(payload_len) AS BIGINT) AS bytes FROM located GROUP BY ALL")
def store_journal(spark, sf_dir):
    """The journal is written by device and region, and read back."""
    s = store.Store(spark, store.fresh_folder(spark, "store"))
    s.append_journal(_placed(spark, sf_dir))
    return s.journal().groupBy("dev", F.col("epoch").cast("long").alias("epoch")).agg(F.count(F.lit(1)).alias("records"), F.sum("payload_len").alias("bytes"))


@query(PLACED + "SELECT CAST(dev AS INTEGER) AS dev, count(*) AS records, min(epoch) AS oldest FROM located WHERE NOT (dev = 1 AND epoch = 1) GROUP BY dev")
def store_trim(spark, sf_dir):
    """A region's files are removed; the others are read as before."""
    s = store.Store(spark, store.fresh_folder(spark, "store"))
    s.append_journal(_placed(spark, sf_dir))
    s.trim(1, 1)
    return s.journal().groupBy("dev").agg(F.count(F.lit(1)).alias("records"), F.min(F.col("epoch").cast("long")).alias("oldest"))


@query(STATE + "SELECT count(*) AS leaves, CAST(sum(payload_len) AS BIGINT) AS bytes FROM leaf")
def store_snapshot(spark, sf_dir):
    """Two snapshots are written; the newest is read."""
    s, ops = store.Store(spark, store.fresh_folder(spark, "store")), _ops(spark, sf_dir)
    s.write_snapshot(state.leaves(ops.where("seq % 2 = 0")), 1)
    s.write_snapshot(state.leaves(ops), 2)
    return s.snapshot().agg(F.count(F.lit(1)).alias("leaves"), F.sum("payload_len").alias("bytes"))


@query("SELECT true AS cleared, 0 AS left_over")
def store_clear(spark, sf_dir):
    s = store.Store(spark, store.fresh_folder(spark, "store"))
    s.write_snapshot(state.leaves(_ops(spark, sf_dir)), 1)
    cleared = s.clear()
    return spark.range(1).select(F.lit(cleared).alias("cleared"), F.lit(int(s.clear())).alias("left_over"))


@query(_COUNTERS + "SELECT metric, value FROM (UNPIVOT c ON puts, gets, evicts, hits, misses, evicted_reads, bytes_payload, bytes_written INTO NAME metric VALUE value)")
def metrics_csv(spark, sf_dir):
    path = store.fresh_folder(spark, "metrics")
    store.write_metrics_csv(metrics.as_rows(metrics.counters(state.point_in_time(_ops(spark, sf_dir)))), path)
    return store.read_csv(spark, path, "metric string, value long")


@query(_COUNTERS + "SELECT metric AS key, 'llama-3.1-8b' AS model, value FROM (UNPIVOT c ON puts, gets, evicts, hits, misses, evicted_reads, bytes_payload, bytes_written INTO NAME metric VALUE value)")
def bench_csv(spark, sf_dir):
    path = store.fresh_folder(spark, "bench")
    store.write_bench_csv(metrics.as_rows(metrics.counters(state.point_in_time(_ops(spark, sf_dir)))).withColumnRenamed("metric", "key"), path, "llama-3.1-8b")
    return store.read_csv(spark, path, "key string, model string, value long")


@query("SELECT * FROM (VALUES ('OK', 'GQA', 2::BIGINT, 5120::BIGINT), ('OK', 'MLA', 1, 1152), ('OK', 'MQA', 1, 256), ('EINVAL', '-', 1, 0)) t(rc, kind, files, bytes)")
def config_files(spark, sf_dir):
    """Configurations as files of their own, read whole."""
    path = store.fresh_folder(spark, "configs")
    for number, text in _CONFIGS:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{number}")
    parsed = layout.from_config_json(store.read_config_texts(spark, f"{path}/*"), F.col("json"))
    size = F.when(F.col("rc") == "OK", layout.bytes_per_token_layer()).otherwise(0)
    return parsed.groupBy("rc", F.coalesce("kind", F.lit("-")).alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).cast("long").alias("bytes"))


@query("SELECT place, name, kind, standard FROM (VALUES " + ", ".join(f"({k}, '{n}', '{t}', '{d}')" for k, n, t, d in config.schema_rows()) + ") t(place, name, kind, standard)")
def config_schema(spark, sf_dir):
    return spark.createDataFrame(config.schema_rows(), "place int, name string, kind string, standard string")


# Replay, regions, stripes.

_TRIMS = PLACED + f""", first AS (SELECT dev, epoch, min(seq) AS first_seq FROM located GROUP BY ALL),
trims AS (SELECT a.dev, a.epoch, b.first_seq AS trim_seq FROM first a JOIN first b ON b.dev = a.dev AND b.epoch = a.epoch + {RING})
"""


def _trims(spark, sf_dir):
    return gc.trim_seqs(_placed(spark, sf_dir).groupBy("dev", "epoch").agg(F.min("seq").alias("first_seq")), RING)


@query(_TRIMS + "SELECT * FROM trims")
def region_rotation(spark, sf_dir):
    """A ring of four regions a device: the fifth frees the first, and so on."""
    return _trims(spark, sf_dir)


@query(_TRIMS + "SELECT f.prefix_id, f.group_idx, f.ver FROM leaf f JOIN located l ON l.seq = f.ver ANTI JOIN trims t ON t.dev = l.dev AND t.epoch = l.epoch")
def replay_trims(spark, sf_dir):
    return gc.after_trims(_located_leaves(spark, sf_dir), _trims(spark, sf_dir)).select(*oplog.ADDRESS, "ver")


@query(PLACED + """, cut AS (SELECT max(seq) // 2 AS c FROM ops),
early AS (SELECT prefix_id, group_idx, last.seq AS ver FROM (SELECT prefix_id, group_idx, arg_max({'op': op, 'seq': seq}, seq) AS last FROM ops WHERE op <> 'GET' AND seq <= (SELECT c FROM cut) GROUP BY ALL) WHERE last.op = 'PUT')
SELECT e.prefix_id, e.group_idx, e.ver, coalesce(f.ver = e.ver, false) AS moved FROM early e JOIN ops o ON o.seq = e.ver LEFT JOIN leaf f ON f.prefix_id = e.prefix_id AND f.group_idx = e.group_idx WHERE e.ver % 5 <> 0 AND o.payload_len <= 1048576""")
def compaction_moves(spark, sf_dir):
    """A plan made half way through the log, carried out at its end: newer versions are left alone."""
    ops = _ops(spark, sf_dir)
    cut = ops.agg(F.expr("max(seq) div 2")).scalar()
    plan = state.leaves(ops.where(F.col("seq") <= cut)).where("ver % 5 <> 0 AND payload_len <= 1048576").select(*oplog.ADDRESS, "ver")
    return gc.moved(plan, state.leaves(ops))


@query("""WITH p AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h, greatest(1, (strlen(coalesce(text, '')) + 1023) // 1024) AS parts FROM documents)
SELECT doc_id, CAST(parts AS INTEGER) AS n_parts, CASE WHEN doc_id % 13 = 0 AND parts > 1 THEN 'EREAD' WHEN doc_id % 17 = 0 THEN 'ECRC' ELSE 'OK' END AS rc, CASE WHEN doc_id % 13 = 0 AND parts > 1 THEN '-' WHEN doc_id % 17 = 0 THEN '-' ELSE h END AS digest FROM p""")
def stripe_bytes(spark, sf_dir):
    """Texts cut into parts of 1 KiB; the second part of some is lost, the check of others is wrong."""
    v = F.coalesce("text", F.lit("")).cast("binary")
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), v.alias("v"), F.greatest(F.lit(1), F.ceil(F.length(v) / 1024)).cast("int").alias("n_parts"), (F.crc32(v) + F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0)).alias("crc"))
    cut = d.select("seq", "n_parts", "crc", "v", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    parts = cut.select("seq", "n_parts", "crc", "part", F.expr("substring(v, part * 1024 + 1, 1024)").alias("bytes")).where("NOT (seq % 13 = 0 AND part = 1)")
    back = placement.reassembled_bytes(parts)
    return back.select(F.col("seq").alias("doc_id"), "n_parts", "rc", F.when(F.col("rc") == "OK", F.md5("value")).otherwise("-").alias("digest"))


@query(OPS + "SELECT (day - k) * 86400 AS start_s, op, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM (SELECT now_s // 86400 AS day, op, payload_len FROM ops), (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return streams.available(streams.sliding(streams.read(spark, sf_dir)), "complete")


@query(_PARTS + "SELECT seq, part, part_len FROM parts")
def stripe_parts_table_function(spark, sf_dir):
    """The split as a table function, for use from SQL; ``stripe_parts`` is the same without Python."""
    placement.register_functions(spark)
    _ops(spark, sf_dir).where("op = 'PUT'").createOrReplaceTempView("stripe_puts")
    return spark.sql("SELECT p.seq, t.part, t.part_len FROM stripe_puts p, LATERAL stripe_split(p.payload_len) t")


# Counters.

_FULL = PLACED + f""", c AS (SELECT count(*) FILTER (WHERE op = 'PUT') AS puts, count(*) FILTER (WHERE op = 'GET') AS gets, count(*) FILTER (WHERE op = 'EVICT') AS evicts, count(*) FILTER (WHERE outcome = 'HIT') AS hits,
  count(*) FILTER (WHERE op = 'GET' AND outcome LIKE 'ENOENT%') AS misses, count(*) FILTER (WHERE outcome = 'EVICTED') AS evicted_reads, CAST(sum(payload_len) FILTER (WHERE op = 'PUT') AS BIGINT) AS bytes_payload,
  CAST(sum((payload_len + 4095) // 4096 * 4096) FILTER (WHERE op = 'PUT') AS BIGINT) AS bytes_written, count(*) FILTER (WHERE outcome = 'EINVAL') AS puts_err, max(seq) AS ver FROM outcomes),
r AS (SELECT CAST(sum((written_pages + 63) // 64) AS BIGINT) AS batches, count(*) - count(DISTINCT dev) AS rotations, CAST(sum(live_pages * 4096) AS BIGINT) AS live_bytes, count(DISTINCT {{'d': dev, 'e': epoch % 64}}) AS generations FROM regions),
j AS (SELECT CAST(sum(88) FILTER (WHERE seq % 97 <> 0) AS BIGINT) AS meta_bytes_written, count(*) FILTER (WHERE seq % 97 = 0) AS journal_dropped FROM ops WHERE op <> 'GET'),
s AS (SELECT c.*, (SELECT count(*) FROM leaf) AS leaves, r.*, j.*, 0::BIGINT AS drops, 805306368::BIGINT AS capacity_bytes, round(hits / (hits + misses + evicted_reads), 9) AS hit_ratio, round(bytes_written / bytes_payload, 9) AS waf,
  round((bytes_written + meta_bytes_written) / bytes_payload, 9) AS waf_total, round(bytes_written / batches / 1024, 9) AS avg_batch_kib FROM c, r, j)
"""


def _full(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    lost = F.col("seq") % 97 == 0  # records that found the journal full
    # Records of three lengths and one group.
    journal = ops.where("op <> 'GET'").select(F.when(~lost, durability.record_bytes(F.lit(3), F.lit(1))).otherwise(0).alias("bytes"), lost.cast("long").alias("dropped"))
    return metrics.full_snapshot(state.point_in_time(ops), state.leaves(ops), _regions(spark, sf_dir), journal, 64, 6 * N_DEV * 8192 * 4096)


@query(_FULL + "SELECT * FROM s")
def counters_full(spark, sf_dir):
    return _full(spark, sf_dir)


_KEYS = ("puts", "hits", "misses", "batches", "bytes_written", "rotations", "drops", "leaves", "live_bytes", "capacity_bytes", "generations", "journal_dropped", "ver", "put_reqs", "get_hits")


@query(_FULL + f", v AS (SELECT metric, value FROM (UNPIVOT (SELECT puts, hits, misses, batches, bytes_written, rotations, drops, leaves, live_bytes, capacity_bytes, generations, journal_dropped, ver FROM s) ON COLUMNS(*) INTO NAME metric VALUE value)) SELECT k.metric, coalesce(v.value, 0) AS value FROM (SELECT unnest({list(_KEYS)}) AS metric) k LEFT JOIN v ON v.metric = k.metric")
def counter_values(spark, sf_dir):
    """Counters asked by name; names that there are not give 0."""
    known = [k for k in _KEYS if k not in ("put_reqs", "get_hits")]
    rows = _full(spark, sf_dir).select(*[F.col(k).cast("long").alias(k) for k in known]).unpivot([], known, "metric", "value")
    return metrics.value_of(rows, spark.createDataFrame([(k,) for k in _KEYS], "metric string"))


@query(_FULL + "SELECT journal_dropped, CASE WHEN journal_dropped > 0 THEN 'journal overflow: ' || journal_dropped || ' records dropped' ELSE '' END AS alarm FROM s")
def overflow_alarm(spark, sf_dir):
    return metrics.overflow_alarm(_full(spark, sf_dir))


@query(OPS + """, d AS (SELECT now_s // 86400 AS day, count(*) FILTER (WHERE op = 'PUT') AS d_puts, count(*) FILTER (WHERE op = 'GET') AS d_gets, CAST(coalesce(sum(payload_len) FILTER (WHERE op = 'PUT'), 0) AS BIGINT) AS d_bytes, max(now_s) - min(now_s) AS secs FROM ops GROUP BY ALL)
SELECT *, CASE WHEN secs > 0 THEN round(d_puts / secs, 6) ELSE 0 END AS put_iops, CASE WHEN secs > 0 THEN round(d_gets / secs, 6) ELSE 0 END AS get_iops, CASE WHEN secs > 0 THEN round(d_bytes / 1048576 / secs, 6) ELSE 0 END AS w_mibps FROM d""")
def phase_rates(spark, sf_dir):
    size = F.coalesce(F.sum(F.when(F.col("op") == "PUT", F.col("payload_len"))), F.lit(0))
    per = _ops(spark, sf_dir).groupBy(F.expr("now_s div 86400").alias("day")).agg(
        F.count_if(F.col("op") == "PUT").alias("d_puts"), F.count_if(F.col("op") == "GET").alias("d_gets"), size.alias("d_bytes"), (F.max("now_s") - F.min("now_s")).alias("secs"))
    return metrics.rates(per, F.col("secs"))


@query(STATE + "SELECT op, CAST(log2_b AS INTEGER) AS bucket, count(*) AS n, CAST(sum((payload_len + 4095) // 4096) AS BIGINT) AS pages FROM (SELECT *, CASE WHEN payload_len <= 0 THEN 0 ELSE least(31, length(bin(payload_len)) - 1) END AS log2_b FROM ops) GROUP BY ALL")
def sql_views(spark, sf_dir):
    """The views and functions, from SQL."""
    views.register(spark, sf_dir, "stats_")
    return spark.sql("SELECT op, log2_bucket(payload_len) AS bucket, count(*) AS n, sum(payload_pages(payload_len)) AS pages FROM stats_ops GROUP BY ALL")


@query("SELECT 0::BIGINT AS false_negatives, true AS few_false_positives")
def cuckoo_quality(spark, sf_dir):
    """Of all orders against the customers of one segment: none is lost, less than a tenth of the others pass."""
    keys = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    truth = orders.join(keys.withColumnRenamed("c_custkey", "o_custkey").withColumn("member", F.lit(True)), "o_custkey", "left")
    passed = cuckoo.maybe_in(orders, F.col("o_custkey"), keys, "c_custkey").select("o_orderkey", F.lit(True).alias("passed"))
    both = truth.join(passed, "o_orderkey", "left")
    return both.agg(
        F.count_if(F.col("member") & F.col("passed").isNull()).alias("false_negatives"),
        (F.count_if(F.col("member").isNull() & F.col("passed")) <= F.lit(0.1) * F.count_if(F.col("member").isNull())).alias("few_false_positives"))
