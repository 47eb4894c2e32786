"""The queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import chunk, cuckoo, hashing, layout, metrics
from palimpsest.operators import alloc, durability, gc, index, oplog, placement, state, tier, tokens
from palimpsest.operators.running import running_sum
from palimpsest.sources import workload
from palimpsest.streaming import streams

QUERIES: dict = {}
ORACLES: dict = {}
N_DEV, REGION_PAGES = 4, 8192


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OPS = "WITH " + oplog.SQL
STATE = OPS + "," + state.SQL
PLACED = STATE + f""",
placed AS (SELECT *, CAST((payload_len + 4095) // 4096 AS BIGINT) AS pages, CAST(prefix_id % {N_DEV} AS INTEGER) AS dev FROM ops WHERE op = 'PUT'),
spot AS (SELECT *, coalesce(CAST(sum(pages) OVER (PARTITION BY dev ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start_page FROM placed),
located AS (SELECT *, 1 + start_page // {REGION_PAGES} AS epoch FROM spot),
regions AS (SELECT l.dev, l.epoch, CAST(sum(l.pages) AS BIGINT) AS written_pages, CAST(coalesce(sum(CASE WHEN f.ver IS NOT NULL THEN l.pages END), 0) AS BIGINT) AS live_pages,
            count(f.ver) AS leaves, min(l.now_s) AS base_s, max(l.now_s) AS close_s FROM located l LEFT JOIN leaf f ON f.ver = l.seq GROUP BY ALL),
states AS (SELECT *, live_pages * 4096 AS live_bytes, CASE WHEN epoch = max(epoch) OVER (PARTITION BY dev) THEN 'OPEN' ELSE 'FROZEN' END AS state FROM regions)
"""


def _ops(spark, sf_dir):
    return oplog.read(spark, sf_dir)


def _placed(spark, sf_dir):
    return placement.with_regions(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV, REGION_PAGES)


def _regions(spark, sf_dir):
    return placement.live_bytes(_placed(spark, sf_dir), state.leaves(_ops(spark, sf_dir)))


def _now(spark, sf_dir):
    return _ops(spark, sf_dir).agg(F.max("now_s")).scalar()


# Point operations over the log.

@query(STATE + "SELECT op, outcome, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE payload_len > 1048576) AS striped FROM outcomes GROUP BY ALL")
def op_outcomes(spark, sf_dir):
    return state.outcome_counts(_ops(spark, sf_dir))


@query(STATE + """SELECT prefix_id, count(*) FILTER (WHERE outcome = 'HIT') AS hits, count(*) FILTER (WHERE outcome LIKE 'ENOENT%') AS misses, count(*) FILTER (WHERE outcome = 'EVICTED') AS evicted,
round(count(*) FILTER (WHERE outcome = 'HIT') / count(*), 9) AS hit_ratio FROM outcomes WHERE op = 'GET' GROUP BY ALL""")
def op_outcome_by_prefix(spark, sf_dir):
    return state.outcomes_by_prefix(_ops(spark, sf_dir))


@query(OPS + "SELECT seq, CASE WHEN group_idx < 0 OR group_idx >= 256 OR (op = 'PUT' AND (payload_len // 64 % 300 < 1 OR payload_len // 64 % 300 > 256)) THEN 'EINVAL' ELSE 'OK' END AS rc_name FROM ops")
def put_validation(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return oplog.validated(ops, F.expr("payload_len div 64 % 300")).select("seq", "rc_name")


@query(STATE + "SELECT * FROM leaf")
def leaf_state(spark, sf_dir):
    return state.leaves(_ops(spark, sf_dir))


@query(OPS + "SELECT seq, prefix_id, group_idx, CAST(row_number() OVER w AS INTEGER) AS address_ver, lead(seq) OVER w IS NULL AS is_newest FROM ops WHERE op = 'PUT' WINDOW w AS (PARTITION BY prefix_id, group_idx ORDER BY seq)")
def put_versions(spark, sf_dir):
    return state.versions(_ops(spark, sf_dir))


@query(STATE + "SELECT prefix_id, min(seq) AS first_seq, count(*) AS evictions FROM outcomes WHERE op = 'EVICT' AND outcome = 'OK' AND prefix_id <> 0 GROUP BY ALL")
def tombstones(spark, sf_dir):
    return state.tombstones(_ops(spark, sf_dir))


@query(OPS + "SELECT prefix_id, group_idx, min(seq) AS seq, arg_min(payload_len, seq) AS payload_len, count(*) - 1 AS skipped FROM ops WHERE op = 'PUT' GROUP BY ALL")
def first_write_wins(spark, sf_dir):
    return state.first_write_wins(_ops(spark, sf_dir))


@query(STATE + "SELECT seq, prefix_id, group_idx, seen.seq AS ver, seen.payload_len AS freed_bytes FROM outcomes WHERE op = 'EVICT' AND outcome = 'OK'")
def leaf_drops(spark, sf_dir):
    return state.dropped_leaves(_ops(spark, sf_dir))


@query(STATE + "SELECT prefix_id, group_idx, ver, expire_ts FROM leaf WHERE expire_ts <> 0 AND expire_ts < (SELECT max(now_s) FROM ops)")
def expired_at(spark, sf_dir):
    return state.expired_leaves(_ops(spark, sf_dir))


@query(STATE + "SELECT prefix_id, group_idx, ver FROM leaf WHERE NOT (expire_ts <> 0 AND expire_ts < (SELECT max(now_s) FROM ops) AND ver % 7 <> 0)")
def ttl_sweep(spark, sf_dir):
    return state.sweep(state.leaves(_ops(spark, sf_dir)), _now(spark, sf_dir), F.col("ver") % 7 == 0).select(*oplog.ADDRESS, "ver")


def _pins(spark, sf_dir):
    """A view pins its prefix until the user's next click."""
    e = _table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    ends = e.select((F.col("user_id") + 1).alias("pin_prefix"), F.col("event_id").alias("pin_start"), "event_type", F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).over(w).alias("pin_end"))
    return ends.where("event_type = 'view' AND pin_end IS NOT NULL").select("pin_prefix", "pin_start", "pin_end")


@query(STATE + """, e AS (SELECT user_id + 1 AS p, event_id AS a, event_type, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM events WHERE event_type IN ('view', 'click')),
pins AS (SELECT p, a, b FROM e WHERE event_type = 'view' AND b IS NOT NULL)
SELECT seq, prefix_id, group_idx, CASE WHEN NOT live THEN 'ENOENT' WHEN EXISTS (SELECT 1 FROM pins WHERE p = prefix_id AND seq > a AND seq < b) THEN 'EBUSY' ELSE 'OK' END AS outcome FROM outcomes WHERE op = 'EVICT'""")
def pinned_evict(spark, sf_dir):
    return state.pinned_evictions(_ops(spark, sf_dir), _pins(spark, sf_dir))


def _batches(spark, sf_dir):
    prefixes = _ops(spark, sf_dir).select("prefix_id").distinct()
    return prefixes.select(F.col("prefix_id").alias("batch"), "prefix_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).withColumn("group_idx", F.col("pos"))


@query(STATE + """, w AS (SELECT prefix_id AS batch, prefix_id, pos FROM (SELECT DISTINCT prefix_id FROM ops), (SELECT unnest([0, 1, 2, 3]) AS pos)),
j AS (SELECT w.*, leaf.ver FROM w LEFT JOIN leaf ON leaf.prefix_id = w.prefix_id AND leaf.group_idx = w.pos)
SELECT batch, CAST(coalesce(min(CASE WHEN ver IS NULL THEN pos END), 4) AS INTEGER) AS prefix_len, count(ver) AS present, count(*) AS asked FROM j GROUP BY batch""")
def batch_exists(spark, sf_dir):
    return state.batch_exists(_batches(spark, sf_dir), state.leaves(_ops(spark, sf_dir)))


@query(STATE + """, w AS (SELECT prefix_id AS batch, prefix_id, pos FROM (SELECT DISTINCT prefix_id FROM ops), (SELECT unnest([0, 1, 2, 3]) AS pos))
SELECT batch, string_agg(coalesce(CAST(ver AS VARCHAR), '-'), ',' ORDER BY pos) AS vers FROM w LEFT JOIN leaf ON leaf.prefix_id = w.prefix_id AND leaf.group_idx = w.pos GROUP BY batch""")
def batch_get(spark, sf_dir):
    return state.batch_get(_batches(spark, sf_dir), state.leaves(_ops(spark, sf_dir)))


@query(OPS + """, p AS (SELECT prefix_id AS batch, CAST(row_number() OVER (PARTITION BY prefix_id ORDER BY seq) - 1 AS INTEGER) AS pos, seq, payload_len FROM ops WHERE op = 'PUT'),
f AS (SELECT batch, min(CASE WHEN payload_len > 900000 THEN pos END) AS failed_at FROM p GROUP BY batch) SELECT p.batch, pos, seq FROM p JOIN f USING (batch) WHERE failed_at IS NULL OR pos < failed_at""")
def batch_set(spark, sf_dir):
    puts = _ops(spark, sf_dir).where("op = 'PUT'").select(F.col("prefix_id").alias("batch"), (F.row_number().over(Window.partitionBy("prefix_id").orderBy("seq")) - 1).alias("pos"), "seq", "payload_len")
    return state.batch_set(puts, F.col("payload_len") <= 900000).select("batch", "pos", "seq")


@query(STATE + "SELECT seq, prefix_id, group_idx FROM outcomes WHERE outcome = 'HIT' AND seen.payload_len = payload_len // 4096 * 4096")
def get_into_target(spark, sf_dir):
    return state.get_into(state.point_in_time(_ops(spark, sf_dir)), F.expr("payload_len div 4096 * 4096")).select("seq", *oplog.ADDRESS)


@query(OPS + """, p AS (SELECT seq AS put, payload_len, unnest(range(0, CASE WHEN payload_len > 1048576 THEN (payload_len + 262143) // 262144 ELSE 1 END)) AS part FROM ops WHERE op = 'PUT'),
r AS (SELECT put, part, max(part) OVER (PARTITION BY put) + 1 AS n_parts, CASE WHEN (put + part) % 11 = 0 THEN -5 ELSE 0 END AS rc FROM p)
SELECT put, CAST(coalesce(arg_min(rc, part) FILTER (WHERE rc <> 0), 0) AS INTEGER) AS rc, CAST(max(n_parts) AS INTEGER) AS n_parts FROM r WHERE (put + part) % 97 <> 0 GROUP BY put HAVING count(*) = max(n_parts)""")
def put_acks(spark, sf_dir):
    parts = placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV)
    rows = parts.select(F.col("seq").alias("put"), "part", "n_parts", F.when((F.col("seq") + F.col("part")) % 11 == 0, -5).otherwise(0).alias("rc"))
    return state.acks(rows.where("(put + part) % 97 <> 0"))


@query(STATE + """, lim AS (SELECT max(seq) // 2 AS cut FROM ops),
late AS (SELECT *, coalesce(max(CASE WHEN op = 'EVICT' AND live AND seq > (SELECT cut FROM lim) THEN 1 END) OVER (PARTITION BY prefix_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS lt FROM outcomes)
SELECT op, CASE WHEN outcome = 'EVICTED' AND NOT lt THEN 'ENOENT' ELSE outcome END AS outcome, count(*) AS n FROM late WHERE seq > (SELECT cut FROM lim) GROUP BY ALL""")
def reopen_outcomes(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    cut = ops.agg(F.max("seq").alias("m")).first().m // 2
    return state.reopened(ops, cut).groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON o_custkey = c_custkey")
def membership_semi(spark, sf_dir):
    return _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def membership_anti(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey").join(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Token groups and content addresses.

@query("SELECT doc_id, (len(string_split(text, ' ')) + 31) // 32 AS groups, len(string_split(text, ' ')) // 32 AS full_groups, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_tokens FROM documents")
def token_groups(spark, sf_dir):
    g = tokens.split_groups(_table(spark, sf_dir, "documents"), tokens.tokens_of(), "doc_id")
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n_tokens") == 32).alias("full_groups"), F.sum("n_tokens").alias("n_tokens"))


def _addressed(spark, sf_dir, *keep):
    return tokens.addresses(_table(spark, sf_dir, "documents"), tokens.tokens_of(), *(keep or ("doc_id",)))


_GROUPS = "WITH " + tokens.sql("SELECT doc_id, lang, string_split(text, ' ') AS tokens FROM documents", "doc_id, lang")


@query(_GROUPS + "SELECT address, CAST(group_idx AS INTEGER) AS group_idx, count(*) AS copies, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM g GROUP BY ALL")
def content_addresses(spark, sf_dir):
    return tokens.shared_addresses(_addressed(spark, sf_dir))


@query(_GROUPS + "SELECT lang, CAST(sum(n) AS BIGINT) AS pages, count(*) AS distinct_pages, round(count(*) / sum(n), 9) AS distinct_ratio FROM (SELECT lang, address, count(*) AS n FROM g GROUP BY ALL) GROUP BY lang")
def prefix_sharing(spark, sf_dir):
    return tokens.sharing_by(_addressed(spark, sf_dir, "doc_id", "lang"), "lang")


@query(_GROUPS + """, s AS (SELECT address, min(doc_id) AS first FROM g GROUP BY address)
SELECT doc_id, count(*) AS groups, coalesce(min(CASE WHEN s.first >= doc_id THEN group_idx END), count(*)) AS stored_prefix FROM g JOIN s USING (address) GROUP BY doc_id""")
def stored_longest_prefix(spark, sf_dir):
    return tokens.stored_before(_addressed(spark, sf_dir))


def _dialogue(spark, sf_dir):
    """Each turn with the tokens of all turns up to it; a conversation's turns are few."""
    c = _table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.split(F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), " "), " ").alias("tokens"))


_TALK = "WITH " + tokens.sql("SELECT conv_id, turn, string_split(string_agg(coalesce(text, ''), ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ' ') AS tokens FROM conversations", "conv_id, turn") + """,
seen AS (SELECT conv_id, address, min(turn) AS first_turn FROM g GROUP BY ALL),
growth AS (SELECT g.conv_id, g.turn, count(*) AS groups, count(*) FILTER (WHERE first_turn < g.turn) AS reused FROM g JOIN seen USING (conv_id, address) GROUP BY ALL)
"""


def _growth(spark, sf_dir):
    a = tokens.addresses(_dialogue(spark, sf_dir), F.col("tokens"), "conv_id", "turn")
    first = a.groupBy("conv_id", "address").agg(F.min("turn").alias("first_turn"))
    return a.join(first, ["conv_id", "address"]).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("first_turn") < F.col("turn")).alias("reused"))


@query(_TALK + "SELECT * FROM growth")
def conversation_prefix_growth(spark, sf_dir):
    return _growth(spark, sf_dir)


@query(_TALK + ", p AS (SELECT 'llama-3.1-8b' AS name, 4194304::BIGINT AS group_bytes UNION ALL SELECT 'deepseek-v3', 2248704) SELECT name, CAST(sum(reused) * any_value(group_bytes) AS BIGINT) AS saved_bytes, CAST(sum(groups) AS BIGINT) AS groups FROM growth, p GROUP BY name")
def conversation_cache_savings(spark, sf_dir):
    total = _growth(spark, sf_dir).agg(F.sum("reused").alias("reused"), F.sum("groups").alias("groups"))
    models = layout.with_bytes(layout.presets(spark)).where("name IN ('llama-3.1-8b', 'deepseek-v3')")
    return models.crossJoin(F.broadcast(total)).select("name", (F.col("reused") * F.col("group_bytes")).alias("saved_bytes"), "groups")


# Prefix index.

_NODES = _GROUPS + ", n AS (SELECT c.address, p.address AS parent, min(c.group_idx + 1) AS depth, count(*) AS docs FROM g c LEFT JOIN g p ON p.doc_id = c.doc_id AND p.group_idx = c.group_idx - 1 GROUP BY ALL)\n"


@query(_NODES + "SELECT CAST(depth AS INTEGER) AS depth, count(*) AS nodes, CAST(sum(docs) AS BIGINT) AS visits FROM n GROUP BY depth")
def radix_nodes(spark, sf_dir):
    return index.nodes_by_depth(index.nodes(_addressed(spark, sf_dir)))


@query(_NODES + "SELECT children, count(*) AS nodes, children > 8 AS overflow FROM (SELECT parent, count(*) AS children FROM n GROUP BY parent) GROUP BY ALL")
def radix_fanout(spark, sf_dir):
    return index.fanout(index.nodes(_addressed(spark, sf_dir)))


_HITS = STATE + """, per AS (SELECT prefix_id, group_idx, count(*) AS n FROM outcomes WHERE outcome = 'HIT' GROUP BY ALL),
spread AS (SELECT prefix_id, n, unnest(range(0, group_idx + 2)) AS depth FROM per),
cnt AS (SELECT CASE WHEN depth > 0 THEN prefix_id ELSE 0 END AS prefix_id, CAST(depth AS INTEGER) AS depth, CAST(sum(n) AS BIGINT) AS hits FROM spread GROUP BY ALL)
"""


def _hits(spark, sf_dir):
    return index.ascended_hits(state.point_in_time(_ops(spark, sf_dir)).where("outcome = 'HIT'"))


@query(_HITS + "SELECT * FROM cnt")
def radix_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(_HITS + """, t AS (SELECT prefix_id, depth - 1 AS group_idx FROM cnt WHERE depth > 0)
SELECT t.prefix_id, group_idx, coalesce(a.hits, 0) AS parent_hits, coalesce(b.hits, 0) AS grand_hits, coalesce(a.hits, 0) > 3 OR coalesce(b.hits, 0) > 3 AS hot FROM t
LEFT JOIN cnt a ON a.depth = t.group_idx AND a.prefix_id = CASE WHEN t.group_idx > 0 THEN t.prefix_id ELSE 0 END
LEFT JOIN cnt b ON b.depth = t.group_idx - 1 AND b.prefix_id = CASE WHEN t.group_idx - 1 > 0 THEN t.prefix_id ELSE 0 END""")
def hot_paths(spark, sf_dir):
    return index.hot_paths(_hits(spark, sf_dir), 3)


@query(STATE + "SELECT prefix_id, count(*) AS hits, count(*) // 2 AS decayed, count(*) // 8 AS decayed_3 FROM outcomes WHERE outcome = 'HIT' GROUP BY prefix_id")
def hit_decay_tick(spark, sf_dir):
    h = state.point_in_time(_ops(spark, sf_dir)).where("outcome = 'HIT'").groupBy("prefix_id").agg(F.count(F.lit(1)).alias("hits"))
    return h.select("prefix_id", "hits", index.decayed(F.col("hits"), F.lit(1)).alias("decayed"), index.decayed(F.col("hits"), F.lit(3)).alias("decayed_3"))


@query(STATE + """, per AS (SELECT prefix_id, now_s // 86400 AS tick, count(*) AS hits FROM outcomes WHERE outcome = 'HIT' GROUP BY ALL),
steps AS (SELECT prefix_id, list({'t': tick, 'c': hits} ORDER BY tick) AS s FROM per GROUP BY prefix_id)
SELECT prefix_id, f.t AS last_tick, f.c AS hits FROM (SELECT prefix_id, list_reduce(s, lambda a, b: {'t': b.t, 'c': (a.c >> CAST(least(62, b.t - a.t) AS BIGINT)) + b.c}) AS f FROM steps)""")
def hit_decay(spark, sf_dir):
    hits = state.point_in_time(_ops(spark, sf_dir)).where("outcome = 'HIT'").groupBy("prefix_id", F.expr("now_s div 86400").alias("tick")).agg(F.count(F.lit(1)).alias("hits"))
    return index.decay_by_tick(hits, "prefix_id")


# Placement.

@query(OPS + "SELECT seq, (payload_len + 4095) // 4096 AS pages, (payload_len + 8 * 4 + 64 + 4095) // 4096 AS framed FROM ops WHERE op = 'PUT'")
def payload_pages(spark, sf_dir):
    return _ops(spark, sf_dir).where("op = 'PUT'").select("seq", placement.payload_pages(F.col("payload_len")).alias("pages"), placement.framed_pages(F.col("payload_len"), F.lit(4)).alias("framed"))


_PARTS = OPS + f""", n AS (SELECT seq, prefix_id, payload_len, CAST(CASE WHEN payload_len > 1048576 THEN (payload_len + 262143) // 262144 ELSE 1 END AS INTEGER) AS n_parts FROM ops WHERE op = 'PUT'),
parts AS (SELECT seq, n_parts, CAST(part AS INTEGER) AS part, CASE WHEN n_parts = 1 THEN payload_len ELSE least(262144, payload_len - part * 262144) END AS part_len,
          CAST((prefix_id % {N_DEV} + part) % {N_DEV} AS INTEGER) AS dev FROM (SELECT *, unnest(range(0, n_parts)) AS part FROM n))
"""


@query(_PARTS + "SELECT seq, part, part_len, dev FROM parts")
def stripe_parts(spark, sf_dir):
    return placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV).select("seq", "part", "part_len", "dev")


@query(_PARTS + "SELECT dev, count(*) AS parts, CAST(sum(part_len) AS BIGINT) AS bytes, CAST(sum((part_len + 4095) // 4096) AS BIGINT) AS pages FROM parts GROUP BY dev")
def stripe_balance(spark, sf_dir):
    return placement.stripe_balance(placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV))


@query(_PARTS + "SELECT seq, max(n_parts) AS n_parts, count(DISTINCT part) AS have, CAST(sum(part_len) AS BIGINT) AS bytes, CASE WHEN count(DISTINCT part) = max(n_parts) THEN 'OK' ELSE 'EREAD' END AS rc FROM parts WHERE (seq + part) % 13 <> 0 GROUP BY seq")
def stripe_reassembly(spark, sf_dir):
    return placement.reassembled(placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV).where("(seq + part) % 13 <> 0"))


@query(_HITS + f""", hot AS (SELECT prefix_id FROM cnt WHERE depth = 1 AND hits > 3)
SELECT seq, CAST(slot AS INTEGER) AS slot, CAST((prefix_id % {N_DEV} + slot) % {N_DEV} AS INTEGER) AS dev FROM (
  SELECT seq, prefix_id, unnest(range(0, CASE WHEN prefix_id IN (SELECT prefix_id FROM hot) AND payload_len <= 1048576 THEN 2 ELSE 1 END)) AS slot FROM ops WHERE op = 'PUT')""")
def replica_writes(spark, sf_dir):
    hot = _hits(spark, sf_dir).where("depth = 1 AND hits > 3").select("prefix_id", F.lit(True).alias("is_hot"))
    puts = _ops(spark, sf_dir).where("op = 'PUT'").join(hot, "prefix_id", "left")
    return placement.replicas(puts, F.coalesce("is_hot", F.lit(False)), N_DEV).select("seq", "slot", "dev")


@query(OPS + """, s AS (SELECT seq, unnest([0, 1]) AS slot FROM ops WHERE op = 'PUT')
SELECT seq, CAST(coalesce(min(CASE WHEN (seq * 3 + slot) % 5 <> 0 AND seq % 50 <> 0 THEN slot END), -1) AS INTEGER) AS slot, CASE WHEN count(CASE WHEN (seq * 3 + slot) % 5 <> 0 AND seq % 50 <> 0 THEN 1 END) = 0 THEN 'EREAD' ELSE 'OK' END AS rc FROM s GROUP BY seq""")
def replica_fallback(spark, sf_dir):
    slots = _ops(spark, sf_dir).where("op = 'PUT'").select("seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"))
    return placement.replica_read(slots.withColumn("valid", F.expr("(seq * 3 + slot) % 5 <> 0 AND seq % 50 <> 0")))


def _records(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("layer"), (F.col("l_quantity").cast("long") % 4 * 1024 + 256).alias("len"))


_RECORDS = "WITH r AS (SELECT l_orderkey, l_linenumber AS layer, CAST(l_quantity AS BIGINT) % 4 * 1024 + 256 AS len FROM lineitem) "


@query(_RECORDS + ", v AS (SELECT l_orderkey, list(len ORDER BY layer, len) AS lens FROM r GROUP BY l_orderkey) SELECT array_to_string(lens, ',') AS shape, CAST(len(lens) AS INTEGER) AS n_records, list_min(lens) = list_max(lens) AS uniform, count(*) AS uses FROM v GROUP BY lens")
def shape_dictionary(spark, sf_dir):
    return placement.shapes(_records(spark, sf_dir), "l_orderkey")


@query(_RECORDS + "SELECT l_orderkey, layer, CAST(coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY layer, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, len FROM r")
def record_offsets(spark, sf_dir):
    return placement.record_offsets(_records(spark, sf_dir), "l_orderkey")


@query("SELECT doc_id, left(text, 16) AS head, substr(text, 17) AS body FROM documents")
def layer_projection(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", placement.layer_slice(F.col("text"), F.lit(0), F.lit(16)).alias("head"), placement.layer_slice(F.col("text"), F.lit(16), F.length("text")).alias("body"))


@query(OPS + """SELECT seq, CAST(CASE WHEN c <= 4096 THEN 0 WHEN c <= 16384 THEN 1 WHEN c <= 65536 THEN 2 WHEN c <= 262144 THEN 3 WHEN c <= 1048576 THEN 4 WHEN c <= 8388608 THEN 5 ELSE -1 END AS INTEGER) AS class, c AS cost FROM (SELECT seq, 56 + 12 * 4 + payload_len AS c FROM ops WHERE op = 'PUT')""")
def entry_classes(spark, sf_dir):
    cost = tier.entry_cost(F.lit(4), F.col("payload_len"))
    return _ops(spark, sf_dir).where("op = 'PUT'").select("seq", tier.size_class(cost).alias("class"), cost.alias("cost"))


@query(OPS + "SELECT seq, dev, CAST(sum(pages) OVER (PARTITION BY dev ORDER BY seq ROWS UNBOUNDED PRECEDING) // 16 AS BIGINT) AS flushes, row_number() OVER (PARTITION BY dev ORDER BY seq) AS backlog FROM (SELECT seq, (payload_len + 4095) // 4096 AS pages, CAST(prefix_id % 4 AS INTEGER) AS dev FROM ops WHERE op = 'PUT')")
def writer_queue(spark, sf_dir):
    p = _ops(spark, sf_dir).where("op = 'PUT'").select("seq", placement.payload_pages(F.col("payload_len")).alias("pages"), placement.device(F.col("prefix_id"), N_DEV).alias("dev"))
    both = running_sum(running_sum(p, ["dev"], F.col("pages"), "so_far"), ["dev"], F.lit(1), "backlog")
    return both.select("seq", "dev", F.floor(F.col("so_far") / alloc.WATERMARK_PAGES).alias("flushes"), "backlog")


# Metrics.

_COUNTERS = STATE + """, c AS (SELECT count(*) FILTER (WHERE op = 'PUT') AS puts, count(*) FILTER (WHERE op = 'GET') AS gets, count(*) FILTER (WHERE op = 'EVICT') AS evicts, count(*) FILTER (WHERE outcome = 'HIT') AS hits,
count(*) FILTER (WHERE op = 'GET' AND outcome LIKE 'ENOENT%') AS misses, count(*) FILTER (WHERE outcome = 'EVICTED') AS evicted_reads, CAST(coalesce(sum(payload_len) FILTER (WHERE op = 'PUT'), 0) AS BIGINT) AS bytes_payload,
CAST(coalesce(sum((payload_len + 4095) // 4096 * 4096) FILTER (WHERE op = 'PUT'), 0) AS BIGINT) AS bytes_written FROM outcomes)
"""


def _counters(spark, sf_dir):
    return metrics.counters(state.point_in_time(_ops(spark, sf_dir)))


@query(_COUNTERS + "SELECT *, round(hits / (hits + misses + evicted_reads), 9) AS hit_ratio, round(bytes_written / bytes_payload, 9) AS waf FROM c")
def metrics_snapshot(spark, sf_dir):
    return metrics.snapshot(_counters(spark, sf_dir))


@query(_COUNTERS + "SELECT metric, value FROM (UNPIVOT c ON puts, gets, evicts, hits, misses, evicted_reads, bytes_payload, bytes_written INTO NAME metric VALUE value)")
def metrics_rows(spark, sf_dir):
    return metrics.as_rows(_counters(spark, sf_dir))


@query(PLACED + "SELECT round(CAST(sum(pages) AS BIGINT) * 4096 / CAST(sum(payload_len) AS BIGINT), 9) AS waf, CAST(sum(pages) * 4096 AS BIGINT) AS bytes_written, CAST(sum(payload_len) AS BIGINT) AS bytes_payload FROM placed")
def waf(spark, sf_dir):
    t = _placed(spark, sf_dir).agg(F.sum("pages").alias("p"), F.sum("payload_len").alias("bytes_payload"))
    return t.select(F.round(metrics.ratio(F.col("p") * 4096, F.col("bytes_payload")), 9).alias("waf"), (F.col("p") * 4096).alias("bytes_written"), "bytes_payload")


@query(PLACED + "SELECT CAST(dev AS VARCHAR) AS device, count(*) AS puts, CAST(sum(payload_len) AS BIGINT) AS bytes, CAST(sum(pages) AS BIGINT) AS pages FROM placed GROUP BY dev UNION ALL SELECT 'all', count(*), CAST(sum(payload_len) AS BIGINT), CAST(sum(pages) AS BIGINT) FROM placed")
def device_rollup(spark, sf_dir):
    r = _placed(spark, sf_dir).rollup("dev").agg(F.count(F.lit(1)).alias("puts"), F.sum("payload_len").alias("bytes"), F.sum("pages").alias("pages"))
    return r.select(F.coalesce(F.col("dev").cast("string"), F.lit("all")).alias("device"), "puts", "bytes", "pages")


_HIST = """WITH s AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) * 10000 AS ns FROM events),
h AS (SELECT event_type, CAST(CASE WHEN ns <= 0 THEN 0 ELSE least(31, length(bin(ns)) - 1) END AS INTEGER) AS bucket, count(*) AS n, CAST(sum(ns) AS BIGINT) AS total, min(ns) AS least, max(ns) AS most FROM s GROUP BY ALL),
m AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total, min(least) FILTER (WHERE least > 0) AS least, max(most) AS most FROM h GROUP BY bucket)
"""


def _hist(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", (F.round(F.col("value") * 100).cast("long") * 10000).alias("ns"))
    return metrics.histogram(e, F.col("ns"), "event_type")


@query(_HIST + "SELECT * FROM h")
def latency_hist(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(_HIST + "SELECT * FROM m")
def hist_merge(spark, sf_dir):
    return metrics.merged(_hist(spark, sf_dir))


@query(_HIST + """, r AS (SELECT event_type, bucket, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS BIGINT) AS cum, CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS tot FROM h),
p AS (SELECT event_type, p, min(bucket) AS b FROM r, (SELECT unnest([1, 25, 50, 90, 99, 100]) AS p) WHERE cum >= (tot * p + 99) // 100 GROUP BY ALL)
SELECT event_type, p, CASE WHEN b >= 31 THEN 2147483648 ELSE CAST(1 AS BIGINT) << CAST(b + 1 AS BIGINT) END AS value FROM p""")
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(_hist(spark, sf_dir), [1, 25, 50, 90, 99, 100], "event_type")


@query(_HIST + "SELECT event_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) // CAST(sum(n) AS BIGINT) AS avg, max(most) AS most FROM h GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return metrics.summary(_hist(spark, sf_dir), "event_type")


@query(_HIST + "SELECT bucket, n, repeat('#', CAST((n * 40 + (max(n) OVER ()) - 1) // (max(n) OVER ()) AS INTEGER)) AS bar FROM m")
def histogram_bars(spark, sf_dir):
    return metrics.bars(metrics.merged(_hist(spark, sf_dir))).select("bucket", "n", "bar")


@query("""WITH s AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) * 10000 AS ns FROM events)
SELECT event_id, CASE WHEN ns < 1000 THEN ns || 'ns' WHEN ns < 1000000 THEN (ns // 1000) || '.' || (ns // 100 % 10) || 'us' WHEN ns < 1000000000 THEN (ns // 1000000) || '.' || (ns // 100000 % 10) || 'ms' ELSE (ns // 1000000000) || '.' || (ns // 100000000 % 10) || 's' END AS shown FROM s""")
def format_latency(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", metrics.format_ns(F.round(F.col("value") * 100).cast("long") * 10000).alias("shown"))


@query(STATE + """, d AS (SELECT now_s // 86400 AS day, count(*) AS n, count(*) FILTER (WHERE outcome = 'HIT') AS h FROM outcomes GROUP BY ALL),
cu AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS ops, CAST(sum(h) OVER (ORDER BY day) AS BIGINT) AS hits FROM d)
SELECT day, ops - coalesce(lag(ops) OVER (ORDER BY day), 0) AS d_ops, hits - coalesce(lag(hits) OVER (ORDER BY day), 0) AS d_hits FROM cu""")
def phase_deltas(spark, sf_dir):
    per = state.point_in_time(_ops(spark, sf_dir)).groupBy(F.expr("now_s div 86400").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "HIT").alias("h"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return metrics.phase_deltas(per.select("day", F.sum("n").over(w).alias("ops"), F.sum("h").over(w).alias("hits")), "day", "ops", "hits")


@query(STATE + "SELECT user_id % 10 AS round, count(*) FILTER (WHERE o.op = 'PUT') AS saves, count(*) FILTER (WHERE o.op = 'GET') AS restores, count(*) FILTER (WHERE o.op = 'GET' AND outcome <> 'HIT') AS errors, CAST(round(avg(value), 6) AS DOUBLE) AS mean_ms FROM outcomes o JOIN events e ON e.event_id = o.seq GROUP BY 1")
def noise_summary(spark, sf_dir):
    o = state.point_in_time(_ops(spark, sf_dir)).select("seq", "op", "outcome", "prefix_id")
    j = o.join(_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    return j.groupBy(((F.col("prefix_id") - 1) % 10).alias("round")).agg(F.count_if(F.col("op") == "PUT").alias("saves"), F.count_if(F.col("op") == "GET").alias("restores"), F.count_if((F.col("op") == "GET") & (F.col("outcome") != "HIT")).alias("errors"), F.round(F.avg("value"), 6).alias("mean_ms"))


# Garbage collection.

@query(PLACED + "SELECT dev, epoch, written_pages, live_pages, leaves, base_s, close_s, live_bytes FROM states")
def region_live_bytes(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(PLACED + ", v AS (SELECT dev, min({'live_bytes': live_bytes, 'epoch': epoch}) AS v FROM states WHERE state = 'FROZEN' GROUP BY dev) SELECT dev, v.epoch AS epoch, v.live_bytes AS live_bytes FROM v")
def region_victim(spark, sf_dir):
    return gc.victims(_regions(spark, sf_dir))


@query(PLACED + ", o AS (SELECT * FROM states WHERE state = 'FROZEN' AND (SELECT max(now_s) FROM ops) - close_s >= 3600) SELECT dev, epoch, live_bytes FROM o WHERE epoch IN (SELECT DISTINCT epoch FROM o ORDER BY epoch LIMIT 2)")
def generation_drop(spark, sf_dir):
    return gc.oldest_generations(_regions(spark, sf_dir), _now(spark, sf_dir), 3600, 2).select("dev", "epoch", "live_bytes")


@query(PLACED + "SELECT dev, epoch FROM states WHERE state = 'FROZEN' AND live_bytes <= 16 * 4096 * 100 AND live_bytes = 0 AND (SELECT max(now_s) FROM ops) > base_s + 1800")
def epoch_trim(spark, sf_dir):
    return gc.epoch_trim(_regions(spark, sf_dir), _now(spark, sf_dir), 1800).select("dev", "epoch")


@query(PLACED + "SELECT count(DISTINCT {'d': dev, 'e': epoch % 64}) AS generations, count(*) AS regions FROM states")
def generation_count(spark, sf_dir):
    return gc.generations(_regions(spark, sf_dir))


@query("SELECT CAST(sum((s_suppkey % 8 + 1) * (s_nationkey + 64) * 4096) AS BIGINT) AS capacity_bytes FROM supplier")
def device_capacity(spark, sf_dir):
    return gc.capacity(_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8 + 1).alias("region_cnt"), (F.col("s_nationkey") + 64).alias("region_pages")))


@query(PLACED + """, v AS (SELECT dev, min({'live_bytes': live_bytes, 'epoch': epoch}).epoch AS epoch FROM states WHERE state = 'FROZEN' GROUP BY dev)
SELECT f.prefix_id, f.group_idx, f.ver, l.dev, l.epoch FROM leaf f JOIN located l ON l.seq = f.ver LEFT JOIN v ON v.dev = l.dev AND v.epoch = l.epoch WHERE v.dev IS NULL OR f.ver % 5 = 0""")
def region_drop(spark, sf_dir):
    return gc.drop_regions(_located_leaves(spark, sf_dir), gc.victims(_regions(spark, sf_dir)), F.col("ver") % 5 == 0).select("prefix_id", "group_idx", "ver", "dev", "epoch")


def _located_leaves(spark, sf_dir):
    at = _placed(spark, sf_dir).select(F.col("seq").alias("ver"), "dev", "epoch")
    return state.leaves(_ops(spark, sf_dir)).join(at, "ver")


@query(PLACED + """, v AS (SELECT dev, min({'live_bytes': live_bytes, 'epoch': epoch}).epoch AS epoch FROM states WHERE state = 'FROZEN' AND live_bytes >= 1 GROUP BY dev),
c AS (SELECT f.prefix_id, f.group_idx, f.ver, l.dev, row_number() OVER (PARTITION BY l.dev ORDER BY f.ver) AS rn FROM leaf f JOIN located l ON l.seq = f.ver JOIN v ON v.dev = l.dev AND v.epoch = l.epoch WHERE f.ver % 5 <> 0 AND f.payload_len <= 1048576)
SELECT prefix_id, group_idx, ver, dev FROM c WHERE rn <= 1024""")
def compaction_plan(spark, sf_dir):
    return gc.compaction(_located_leaves(spark, sf_dir), gc.victims(_regions(spark, sf_dir), 1), F.col("ver") % 5 == 0, 1 << 20).select("prefix_id", "group_idx", "ver", "dev")


@query(STATE + """, delta AS (SELECT now_s // 86400 AS tick, CAST(sum(CASE WHEN op = 'PUT' THEN payload_len - CASE WHEN live THEN seen.payload_len ELSE 0 END WHEN op = 'EVICT' AND live THEN -seen.payload_len ELSE 0 END) AS BIGINT) AS d FROM outcomes GROUP BY ALL),
t AS (SELECT tick, CAST(sum(d) OVER (ORDER BY tick) AS BIGINT) AS live_bytes FROM delta),
e AS (SELECT *, CASE WHEN live_bytes::HUGEINT * 100 > 200000000::BIGINT * 80 THEN 1 WHEN live_bytes::HUGEINT * 100 <= 200000000::BIGINT * 60 THEN 0 END AS edge FROM t),
h AS (SELECT tick, live_bytes, coalesce(last_value(edge IGNORE NULLS) OVER (ORDER BY tick), 0) AS draining FROM e)
SELECT tick, live_bytes, draining, CASE WHEN draining = 1 AND coalesce(lag(draining) OVER (ORDER BY tick), 0) = 0 THEN 1 ELSE 0 END AS triggered FROM h""")
def watermark_latch(spark, sf_dir):
    seen = F.when(F.col("live"), F.col("seen.payload_len")).otherwise(0)
    delta = F.when(F.col("op") == "PUT", F.col("payload_len") - seen).when((F.col("op") == "EVICT") & F.col("live"), -seen).otherwise(0)
    per = state.point_in_time(_ops(spark, sf_dir)).groupBy(F.expr("now_s div 86400").alias("tick")).agg(F.sum(delta).alias("d"))
    w = Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # one row a tick
    return gc.watermark_latch(per.select("tick", F.sum("d").over(w).alias("live_bytes")), 200_000_000, 80, 60).select("tick", "live_bytes", "draining", "triggered")


# Durability.

def _valid():
    return F.col("seq") % 997 != 0


@query(OPS + ", v AS (SELECT *, min(CASE WHEN seq % 997 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY prefix_id ORDER BY seq) AS ok FROM ops WHERE op <> 'GET') SELECT seq, prefix_id, group_idx, op FROM v WHERE ok = 1")
def journal_valid_prefix(spark, sf_dir):
    return durability.valid_prefix(_ops(spark, sf_dir).where("op <> 'GET'"), _valid(), "prefix_id").select("seq", "prefix_id", "group_idx", "op")


@query("WITH " + oplog.SQL.replace("ops AS", "all_ops AS", 1) + """, v AS (SELECT *, min(CASE WHEN seq % 997 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY prefix_id ORDER BY seq) AS ok FROM all_ops WHERE op <> 'GET'), ops AS (SELECT * FROM v WHERE ok = 1),""" + state.SQL + "SELECT * FROM leaf")
def journal_fold(spark, sf_dir):
    return durability.fold(durability.valid_prefix(_ops(spark, sf_dir).where("op <> 'GET'"), _valid(), "prefix_id"))


@query(OPS.replace("FROM events)", "FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))") + "," + state.SQL + "SELECT * FROM leaf")
def checkpoint_snapshot(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return durability.checkpoint(ops, F.lit(ops.agg(F.max("seq").alias("m")).first().m // 2))


@query(STATE + "SELECT * FROM leaf")
def recover(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    cut = F.lit(ops.agg(F.max("seq").alias("m")).first().m // 2)
    return durability.recover(durability.checkpoint(ops, cut), ops.where(F.col("seq") > cut))


@query("SELECT CAST(NULL AS BIGINT) AS ver, CAST(NULL AS VARCHAR) AS side WHERE false")
def recover_equals_fold(spark, sf_dir):
    return durability.difference(state.leaves(_ops(spark, sf_dir)), recover(spark, sf_dir)).select("ver", "side")


@query(OPS + "SELECT n_lens, depth, 68 + 4 * n_lens + 8 * depth AS bytes, CAST(4096 // (68 + 4 * n_lens + 8 * depth) AS INTEGER) AS per_page, count(*) AS records FROM (SELECT CAST(payload_len // 64 % 5 AS INTEGER) AS n_lens, group_idx + 1 AS depth FROM ops WHERE op = 'PUT') GROUP BY ALL")
def journal_page_density(spark, sf_dir):
    p = _ops(spark, sf_dir).where("op = 'PUT'").select(F.expr("int(payload_len div 64 % 5)").alias("n_lens"), (F.col("group_idx") + 1).alias("depth"))
    size = durability.record_bytes(F.col("n_lens"), F.col("depth"))
    return p.groupBy("n_lens", "depth").agg(F.count(F.lit(1)).alias("records")).select("n_lens", "depth", size.alias("bytes"), durability.records_per_page(size).alias("per_page"), "records")


@query(_PARTS + "SELECT seq, count(DISTINCT part) AS have, max(n_parts) AS n_parts FROM parts WHERE (seq * 7 + part) % 29 <> 0 GROUP BY seq HAVING count(DISTINCT part) = max(n_parts)")
def replay_stripes(spark, sf_dir):
    return durability.stripes_complete(placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV).where("(seq * 7 + part) % 29 <> 0"))


@query(OPS + ", b AS (SELECT prefix_id % 8 AS dev, seq % 2 AS slot, seq // 2 AS epoch, now_s AS fmt_ts, seq % 5 <> 0 AS valid FROM ops) SELECT dev, x.slot AS slot, x.epoch AS epoch, x.fmt_ts AS fmt_ts FROM (SELECT dev, arg_max({'slot': slot, 'epoch': epoch, 'fmt_ts': fmt_ts}, {'a': epoch, 'b': fmt_ts}) AS x FROM b WHERE valid GROUP BY dev)")
def superblock_pick(spark, sf_dir):
    b = _ops(spark, sf_dir).where("seq % 5 <> 0").select((F.col("prefix_id") % 8).alias("dev"), (F.col("seq") % 2).alias("slot"), F.expr("seq div 2").alias("epoch"), F.col("now_s").alias("fmt_ts"), F.lit(True).alias("valid"))
    # One candidate an epoch and device, so that ties cannot matter.
    return durability.newest_superblock(b, "dev")


@query(PLACED + ", d AS (SELECT dev, region FROM (SELECT unnest(range(0, 4)) AS dev), (SELECT unnest(range(1, 9)) AS region)) SELECT CAST(d.dev AS INTEGER) AS dev, d.region, coalesce(s.state, 'FREE') AS state, coalesce(s.epoch, 0) AS epoch FROM d LEFT JOIN states s ON s.dev = d.dev AND s.epoch = d.region AND s.epoch % 3 <> 0")
def region_header_load(spark, sf_dir):
    d = spark.range(4).select(F.col("id").cast("int").alias("dev"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("region"))
    h = gc.frozen(_regions(spark, sf_dir)).select("dev", F.col("epoch").alias("region"), "state", "epoch", (F.col("epoch") % 3 != 0).alias("valid"))
    return durability.region_states(d, h)


# Layout maths.

_MODELS = "WITH m(name, kind, layers, kv, hd, d, latent, rope) AS (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}::BIGINT, {p[4]}::BIGINT, {p[5]}::BIGINT, {p[6]}::BIGINT, {p[7]}::BIGINT, {p[8]}::BIGINT)" for p in layout.PRESETS) + """),
t AS (SELECT *, CASE kind WHEN 'MLA' THEN (latent + rope) * d WHEN 'MQA' THEN 2 * hd * d ELSE 2 * kv * hd * d END AS tlb FROM m),
b AS (SELECT *, tlb * layers AS token_bytes, tlb * 32 AS glb, tlb * 32 * layers AS gb FROM t),
u AS (SELECT *, (262144 + l - 1) // l * l AS stripe_unit, CASE WHEN gb > 262144 THEN 262144 ELSE greatest(262144 // gb * gb, gb) END AS thr FROM (SELECT *, lcm(4096, glb) AS l FROM b)),
w AS (SELECT *, CASE WHEN gb <= thr THEN (w0 + gb - 1) // gb * gb ELSE w0 END AS w1 FROM (SELECT *, (greatest(262144, gb) + 4095) // 4096 * 4096 AS w0 FROM u))
"""


@query(_MODELS + "SELECT name, kind, CAST(layers AS INTEGER) AS kv_layers, tlb AS token_layer_bytes, token_bytes, gb AS group_bytes, CAST(gcd(gb, 4096) AS BIGINT) AS alignment, CAST(stripe_unit AS BIGINT) AS stripe_unit, CAST(thr AS BIGINT) AS stripe_threshold, CAST(CASE WHEN w1 > thr THEN thr // 4096 * 4096 ELSE w1 END AS BIGINT) AS batch_min, (gb + 4095) // 4096 * 4096 AS dram_entry_max FROM w")
def model_layout(spark, sf_dir):
    return layout.tuned(layout.presets(spark)).select("name", "kind", "kv_layers", "token_layer_bytes", "token_bytes", "group_bytes", "alignment", "stripe_unit", "stripe_threshold", "batch_min", "dram_entry_max")


@query(_MODELS + "SELECT name, tokens, tokens * token_bytes AS bytes FROM b, (SELECT unnest([1024, 8192, 131072]::BIGINT[]) AS tokens)")
def model_context_bytes(spark, sf_dir):
    m = layout.with_bytes(layout.presets(spark))
    return m.select("*", F.explode(F.array(*[F.lit(t).cast("long") for t in (1024, 8192, 131072)])).alias("tokens")).select("name", "tokens", layout.context_bytes(F.col("tokens")).alias("bytes"))


@query(_MODELS + ", d AS (SELECT CAST(len(string_split(text, ' ')) AS BIGINT) AS n FROM documents) SELECT name, count(*) FILTER (WHERE n * token_bytes <= 67108864) AS fitting, count(*) AS documents FROM b, d GROUP BY name")
def model_fit(spark, sf_dir):
    sizes = _table(spark, sf_dir, "documents").groupBy(F.size(tokens.tokens_of()).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs"))
    m = layout.with_bytes(layout.presets(spark)).select("name", "token_bytes")
    # Eleven profiles against the counts of each length, not against the documents.
    return sizes.crossJoin(F.broadcast(m)).groupBy("name").agg(F.coalesce(F.sum(F.when(F.col("n") * F.col("token_bytes") <= 67108864, F.col("docs"))), F.lit(0)).alias("fitting"), F.sum("docs").alias("documents"))


@query(_MODELS + "SELECT name, 32 AS n_groups_tokens, CAST(layers AS INTEGER) AS max_layers, CAST(stripe_unit AS BIGINT) AS stripe_unit, CAST(thr AS BIGINT) AS stripe_threshold, gb AS region_align_bytes FROM u WHERE name LIKE 'qwen%'")
def model_config_values(spark, sf_dir):
    return layout.config_values(layout.presets(spark).where("name LIKE 'qwen%'")).select("name", "n_groups_tokens", "max_layers", "stripe_unit", "stripe_threshold", "region_align_bytes")


_CONFIGS = [
    (1, '{"num_hidden_layers": 32, "num_attention_heads": 32, "num_key_value_heads": 8, "hidden_size": 4096, "torch_dtype": "bfloat16"}'),
    (2, '{"text_config": {"num_hidden_layers": 61, "num_attention_heads": 128, "kv_lora_rank": 512, "qk_rope_head_dim": 64, "qk_nope_head_dim": 128, "torch_dtype": "bfloat16"}}'),
    (3, '{"num_hidden_layers": 40, "num_attention_heads": 32, "num_key_value_heads": 2, "head_dim": 128}'),
    (4, '{"num_hidden_layers": 12}'),
    (5, '{"num_hidden_layers": 2, "num_attention_heads": 8, "num_key_value_heads": 1, "dtype": "float8"}'),
]


@query("SELECT * FROM (VALUES (1, 'OK', 'GQA', 128, 2, 4096::BIGINT), (2, 'OK', 'MLA', 128, 2, 1152), (3, 'OK', 'GQA', 128, 2, 1024), (4, 'EINVAL', '-', 0, 0, 0), (5, 'OK', 'MQA', 128, 1, 256)) t(id, rc, kind, head_dim, dtype_bytes, token_layer_bytes)")
def config_parse(spark, sf_dir):
    p = layout.from_config_json(spark.createDataFrame(_CONFIGS, "id int, json string"), F.col("json"))
    zero = lambda c: F.coalesce(c, F.lit(0))  # noqa: E731  no nulls in the result
    return p.select("id", "rc", F.coalesce("kind", F.lit("-")).alias("kind"), zero(F.col("head_dim")).alias("head_dim"), zero(F.col("dtype_bytes")).alias("dtype_bytes"), zero(F.when(F.col("rc") == "OK", layout.bytes_per_token_layer())).alias("token_layer_bytes"))


# Hashing: DuckDB on UHUGEINT against wrapping BIGINT.

def _hash_sql(source: str, columns: str, value: str = "h") -> str:
    """``source`` gives {columns} and h0, a UHUGEINT below 2^64; the finaliser in steps. A product needs 128 bits."""
    m = "18446744073709551616::UHUGEINT"
    return f"""WITH a AS ({source}),
b AS (SELECT {columns}, (xor(h0, h0 // 1073741824) * 13787848793156543929::UHUGEINT) % {m} AS h FROM a),
c AS (SELECT {columns}, (xor(h, h // 134217728) * 10723151780598845931::UHUGEINT) % {m} AS h FROM b),
d AS (SELECT {columns}, xor(h, h // 2147483648) AS h FROM c)
"""


_TOK = "list_transform(range(0, 32), lambda i: (user_id * 2654435761 + i * 7919) % 2147483647)"
_FNV = "list_reduce(list_prepend({start}, {bytes}), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _prefix_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.expr("transform(sequence(0, 31), i -> (user_id * 2654435761L + i * 7919) % 2147483647)").alias("tokens"))


@query(_hash_sql("SELECT DISTINCT user_id, CAST(user_id AS UHUGEINT) AS h0 FROM events", "user_id") + "SELECT user_id, CAST(h AS VARCHAR) AS mixed, CAST(h % 8 AS INTEGER) AS dev FROM d")
def device_route(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select("user_id").distinct()
    m = hashing.with_mix64(p, F.col("user_id"), "m")
    return m.select("user_id", hashing.unsigned(F.col("m")).alias("mixed"), hashing.unsigned_mod(F.col("m"), 8).alias("dev"))


@query(_hash_sql("SELECT DISTINCT user_id, group_idx, xor(CAST(user_id AS UHUGEINT), CAST(group_idx AS UHUGEINT) * 4294967296) AS h0 FROM (SELECT user_id, event_id % 4 AS group_idx FROM events)", "user_id, group_idx") + "SELECT user_id, CAST(group_idx AS INTEGER) AS group_idx, CAST(h AS VARCHAR) AS side, CAST(h % 64 AS INTEGER) AS shard FROM d")
def side_hash(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).cast("int").alias("group_idx")).distinct()
    return hashing.side_hashed(p, F.col("user_id"), F.col("group_idx"), "m").select("user_id", "group_idx", hashing.unsigned(F.col("m")).alias("side"), hashing.unsigned_mod(F.col("m"), 64).alias("shard"))


_BYTES = f"flatten(list_transform({_TOK}, lambda t: [CAST(t % 256 AS UHUGEINT), CAST(t // 256 % 256 AS UHUGEINT), CAST(t // 65536 % 256 AS UHUGEINT), CAST(t // 16777216 % 256 AS UHUGEINT)]))"
_START = "(xor(14695981039346656037::UHUGEINT, CAST(user_id AS UHUGEINT)) * 2) % 18446744073709551616::UHUGEINT"


@query(_hash_sql(f"SELECT user_id, {_FNV.format(start=_START, bytes=_BYTES)} AS h0 FROM (SELECT DISTINCT user_id FROM events)", "user_id") + "SELECT user_id, CAST(h AS VARCHAR) AS path FROM d")
def hash_path(spark, sf_dir):
    return hashing.with_hash_path(_prefix_tokens(spark, sf_dir), F.col("user_id"), F.col("tokens"), F.lit(0), "h").select("user_id", hashing.unsigned(F.col("h")).alias("path"))


@query(_hash_sql(f"SELECT user_id, {_FNV.format(start='14695981039346656037::UHUGEINT', bytes=_BYTES)} AS h0 FROM (SELECT DISTINCT user_id FROM events)", "user_id") + "SELECT user_id, CAST(h AS VARCHAR) AS address FROM d")
def prefix_address(spark, sf_dir):
    return hashing.with_prefix_address(_prefix_tokens(spark, sf_dir), F.col("tokens"), "h").select("user_id", hashing.unsigned(F.col("h")).alias("address"))


@query(_hash_sql(f"SELECT user_id, {_FNV.format(start='xor(14695981039346656037::UHUGEINT, CAST(user_id AS UHUGEINT))', bytes=f'list_transform({_TOK}, lambda t: CAST(t AS UHUGEINT))')} AS h0 FROM (SELECT DISTINCT user_id FROM events)", "user_id") + "SELECT user_id, CAST(h AS VARCHAR) AS key FROM d")
def sequence_key(spark, sf_dir):
    return hashing.with_sequence_key(_prefix_tokens(spark, sf_dir), F.col("user_id"), F.col("tokens"), "h").select("user_id", hashing.unsigned(F.col("h")).alias("key"))


@query(_hash_sql("SELECT c_custkey, c_name, " + _FNV.format(start="14695981039346656037::UHUGEINT", bytes="list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS UHUGEINT))") + " AS h0 FROM customer", "c_custkey") + "SELECT c_custkey, CAST(h AS VARCHAR) AS prefix FROM d")
def blob_key(spark, sf_dir):
    return hashing.with_hash64(_table(spark, sf_dir, "customer"), F.col("c_name"), "h").select("c_custkey", hashing.unsigned(F.col("h")).alias("prefix"))


@query("SELECT user_id, list_sum(list_transform(range(0, 32), lambda i: ((user_id * 2654435761 + i * 1103515245 + 12345) // 65536) % 2147483648))::BIGINT AS total FROM (SELECT DISTINCT user_id FROM events)")
def stand_in_tokens(spark, sf_dir):
    p = _table(spark, sf_dir, "events").select("user_id").distinct()
    return hashing.with_stand_in_tokens(p, F.col("user_id"), "t").select("user_id", F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT s_suppkey, CASE WHEN p <> '' THEN '_' || p ELSE '' END AS suffix FROM (SELECT s_suppkey, concat_ws('-', nullif(replace(s_name, '#', '-'), ''), CASE WHEN s_nationkey % 2 = 0 THEN (s_suppkey % 4) || '_4' END, CASE WHEN s_suppkey % 3 + 1 > 1 THEN (s_suppkey % 3 + 1) || '_' || (s_suppkey % 2) END) AS p FROM supplier)""")
def rank_suffix(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    t = lambda x: x.cast("string")
    k = F.col("s_suppkey")
    return s.select("s_suppkey", hashing.rank_suffix(F.replace("s_name", F.lit("#"), F.lit("/")), F.col("s_nationkey") % 2 != 0, t(k % 4), F.lit("4"), t(k % 2), k % 3 + 1).alias("suffix"))


# Workload.

@query("SELECT k, round(sum(1.0::DOUBLE / k) OVER (ORDER BY k) / (SELECT sum(1.0::DOUBLE / x) FROM (SELECT unnest(range(1, 1001)) AS x)), 9) AS cdf FROM (SELECT unnest(range(1, 1001)) AS k)")
def zipf_cdf(spark, sf_dir):
    return workload.zipf_cdf(spark, 1000).select("k", F.round("cdf", 9).alias("cdf"))


_DRAWS = _hash_sql("SELECT i, CAST(i + 4294967296 AS UHUGEINT) AS h0 FROM (SELECT unnest(range(0, 2000)) AS i)", "i")


@query(_DRAWS + """, cdf AS (SELECT k, sum(1.0::DOUBLE / k) OVER (ORDER BY k) / (SELECT sum(1.0::DOUBLE / x) FROM (SELECT unnest(range(1, 101)) AS x)) AS cdf FROM (SELECT unnest(range(1, 101)) AS k)),
f AS (SELECT i, CAST(h // 2048 AS DOUBLE) / 9007199254740992 AS u FROM d)
SELECT key, count(*) AS n FROM (SELECT i, least(100, 1 + (SELECT count(*) FROM cdf WHERE cdf < u)) AS key FROM f) GROUP BY key""")
def workload_keys(spark, sf_dir):
    return workload.keys(spark, 2000, 100, "zipf").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# Simulations and codecs: rows only, with tests of their own.

@query()
def sieve_sim(spark, sf_dir):
    return tier.simulate(tier.accesses_of(state.point_in_time(_ops(spark, sf_dir))), 64 << 20)


@query()
def alloc_sim(spark, sf_dir):
    parts = placement.stripe_parts(_ops(spark, sf_dir).where("op = 'PUT'"), N_DEV)
    return alloc.allocate(parts, REGION_PAGES, 8)


@query()
def cuckoo_probe(spark, sf_dir):
    probes = _ops(spark, sf_dir).where("op = 'GET'").select("seq", "prefix_id")
    return cuckoo.maybe_in(probes, F.col("prefix_id"), state.tombstones(_ops(spark, sf_dir)), "prefix_id")


@query("SELECT doc_id, 0 AS layer, strlen(text) AS bytes, true AS equal FROM documents WHERE doc_id % 10 <> 3")
def chunk_roundtrip(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "text", chunk.encode_udf("doc_id", F.lit(0), F.lit(1), "text").alias("chunk"))
    torn = d.withColumn("chunk", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(b"\0"), F.expr("substring(chunk, 2)"))).otherwise(F.col("chunk")))
    return chunk.records_of(torn).select("doc_id", "layer", F.length("payload").cast("long").alias("bytes"), (F.col("payload") == F.col("text").cast("binary")).alias("equal"))


@query()
def crc_check(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", chunk.pages_crc(F.col("text").cast("binary")).alias("crc"))


# Streams.

@query(OPS + "SELECT now_s // 86400 * 86400 AS start_s, op, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS bytes FROM ops GROUP BY ALL")
def stream_metrics_tumbling(spark, sf_dir):
    return streams.available(streams.tumbling(streams.read(spark, sf_dir)), "complete")


@query(OPS + """, b AS (SELECT prefix_id, now_s, CASE WHEN now_s - lag(now_s) OVER (PARTITION BY prefix_id ORDER BY now_s) < 21600 THEN 0 ELSE 1 END AS fresh FROM ops),
s AS (SELECT prefix_id, now_s, sum(fresh) OVER (PARTITION BY prefix_id ORDER BY now_s ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT prefix_id, min(now_s) AS start_s, max(now_s) + 21600 AS end_s, count(*) AS n FROM s GROUP BY prefix_id, k""")
def stream_sessions(spark, sf_dir):
    return streams.available(streams.sessions(streams.read(spark, sf_dir)), "complete")


@query(STATE + "SELECT op, outcome, count(*) AS n, CAST(sum(payload_len) AS BIGINT) AS payload_bytes FROM outcomes GROUP BY ALL")
def stream_outcomes(spark, sf_dir):
    done = streams.available(streams.keyed_outcomes(streams.read(spark, sf_dir)), "append")
    return done.groupBy("op", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("payload_bytes"))


# The queries of upkeep add themselves.
from palimpsest.plans import upkeep as _upkeep  # noqa: E402, F401
