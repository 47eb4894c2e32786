"""Versioned key state folded from the log: outcomes, leaves, tombstones.

A GET or EVICT sees the last PUT or EVICT of its address before it.  Expiry is
lazy; a tombstone is kept per prefix and never cleared (except by ``reopened_at``).
Windows carry PARTITION BY an address or a prefix; their frames only look back,
so Spark streams a partition through them, with its rows spilling.  A hot key can
be cut into stretches (``last_before``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.oplog import ADDRESS

#: Result codes, negative as clients see them.
CODES = {"OK": 0, "HIT": 0, "ENOENT": -3, "EBUSY": -4, "EINVAL": -11, "EVICTED": -12}
STRIPE_THRESHOLD = 1 << 20
#: Seqs of a stretch, in logs that span more than a few of them.
STRETCH = 1 << 20
#: Bytes of a log that are few enough for windows over whole prefixes.
SMALL_LOG = 64 << 20


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def expired(expire_ts: Column, now: Column) -> Column:
    """Strictly past, in whole seconds; 0 never expires."""
    return (expire_ts != 0) & (expire_ts < now)


def last_before(df: DataFrame, keys: list[str], value: Column, out: str, chunk: int | None = None) -> DataFrame:
    """Adds the last value, not null, of earlier rows of the same keys.

    With ``chunk``, a key's rows are cut into stretches of so many seqs, each a
    partition of its own; what a stretch starts from is worked out on one row a
    key and stretch.  So a hot key is spread over many tasks.
    """
    if chunk is None:
        return df.withColumn(out, F.last_value(value, F.lit(True)).over(_before(*keys)))
    cut = df.withColumn("__chunk", F.floor(F.col("seq") / chunk)).withColumn("__value", value)
    last = cut.where("__value IS NOT NULL").groupBy(*keys, "__chunk").agg(F.max_by("__value", "seq").alias("__last"))
    every = cut.select(*keys, "__chunk").distinct().join(last, [*keys, "__chunk"], "left")
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*keys, "__chunk", F.last_value("__last", F.lit(True)).over(w).alias("__carried"))
    local = cut.withColumn("__local", F.last_value("__value", F.lit(True)).over(_before(*keys, "__chunk")))
    joined = local.join(carried, [*keys, "__chunk"])
    return joined.select(*df.columns, F.coalesce("__local", "__carried").alias(out))


def _stretch(ops: DataFrame) -> int | None:
    """STRETCH for a log of more than four of them; a log whose files are small is not asked."""
    if ops._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL_LOG:
        return None
    ends = ops.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    return STRETCH if ends.a is not None and ends.b - ends.a > 4 * STRETCH else None


def point_in_time(ops: DataFrame, chunk: int | None = None) -> DataFrame:
    """Per operation: the leaf it sees, whether its prefix is tombstoned, and its outcome.

    ``chunk``: see ``last_before``; without it, logs of more than ``SMALL_LOG`` bytes
    over more than four stretches of ``STRETCH`` seqs are cut into those, so that no
    hot prefix is one task.
    """
    if chunk is None:
        chunk = _stretch(ops)
    change = F.when(F.col("op").isin("PUT", "EVICT"), F.struct("op", "seq", "payload_len", "expire_ts"))
    seen = last_before(ops, ADDRESS, change, "seen", chunk)
    live = seen.withColumn("live", F.coalesce(F.col("seen.op") == "PUT", F.lit(False)))
    evicted = F.when((F.col("op") == "EVICT") & F.col("live") & (F.col("prefix_id") != 0), 1)
    dead = last_before(live, ["prefix_id"], evicted, "__dead", chunk).withColumn("tombstoned", F.col("__dead").isNotNull()).drop("__dead")
    outcome = (
        F.when(F.col("op") == "PUT", "OK")
        .when(F.col("op") == "EVICT", F.when(F.col("live"), "OK").otherwise("ENOENT"))
        .when(F.col("live") & expired(F.col("seen.expire_ts"), F.col("now_s")), "ENOENT (expired)")
        .when(F.col("live"), "HIT")
        .when(F.col("tombstoned"), "EVICTED")
        .otherwise("ENOENT"))
    return dead.withColumn("outcome", outcome)


def outcome_counts(ops: DataFrame, stripe_threshold: int = STRIPE_THRESHOLD) -> DataFrame:
    return point_in_time(ops).groupBy("op", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("payload_bytes"),
        F.count_if(F.col("payload_len") > stripe_threshold).alias("striped"))


def outcomes_by_prefix(ops: DataFrame) -> DataFrame:
    gets = point_in_time(ops).where("op = 'GET'")
    return gets.groupBy("prefix_id").agg(
        F.count_if(F.col("outcome") == "HIT").alias("hits"), F.count_if(F.col("outcome").startswith("ENOENT")).alias("misses"),
        F.count_if(F.col("outcome") == "EVICTED").alias("evicted"),
    ).withColumn("hit_ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses") + F.col("evicted")), 9))


def leaves(ops: DataFrame) -> DataFrame:
    """Live leaves at the log's end: last writer wins, an EVICT after it removes it."""
    last = ops.where("op <> 'GET'").groupBy(*ADDRESS).agg(F.max_by(F.struct("op", "seq", "now_s", "payload_len", "expire_ts"), "seq").alias("last"))
    return last.where("last.op = 'PUT'").select(*ADDRESS, F.col("last.seq").alias("ver"), F.col("last.now_s").alias("written_s"), F.col("last.payload_len").alias("payload_len"), F.col("last.expire_ts").alias("expire_ts"))


def versions(ops: DataFrame) -> DataFrame:
    """Versions of accepted PUTs in the order of their address (globally, ``seq`` is the version)."""
    w = Window.partitionBy(*ADDRESS).orderBy("seq")
    return ops.where("op = 'PUT'").select("seq", *ADDRESS, F.row_number().over(w).alias("address_ver"), F.lead("seq").over(w).isNull().alias("is_newest"))


def tombstones(ops: DataFrame) -> DataFrame:
    return point_in_time(ops).where("op = 'EVICT' AND outcome = 'OK' AND prefix_id <> 0").groupBy("prefix_id").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("evictions"))


def first_write_wins(ops: DataFrame) -> DataFrame:
    """Set-if-absent: the first PUT of an address stays."""
    return ops.where("op = 'PUT'").groupBy(*ADDRESS).agg(F.min("seq").alias("seq"), F.min_by("payload_len", "seq").alias("payload_len"), (F.count(F.lit(1)) - 1).alias("skipped"))


def dropped_leaves(ops: DataFrame) -> DataFrame:
    """Leaf drops with the live bytes they give back."""
    return point_in_time(ops).where("op = 'EVICT' AND outcome = 'OK'").select("seq", *ADDRESS, F.col("seen.seq").alias("ver"), F.col("seen.payload_len").alias("freed_bytes"))


def expired_leaves(ops: DataFrame) -> DataFrame:
    """What a sweep at the log's last second drops."""
    now = ops.agg(F.max("now_s")).scalar()
    return leaves(ops).where(expired(F.col("expire_ts"), now)).select(*ADDRESS, "ver", "expire_ts")


def sweep(leaf: DataFrame, now: Column, pinned: Column | None = None) -> DataFrame:
    """Leaves that stay: expired ones go unless pinned."""
    gone = expired(F.col("expire_ts"), now)
    return leaf.where(~(gone & ~pinned) if pinned is not None else ~gone)


def pinned_evictions(ops: DataFrame, pins: DataFrame) -> DataFrame:
    """EVICT outcomes with reader pins (pin_prefix, pin_start, pin_end): EBUSY while an interval is open."""
    evicts = point_in_time(ops).where("op = 'EVICT'")
    held = evicts.join(pins, (F.col("prefix_id") == F.col("pin_prefix")) & (F.col("seq") > F.col("pin_start")) & (F.col("seq") < F.col("pin_end")), "left_semi").select("seq", F.lit(True).alias("pinned"))
    joined = evicts.join(held, "seq", "left")
    return joined.select("seq", *ADDRESS, F.when(~F.col("live"), "ENOENT").when(F.coalesce("pinned", F.lit(False)), "EBUSY").otherwise("OK").alias("outcome"))


def exists(probes: DataFrame, leaf: DataFrame) -> DataFrame:
    return probes.join(leaf.select(*ADDRESS), ADDRESS, "left_semi")


def absent(probes: DataFrame, leaf: DataFrame) -> DataFrame:
    return probes.join(leaf.select(*ADDRESS), ADDRESS, "left_anti")


def lookup_hits(ops: DataFrame, probes: DataFrame, leaf: DataFrame) -> DataFrame:
    """Per prefix: hits of GETs, and of existence probes, which count as lookups too."""
    gets = point_in_time(ops).where("outcome = 'HIT'").groupBy("prefix_id").agg(F.count(F.lit(1)).alias("get_hits"))
    found = exists(probes, leaf).groupBy("prefix_id").agg(F.count(F.lit(1)).alias("probe_hits"))
    both = gets.join(found, "prefix_id", "full")
    return both.select("prefix_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("get_hits", "probe_hits")]).withColumn("hits", F.col("get_hits") + F.col("probe_hits"))


def published(rows: DataFrame) -> DataFrame:
    """Per address: the newest version, the replica slots or stripe parts that its rows filled, and their bytes.

    Rows (address, ver, slot, payload_len) in any order: an older version is
    ignored, one of equal version fills its slot, a newer one replaces.
    """
    newest = rows.groupBy(*ADDRESS).agg(F.max("ver").alias("ver"))
    held = rows.join(newest, [*ADDRESS, "ver"]).groupBy(*ADDRESS, "ver", "slot").agg(F.max("payload_len").alias("payload_len"))
    return held.groupBy(*ADDRESS, "ver").agg(F.count(F.lit(1)).alias("slots"), F.sum("payload_len").alias("bytes"))


def batch_exists(wanted: DataFrame, leaf: DataFrame) -> DataFrame:
    """Per batch of (batch, pos, address): length of the contiguous run of stored keys from position 0."""
    found = leaf.select(*ADDRESS, F.lit(1).alias("found"))
    joined = wanted.join(found, ADDRESS, "left")
    return joined.groupBy("batch").agg(
        F.coalesce(F.min(F.when(F.col("found").isNull(), F.col("pos"))), F.count(F.lit(1)).cast("int")).alias("prefix_len"),
        F.count("found").alias("present"), F.count(F.lit(1)).alias("asked"))


def batch_get(wanted: DataFrame, leaf: DataFrame) -> DataFrame:
    """Versions of a batch's keys, in the batch's order, null where absent."""
    joined = wanted.join(leaf.select(*ADDRESS, "ver"), ADDRESS, "left")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "ver")))
    return joined.groupBy("batch").agg(F.array_join(F.transform(ordered, lambda x: F.coalesce(x.ver.cast("string"), F.lit("-"))), ",").alias("vers"))


def batch_set(wanted: DataFrame, ok: Column) -> DataFrame:
    """Writes of a batch up to its first failure."""
    fail = wanted.groupBy("batch").agg(F.min(F.when(~ok, F.col("pos"))).alias("failed_at"))
    return wanted.join(fail, "batch").where(F.col("failed_at").isNull() | (F.col("pos") < F.col("failed_at")))


def get_into(gets: DataFrame, expected: Column) -> DataFrame:
    """Hits whose stored size is the target's; others give nothing."""
    return gets.where((F.col("outcome") == "HIT") & (F.col("seen.payload_len") == expected))


def acks(parts: DataFrame) -> DataFrame:
    """One ack a PUT, when all parts are in: the first error wins. Columns put, part, n_parts, rc."""
    return parts.groupBy("put").agg(
        F.max("n_parts").alias("n_parts"), F.count(F.lit(1)).alias("seen"),
        F.coalesce(F.min_by(F.when(F.col("rc") != 0, F.col("rc")), F.when(F.col("rc") != 0, F.col("part"))), F.lit(0)).alias("rc"),
    ).where("seen = n_parts").select("put", "rc", "n_parts")


def reopened(ops: DataFrame, reopen_seq: int) -> DataFrame:
    """Outcomes after a reopen at ``reopen_seq``: leaves survive, tombstones do not."""
    state = point_in_time(ops)
    evicted = F.when((F.col("op") == "EVICT") & F.col("live") & (F.col("seq") > reopen_seq), 1)
    dead = state.withColumn("late_tomb", F.coalesce(F.max(evicted).over(_before("prefix_id")), F.lit(0)) == 1)
    return dead.where(F.col("seq") > reopen_seq).withColumn("outcome", F.when((F.col("outcome") == "EVICTED") & ~F.col("late_tomb"), "ENOENT").otherwise(F.col("outcome"))).drop("late_tomb")


#: The outcomes as SQL, for the oracles; needs the CTE ops.
SQL = """
s1 AS (SELECT *, last_value(CASE WHEN op <> 'GET' THEN {'op': op, 'seq': seq, 'payload_len': payload_len, 'expire_ts': expire_ts} END IGNORE NULLS)
         OVER (PARTITION BY prefix_id, group_idx ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ops),
s2 AS (SELECT *, coalesce(seen.op = 'PUT', false) AS live FROM s1),
s3 AS (SELECT *, coalesce(max(CASE WHEN op = 'EVICT' AND live AND prefix_id <> 0 THEN 1 END)
         OVER (PARTITION BY prefix_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS tomb FROM s2),
outcomes AS (SELECT *, CASE WHEN op = 'PUT' THEN 'OK' WHEN op = 'EVICT' THEN CASE WHEN live THEN 'OK' ELSE 'ENOENT' END
         WHEN live AND seen.expire_ts <> 0 AND seen.expire_ts < now_s THEN 'ENOENT (expired)' WHEN live THEN 'HIT'
         WHEN tomb THEN 'EVICTED' ELSE 'ENOENT' END AS outcome FROM s3),
leaf AS (SELECT prefix_id, group_idx, last.seq AS ver, last.now_s AS written_s, last.payload_len AS payload_len, last.expire_ts AS expire_ts FROM (
         SELECT prefix_id, group_idx, arg_max({'op': op, 'seq': seq, 'now_s': now_s, 'payload_len': payload_len, 'expire_ts': expire_ts}, seq) AS last
         FROM ops WHERE op <> 'GET' GROUP BY ALL) WHERE last.op = 'PUT')
"""
