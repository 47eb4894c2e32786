"""Counters, ratios and log2 histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST_BUCKET = 31


def bucket(ns: Column) -> Column:
    """floor(log2 ns), 0 for 0, at most 31; by the length in binary, so exact."""
    return F.when(ns <= 0, 0).otherwise(F.least(F.lit(LAST_BUCKET), F.length(F.bin(ns)) - 1)).cast("int")


def histogram(samples: DataFrame, value: Column, *by: str) -> DataFrame:
    return samples.groupBy(*by, bucket(value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def merged(histograms: DataFrame, *by: str) -> DataFrame:
    """Bucket-wise sum; a minimum of 0 is one of an empty histogram."""
    return histograms.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min(F.when(F.col("least") > 0, F.col("least"))).alias("least"), F.max("most").alias("most"))


def percentiles(hist: DataFrame, points: list[int], *by: str) -> DataFrame:
    """Upper edges of the buckets that hold the points; points over 100 give 0. A histogram has at most 32 rows."""
    w = Window.partitionBy(*by)
    running = hist.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    asked = running.select("*", F.explode(F.array(*[F.lit(p) for p in points])).alias("p"))
    reached = asked.where(F.col("cum") >= F.expr("(all * p + 99) div 100"))
    first = reached.groupBy(*by, "p").agg(F.min("bucket").alias("b"))
    edge = F.when(F.col("p") > 100, F.lit(0).cast("long")).when(F.col("b") >= LAST_BUCKET, F.lit(1 << 31)).otherwise(F.expr("shiftleft(1L, b + 1)"))
    return first.select(*by, "p", edge.alias("value"))


def summary(hist: DataFrame, *by: str) -> DataFrame:
    """Count, average by integer division, and maximum."""
    return hist.groupBy(*by).agg(F.sum("n").alias("n"), F.expr("coalesce(sum(total) div sum(n), 0)").alias("avg"), F.max("most").alias("most"))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def counters(outcomes: DataFrame) -> DataFrame:
    """One row of named counters from point-in-time outcomes (with payload pages)."""
    o, op = F.col("outcome"), F.col("op")
    return outcomes.agg(
        F.count_if(op == "PUT").alias("puts"), F.count_if(op == "GET").alias("gets"), F.count_if(op == "EVICT").alias("evicts"),
        F.count_if(o == "HIT").alias("hits"), F.count_if((op == "GET") & o.startswith("ENOENT")).alias("misses"), F.count_if(o == "EVICTED").alias("evicted_reads"),
        F.coalesce(F.sum(F.when(op == "PUT", F.col("payload_len"))), F.lit(0)).alias("bytes_payload"),
        F.coalesce(F.sum(F.when(op == "PUT", F.ceil(F.col("payload_len") / 4096) * 4096)), F.lit(0)).cast("long").alias("bytes_written"))


def snapshot(counted: DataFrame, precision: int = 9) -> DataFrame:
    return counted.withColumn("hit_ratio", F.round(ratio(F.col("hits"), F.col("hits") + F.col("misses") + F.col("evicted_reads")), precision)).withColumn("waf", F.round(ratio(F.col("bytes_written"), F.col("bytes_payload")), precision))


def full_snapshot(outcomes: DataFrame, leaf: DataFrame, regions: DataFrame, journal: DataFrame, batch_pages: int, capacity_bytes: int) -> DataFrame:
    """One row of all counters and ratios.

    ``regions`` (dev, epoch, written_pages, live_pages), ``journal`` (bytes,
    dropped) of the log's records; writes are taken in batches of ``batch_pages``
    pages a region.
    """
    calls = counters(outcomes)
    errors = outcomes.agg(F.count_if(F.col("outcome") == "EINVAL").alias("puts_err"), F.max("seq").alias("ver"))
    live = leaf.agg(F.count(F.lit(1)).alias("leaves"))
    space = regions.agg(
        F.sum(F.ceil(F.col("written_pages") / batch_pages)).cast("long").alias("batches"), (F.count(F.lit(1)) - F.count_distinct("dev")).alias("rotations"),
        F.sum(F.col("live_pages") * 4096).alias("live_bytes"), F.count_distinct("dev", F.col("epoch") % 64).alias("generations"))
    meta = journal.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("meta_bytes_written"), F.coalesce(F.sum("dropped"), F.lit(0)).cast("long").alias("journal_dropped"))
    row = calls
    for part in (errors, live, space, meta):  # one row each
        row = row.crossJoin(part)
    row = row.withColumn("drops", F.lit(0).cast("long")).withColumn("capacity_bytes", F.lit(capacity_bytes).cast("long"))
    total = F.col("bytes_written") + F.col("meta_bytes_written")
    return snapshot(row).withColumn("waf_total", F.round(ratio(total, F.col("bytes_payload")), 9)).withColumn("avg_batch_kib", F.round(ratio(F.col("bytes_written"), F.col("batches")) / 1024, 9))


def value_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(metric, value) of the asked names; an unknown one is 0."""
    return names.join(rows, "metric", "left").select("metric", F.coalesce("value", F.lit(0)).alias("value"))


def overflow_alarm(snapshot_: DataFrame) -> DataFrame:
    """The alarm line of a dump: records that a journal dropped before a checkpoint, or none."""
    dropped = F.col("journal_dropped")
    return snapshot_.select(dropped, F.when(dropped > 0, F.format_string("journal overflow: %d records dropped", dropped)).otherwise("").alias("alarm"))


def rates(phases: DataFrame, seconds: Column) -> DataFrame:
    """Operations and MiB a second of phases (d_puts, d_gets, d_bytes); 0 for a phase without time."""
    per = lambda x: F.round(F.when(seconds > 0, x / seconds).otherwise(F.lit(0.0)), 6)
    return phases.withColumn("put_iops", per(F.col("d_puts"))).withColumn("get_iops", per(F.col("d_gets"))).withColumn("w_mibps", per(F.col("d_bytes") / 1048576))


def as_rows(one_row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row table, for the CSV sink."""
    return one_row.unpivot([], one_row.columns, "metric", "value") if len({t for _, t in one_row.dtypes}) == 1 else one_row.select(*[F.col(c).cast("string").alias(c) for c in one_row.columns]).unpivot([], one_row.columns, "metric", "value")


def phase_deltas(phases: DataFrame, order: str, *names: str) -> DataFrame:
    """Differences of cumulative counters between phases; one row a phase."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return phases.select(order, *[(F.col(n) - F.coalesce(F.lag(n).over(w), F.lit(0))).alias(f"d_{n}") for n in names])


def format_ns(ns: Column) -> Column:
    return (F.when(ns < 1000, F.format_string("%dns", ns)).when(ns < 1_000_000, F.format_string("%d.%dus", F.floor(ns / 1000), F.floor(ns / 100) % 10))
            .when(ns < 1_000_000_000, F.format_string("%d.%dms", F.floor(ns / 1_000_000), F.floor(ns / 100_000) % 10)).otherwise(F.format_string("%d.%ds", F.floor(ns / 1_000_000_000), F.floor(ns / 100_000_000) % 10)))


def bars(hist: DataFrame, width: int = 40, *by: str) -> DataFrame:
    """A text bar a bucket, scaled to the largest."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return hist.withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.col("n") * width / F.max("n").over(w)).cast("int")))
