"""Garbage collection over regions and generations, as single ticks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.placement import PAGE


def frozen(regions: DataFrame) -> DataFrame:
    """Every region of a device but its newest, which is open."""
    w = Window.partitionBy("dev")
    return regions.withColumn("state", F.when(F.col("epoch") == F.max("epoch").over(w), "OPEN").otherwise("FROZEN"))


def epoch_trim(regions: DataFrame, now: Column, epoch_secs: int) -> DataFrame:
    """Frozen regions without live bytes whose time is over."""
    return frozen(regions).where((F.col("state") == "FROZEN") & (F.col("live_bytes") == 0) & F.col("close_s").isNotNull() & (now > F.col("base_s") + epoch_secs))


def victims(regions: DataFrame, least: int = 0) -> DataFrame:
    """Per device, the region to free by force: an empty frozen one first, else the least live, then the oldest.

    ``least``: leave out regions with fewer live bytes; compaction has nothing to do in empty ones.
    """
    return frozen(regions).where((F.col("state") == "FROZEN") & (F.col("live_bytes") >= least)).groupBy("dev").agg(F.min(F.struct("live_bytes", "epoch")).alias("v")).select("dev", F.col("v.epoch").alias("epoch"), F.col("v.live_bytes").alias("live_bytes"))


def oldest_generations(regions: DataFrame, now: Column, min_age: int, step: int) -> DataFrame:
    """Frozen regions of the ``step`` oldest epochs old enough, on all devices."""
    old = frozen(regions).where((F.col("state") == "FROZEN") & (now - F.col("close_s") >= min_age))
    epochs = old.select("epoch").distinct().orderBy("epoch").limit(step)  # a feature: at most ``step`` a tick
    return old.join(F.broadcast(epochs), "epoch", "left_semi")


def drop_regions(leaf: DataFrame, gone: DataFrame, pinned: Column | None = None) -> DataFrame:
    """Leaves that stay after regions (dev, epoch) go; pinned ones stay."""
    hit = leaf.join(gone.select("dev", "epoch", F.lit(True).alias("gone")), ["dev", "epoch"], "left")
    stay = F.col("gone").isNull() if pinned is None else F.col("gone").isNull() | pinned
    return hit.where(stay).drop("gone")


def generations(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count_distinct("dev", F.col("epoch") % 64).alias("generations"), F.count(F.lit(1)).alias("regions"))


def capacity(devices: DataFrame) -> DataFrame:
    """Of (dev, region_cnt, region_pages)."""
    return devices.agg(F.sum(F.col("region_cnt") * F.col("region_pages") * PAGE).alias("capacity_bytes"))


def watermark_latch(ticks: DataFrame, capacity_bytes: int, start_pct: int, stop_pct: int) -> DataFrame:
    """Two-threshold latch over rows (tick, live_bytes), one a tick: draining from start until stop."""
    w = Window.partitionBy(F.lit(0)).orderBy("tick")
    edge = F.when(F.col("live_bytes") * 100 > capacity_bytes * start_pct, 1).when(F.col("live_bytes") * 100 <= capacity_bytes * stop_pct, 0)
    held = ticks.withColumn("draining", F.coalesce(F.last_value(edge, F.lit(True)).over(w), F.lit(0)))
    return held.withColumn("triggered", ((F.col("draining") == 1) & (F.coalesce(F.lag("draining").over(w), F.lit(0)) == 0)).cast("int"))


def compaction(leaf: DataFrame, gone: DataFrame, pinned: Column, threshold: int, most: int = 1024) -> DataFrame:
    """Live, unpinned, unstriped leaves of the victims that are written anew: per device at most ``most`` (a feature), oldest first."""
    rows = leaf.join(gone.select("dev", "epoch"), ["dev", "epoch"], "left_semi").where(~pinned & (F.col("payload_len") <= threshold))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("dev").orderBy("ver"))).where(F.col("rank") <= most).drop("rank")


def trim_seqs(regions: DataFrame, ring: int) -> DataFrame:
    """(dev, epoch, trim_seq): a device holds ``ring`` regions; the first write of a new one frees the oldest.

    Regions (dev, epoch, first_seq); those still held have no row.
    """
    later = regions.select("dev", (F.col("epoch") - ring).alias("epoch"), F.col("first_seq").alias("trim_seq"))
    return regions.select("dev", "epoch").join(later, ["dev", "epoch"])


def after_trims(leaf: DataFrame, trims: DataFrame) -> DataFrame:
    """Leaves (with dev, epoch) that survive a replay with TRIM records: those of no trimmed region."""
    return leaf.join(trims.select("dev", "epoch"), ["dev", "epoch"], "left_anti")


def moved(plan: DataFrame, now: DataFrame) -> DataFrame:
    """What a compaction writes anew: planned leaves whose address still has the planned version; others are skipped."""
    current = now.select("prefix_id", "group_idx", F.col("ver").alias("now_ver"))
    guarded = plan.join(current, ["prefix_id", "group_idx"], "left")
    return guarded.withColumn("moved", F.coalesce(F.col("now_ver") == F.col("ver"), F.lit(False))).drop("now_ver")


def checkpoint_due(used: Column, on_last_page: Column, dropped: Column, most: int = 3276) -> Column:
    """Whether a device's journal asks for a checkpoint: nearly full page, last page, or records dropped since the last one."""
    return (used > most) | on_last_page | (dropped > 0)
