"""Journal, checkpoint and recovery as folds over append-only tables, ordered by one global seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.oplog import ADDRESS
from palimpsest.operators.state import leaves

RECORD_BYTES = 64
PAGE = 4096


def record_bytes(n_lens: Column, path_depth: Column) -> Column:
    """A journal record: its head and check, 4 bytes a stored length, 8 a path step."""
    return F.lit(RECORD_BYTES + 4) + n_lens * 4 + path_depth * 8


def records_per_page(size: Column, page: int = PAGE) -> Column:
    """Records do not straddle pages."""
    return F.floor(F.lit(page) / size).cast("int")


def valid_prefix(journal: DataFrame, valid: Column, *stream: str) -> DataFrame:
    """Per stream, the records before the first invalid one."""
    w = Window.partitionBy(*stream).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return journal.withColumn("__ok", F.min(valid.cast("int")).over(w)).where("__ok = 1").drop("__ok")


def fold(journal: DataFrame) -> DataFrame:
    """Leaves after replay."""
    return leaves(journal)


def checkpoint(journal: DataFrame, upto: Column) -> DataFrame:
    """The leaves at ``upto``, as a table to be written."""
    return leaves(journal.where(F.col("seq") <= upto))


def recover(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """Leaves from a checkpoint and the journal after it: the newest change of an address counts."""
    kept = snapshot.select(*ADDRESS, F.lit("PUT").alias("op"), F.col("ver").alias("seq"), F.col("written_s").alias("now_s"), "payload_len", "expire_ts")
    changes = tail.where("op <> 'GET'").select(*ADDRESS, "op", "seq", "now_s", "payload_len", "expire_ts")
    return leaves(kept.unionByName(changes))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one and not in the other; none when recovery is right."""
    return a.exceptAll(b).withColumn("side", F.lit("only_left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right")))


def stripes_complete(parts: DataFrame) -> DataFrame:
    """Replayed stripes that publish: all parts are there."""
    return parts.groupBy("seq").agg(F.count_distinct("part").alias("have"), F.max("n_parts").alias("n_parts")).where("have = n_parts")


def newest_superblock(blocks: DataFrame, *key: str) -> DataFrame:
    """The valid block with the highest (epoch, fmt_ts)."""
    return blocks.where("valid").groupBy(*key).agg(F.max_by(F.struct("slot", "epoch", "fmt_ts"), F.struct("epoch", "fmt_ts")).alias("b")).select(*key, "b.*")


def region_states(devices: DataFrame, headers: DataFrame) -> DataFrame:
    """All (dev, region) with their header's state; a missing or invalid header is FREE."""
    valid = headers.where("valid").select("dev", "region", "state", "epoch")
    return devices.join(valid, ["dev", "region"], "left").select("dev", "region", F.coalesce("state", F.lit("FREE")).alias("state"), F.coalesce("epoch", F.lit(0)).alias("epoch"))
