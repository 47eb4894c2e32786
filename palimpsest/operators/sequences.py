"""Saved sequences: thin wrappers that key a whole token sequence and use the log's operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import with_sequence_key


def keyed(sequences: DataFrame) -> DataFrame:
    """Rows (sequence_id, tokens) with prefix_id and group 0."""
    return with_sequence_key(sequences, F.col("sequence_id"), F.col("tokens"), "prefix_id").withColumn("group_idx", F.lit(0))


def _calls(sequences: DataFrame, op: str, size: Column, now: Column, first_seq: int) -> DataFrame:
    # A call's place is its row's number in the batch of calls: unique, and no order over all calls is worked out.
    order = F.monotonically_increasing_id()
    return keyed(sequences).select((F.lit(first_seq) + order).cast("long").alias("seq"), now.cast("long").alias("now_s"), F.lit(op).alias("op"), "prefix_id", "group_idx", size.cast("long").alias("payload_len"), F.lit(0).cast("long").alias("expire_ts"))


def save(sequences: DataFrame, size: Column, now: Column, first_seq: int) -> DataFrame:
    """PUT rows of one opaque record each."""
    return _calls(sequences, "PUT", size, now, first_seq)


def evict(sequences: DataFrame, now: Column, first_seq: int) -> DataFrame:
    return _calls(sequences, "EVICT", F.lit(0), now, first_seq)


def has(sequences: DataFrame, leaf: DataFrame) -> DataFrame:
    return keyed(sequences).join(leaf.select("prefix_id", "group_idx"), ["prefix_id", "group_idx"], "left_semi").select("sequence_id")


def restore(sequences: DataFrame, leaf: DataFrame) -> DataFrame:
    """Version and size of what is stored, null where nothing is."""
    return keyed(sequences).join(leaf.select("prefix_id", "group_idx", "ver", "payload_len"), ["prefix_id", "group_idx"], "left").select("sequence_id", "ver", "payload_len")
