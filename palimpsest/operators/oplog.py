"""The operation log: PUT, GET and EVICT calls as rows.

Columns: seq, ts, now_s, op, prefix_id, group_idx, payload_len, expire_ts.
``seq`` is the total order; an address is (prefix_id, group_idx).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GROUPS = 256
MAX_LAYERS = 256
ADDRESS = ["prefix_id", "group_idx"]


def from_events(events: DataFrame) -> DataFrame:
    """The log that the driver's event table stands for."""
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    base = events.select(
        F.col("event_id").alias("seq"), "ts",
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("now_s"),
        F.when(F.col("event_type").isin("signup", "purchase"), "PUT").when(F.col("event_type") == "error", "EVICT").otherwise("GET").alias("op"),
        (F.col("user_id") + 1).alias("prefix_id"),
        (k % 4).alias("group_idx"),
        (F.round(F.col("value") * 100).cast("long") * 64).alias("payload_len"),
        k.alias("k"),
    )
    return base.withColumn("expire_ts", F.when(F.col("k") % 5 == 0, F.col("now_s") + 86400).otherwise(F.lit(0).cast("long"))).drop("k")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def validated(ops: DataFrame, n_layers=None, max_layers: int = MAX_LAYERS) -> DataFrame:
    """Adds rc: EINVAL where the group, or a PUT's layer count, is out of range, else OK."""
    bad = (F.col("group_idx") < 0) | (F.col("group_idx") >= MAX_GROUPS)
    if n_layers is not None:
        bad = bad | ((F.col("op") == "PUT") & ((n_layers < 1) | (n_layers > max_layers)))
    return ops.withColumn("rc", F.when(bad, -11).otherwise(0)).withColumn("rc_name", F.when(F.col("rc") == 0, "OK").otherwise("EINVAL"))


#: The same log as SQL, for the oracles.
SQL = """
ops AS (
  SELECT event_id AS seq, ts, epoch_us(ts) // 1000000 AS now_s,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'PUT' WHEN event_type = 'error' THEN 'EVICT' ELSE 'GET' END AS op,
         user_id + 1 AS prefix_id, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) % 4 AS group_idx,
         CAST(round(value * 100) AS BIGINT) * 64 AS payload_len,
         CASE WHEN CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS INTEGER) % 5 = 0 THEN epoch_us(ts) // 1000000 + 86400 ELSE 0 END AS expire_ts
  FROM events)
"""
