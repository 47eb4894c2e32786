"""State as SQL: temporary views over the log, and SQL functions for the scalar operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from palimpsest.functions import metrics
from palimpsest.operators import oplog, placement, state


def register(spark: SparkSession, sf_dir: str, prefix: str = "") -> None:
    """Views ops, outcomes, prefixes, leaves, tombstones, regions and counters, and functions payload_pages, stripe_count and log2_bucket."""
    ops = oplog.read(spark, sf_dir)
    outcomes = state.point_in_time(ops)
    leaf = state.leaves(ops)
    tables = {
        "ops": ops, "outcomes": outcomes, "prefixes": state.outcomes_by_prefix(ops), "leaves": leaf, "tombstones": state.tombstones(ops),
        "regions": placement.live_bytes(placement.with_regions(ops.where("op = 'PUT'"), 4, 8192), leaf), "counters": metrics.snapshot(metrics.counters(outcomes)),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    for body in (
        f"payload_pages(n BIGINT) RETURNS BIGINT RETURN (n + {placement.PAGE - 1}) DIV {placement.PAGE}",
        f"stripe_count(n BIGINT) RETURNS INT RETURN CASE WHEN n > {placement.STRIPE_THRESHOLD} THEN CAST((n + {placement.STRIPE_UNIT - 1}) DIV {placement.STRIPE_UNIT} AS INT) ELSE 1 END",
        f"log2_bucket(n BIGINT) RETURNS INT RETURN CASE WHEN n <= 0 THEN 0 ELSE LEAST({metrics.LAST_BUCKET}, LENGTH(BIN(n)) - 1) END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
