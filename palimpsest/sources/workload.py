"""Workload generator: uniform, zipf and sequential keys from a range, deterministic per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.hashing import with_mix64

#: Terms of a stretch of the CDF; keys whose CDF is broadcast as one array.
STRETCH, BROADCAST_KEYS = 1 << 16, 1 << 20


def zipf_cdf(spark: SparkSession, n: int, theta: float = 1.0) -> DataFrame:
    """(k, cdf) for k = 1..n: cumulated 1/k**theta over its sum, in stretches of ``STRETCH`` terms."""
    terms = spark.range(1, n + 1).select(F.col("id").alias("k"), (1 / F.pow(F.col("id"), F.lit(theta))).alias("t"), F.expr(f"(id - 1) div {STRETCH}").alias("part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = terms.groupBy("part").agg(F.sum("t").alias("s"))  # one row a stretch
    parts = sums.select("part", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("ahead"), F.sum("s").over(Window.partitionBy()).alias("all"))
    inner = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return terms.join(F.broadcast(parts), "part").select("k", ((F.col("ahead") + F.sum("t").over(inner)) / F.col("all")).alias("cdf"))


def keys(spark: SparkSession, n_ops: int, n_keys: int, kind: str = "uniform", seed: int = 1, theta: float = 1.0) -> DataFrame:
    """(i, key), keys from 1.  A row's draw is the finalised hash of its number and the seed, as 53 bits of a fraction."""
    mixed = with_mix64(spark.range(n_ops).withColumnRenamed("id", "i"), F.col("i") + seed * (1 << 32), "m")
    ops = mixed.select("i", (F.shiftrightunsigned("m", 11) / float(1 << 53)).alias("u"))
    if kind == "sequential":
        return ops.select("i", (F.col("i") % n_keys + 1).alias("key"))
    if kind == "uniform":
        return ops.select("i", (F.floor(F.col("u") * n_keys) + 1).alias("key"))
    if n_keys > BROADCAST_KEYS:
        return _by_ranges(ops, zipf_cdf(spark, n_keys, theta))
    # The CDF, n_keys numbers, as one sorted array: the first k whose cdf reaches u by binary search over its bits.
    cdf = zipf_cdf(spark, n_keys, theta).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda x: x.cdf).alias("cdf"))
    steps = max(1, n_keys.bit_length())
    search = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(n_keys - 1).alias("hi")), lambda s, _: F.when(s.lo >= s.hi, s).when(
        F.element_at("cdf", ((s.lo + s.hi) / 2).cast("int") + 1) < F.col("u"), F.struct((((s.lo + s.hi) / 2).cast("int") + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), ((s.lo + s.hi) / 2).cast("int").alias("hi"))), lambda s: s.lo + 1)
    return ops.crossJoin(F.broadcast(cdf)).select("i", search.cast("long").alias("key"))


def _by_ranges(ops: DataFrame, cdf: DataFrame, cells: int = 1 << 14) -> DataFrame:
    """The first k whose cdf reaches u, by an as-of window in each cell of [0, 1): cells hold equal shares of the draws.

    A cell's rows end with the first k beyond it, which is the least k of a later cell.
    """
    steps = cdf.select(F.floor(F.col("cdf") * cells).alias("cell"), F.col("cdf").alias("u"), "k", F.lit(None).cast("long").alias("i"))
    firsts = steps.groupBy("cell").agg(F.min("k").alias("first"))  # at most one row a cell
    grid = cdf.sparkSession.range(cells).select(F.col("id").alias("cell")).join(firsts, "cell", "left")
    beyond = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    after = grid.select("cell", F.coalesce(F.min("first").over(beyond), cdf.agg(F.max("k")).scalar()).alias("after"))
    draws = ops.select(F.floor(F.col("u") * cells).alias("cell"), "u", F.lit(None).cast("long").alias("k"), "i")
    w = Window.partitionBy("cell").orderBy("u", F.col("k").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    found = draws.unionByName(steps).withColumn("next", F.min("k").over(w))
    return found.where("i IS NOT NULL").join(F.broadcast(after), "cell").select("i", F.coalesce("next", "after").alias("key"))
