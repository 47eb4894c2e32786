"""Prefix index: materialised nodes of the radix tree, hit roll-up, hotness.

A node is the content address of its path, so lookups are equal joins and no
recursion is needed; ``parent`` is the address one group shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INLINE_EDGES = 8
HOT_THRESHOLD = 64


def nodes(addressed: DataFrame) -> DataFrame:
    """Distinct nodes of rows (group_idx, address, parent): address, parent, depth, docs."""
    return addressed.groupBy("address", "parent").agg(F.min(F.col("group_idx") + 1).alias("depth"), F.count(F.lit(1)).alias("docs"))


def nodes_by_depth(node: DataFrame) -> DataFrame:
    return node.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum("docs").alias("visits"))


def fanout(node: DataFrame) -> DataFrame:
    """Per number of children: nodes with so many, and whether they overflow the inline edges."""
    per = node.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    return per.groupBy("children").agg(F.count(F.lit(1)).alias("nodes")).withColumn("overflow", F.col("children") > INLINE_EDGES)


def ascended_hits(hits: DataFrame) -> DataFrame:
    """Hit counts of the nodes of (prefix_id, group_idx) hits: each hit counts at its node and all ancestors.

    A leaf at group g has depth g + 1; depth 0 is the root.  Hits are summed per
    address before they are spread over the path.
    """
    per = hits.groupBy("prefix_id", "group_idx").agg(F.count(F.lit(1)).alias("n"))
    spread = per.select("prefix_id", "n", F.explode(F.sequence(F.lit(0), F.col("group_idx") + 1)).alias("depth"))
    return spread.groupBy(F.when(F.col("depth") > 0, F.col("prefix_id")).otherwise(0).alias("prefix_id"), "depth").agg(F.sum("n").alias("hits"))


def hot_paths(counts: DataFrame, threshold: int = HOT_THRESHOLD) -> DataFrame:
    """Addresses that are hot: the node above the target, or the one above that, has more hits than the threshold."""
    target = counts.where("depth > 0").select("prefix_id", (F.col("depth") - 1).alias("group_idx"))
    above = counts.select(F.col("prefix_id").alias("p1"), F.col("depth").alias("d1"), F.col("hits").alias("parent_hits"))
    upper = counts.select(F.col("prefix_id").alias("p2"), F.col("depth").alias("d2"), F.col("hits").alias("grand_hits"))
    own = lambda depth: F.when(depth > 0, F.col("prefix_id")).otherwise(0)  # noqa: E731  the root has prefix 0
    one = target.join(above, (own(F.col("group_idx")) == F.col("p1")) & (F.col("group_idx") == F.col("d1")), "left")
    two = one.join(upper, (own(F.col("group_idx") - 1) == F.col("p2")) & (F.col("group_idx") - 1 == F.col("d2")), "left")
    hot = (F.coalesce("parent_hits", F.lit(0)) > threshold) | (F.coalesce("grand_hits", F.lit(0)) > threshold)
    return two.select("prefix_id", "group_idx", F.coalesce("parent_hits", F.lit(0)).alias("parent_hits"), F.coalesce("grand_hits", F.lit(0)).alias("grand_hits"), hot.alias("hot"))


def visit(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes in depth-first order of their addresses, stopping early after ``most`` (a feature)."""
    return nodes.orderBy("depth", "address").limit(most)


def decayed(hits: Column, ticks: Column) -> Column:
    """Floor halving, ``ticks`` times."""
    return F.call_function("shiftright", hits, F.least(ticks, F.lit(62)).cast("int"))


def decay_by_tick(events: DataFrame, *key: str) -> DataFrame:
    """Counts at each tick's end: hits of the tick are added, then the total is halved.

    Rows (key.., tick, hits), one a key and tick.  Halving with hits in between is
    a fold over a key's ticks, whose number is bounded by the ticks, not the rows.
    """
    ordered = events.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tick", "hits"))).alias("steps"))
    folded = F.aggregate(
        "steps", F.struct(F.lit(0).cast("long").alias("count"), F.element_at("steps", 1).tick.alias("tick")),
        lambda a, s: F.struct((decayed(a["count"], s.tick - a.tick) + s.hits).alias("count"), s.tick.alias("tick")))
    return ordered.select(*key, folded.alias("f")).select(*key, F.col("f.tick").alias("last_tick"), F.col("f.count").alias("hits"))

