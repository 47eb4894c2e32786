"""Connected components of a link table, by alternating large and small stars.

Both steps are joins and minimum aggregates over (node, neighbour) rows: no
neighbour list is gathered, so a node with very many links only makes a skewed
join side, which Spark splits.  Every round is written to the shared folder, and
the round before it removed; rounds go on until nothing is left to join.

Defined cases: repeated links, links in both directions and links of a node to
itself change nothing; rows with a null end are left out; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a, b): root is the smallest node reachable."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while edges.limit(1).count():
        # Large star: larger neighbours of a node move to the node's smallest neighbour (or itself).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of a node, and the node, move to its smallest neighbour.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "star")
        discard(edges)
        # Done when every node has one neighbour, and no neighbour has one of its own.
        nodes = new.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        pending = nodes.where("n > 1").select("u").union(new.select(F.col("v").alias("u")).join(nodes, "u", "left_semi")).limit(1).count()
        edges = new
        if not pending:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
