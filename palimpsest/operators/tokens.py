"""Token groups, content addresses and stored prefixes.

Tokens are the pieces of a text between single spaces; a group has 32 of them,
the last may be partial.  A group's content address is the hash of all tokens
up to its end, so equal prefixes share addresses.  Hashes are chained over the
groups, so a text of n groups costs n hashes of one group each, not n prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 32


def tokens_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), " ")


def split_groups(df: DataFrame, tokens: Column, *keep: str, group: int = GROUP) -> DataFrame:
    """One row a group: keep.., group_idx, n_tokens, group_tokens."""
    groups = df.select(*keep, tokens.alias("tokens")).select(
        *keep, F.posexplode(F.transform(F.sequence(F.lit(0), ((F.size("tokens") - 1) / group).cast("int")), lambda i: F.slice("tokens", i * group + 1, group))).alias("group_idx", "group_tokens"))
    return groups.withColumn("n_tokens", F.size("group_tokens"))


def addresses(df: DataFrame, tokens: Column, *keep: str, group: int = GROUP) -> DataFrame:
    """One row a group: keep.., group_idx, n_tokens, its ``address`` (a chained md5 of its tokens and the address before it) and ``parent`` (that address, null for the first)."""
    cut = df.select(*keep, tokens.alias("tokens")).withColumn("groups", F.transform(F.sequence(F.lit(0), ((F.size("tokens") - 1) / group).cast("int")), lambda i: F.slice("tokens", i * group + 1, group)))
    # The fold keeps the chain as an array whose last element is the hash so far.
    chain = F.aggregate("groups", F.array(F.lit("")), lambda acc, g: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), F.lit("|"), F.array_join(g, " ")).cast("binary")))))
    chained = cut.select(*keep, F.transform("groups", lambda g: F.size(g)).alias("sizes"), chain.alias("chain"))
    zipped = F.arrays_zip("sizes", F.slice("chain", 2, F.size("sizes")).alias("address"), F.slice("chain", 1, F.size("sizes")).alias("parent"))
    rows = chained.select(*keep, F.posexplode(zipped).alias("group_idx", "g"))
    return rows.select(*keep, "group_idx", F.col("g.sizes").alias("n_tokens"), F.col("g.address").alias("address"), F.nullif(F.col("g.parent"), F.lit("")).alias("parent"))


def shared_addresses(addressed: DataFrame, doc: str = "doc_id") -> DataFrame:
    return addressed.groupBy("address", "group_idx").agg(F.count(F.lit(1)).alias("copies"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc"))


def sharing_by(addressed: DataFrame, *by: str) -> DataFrame:
    """Pages, distinct pages and the ratio kept by sharing, rolled up from counts per address."""
    per = addressed.groupBy(*by, "address").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("distinct_pages")).withColumn("distinct_ratio", F.round(F.col("distinct_pages") / F.col("pages"), 9))


def stored_prefix(probes: DataFrame, stored: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per probe: how many of its groups are stored without a gap from the first."""
    found = stored.select("address").distinct().withColumn("found", F.lit(1))
    joined = probes.join(found, "address", "left")
    return joined.groupBy(doc).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.min(F.when(F.col("found").isNull(), F.col("group_idx"))).cast("long"), F.count(F.lit(1))).alias("stored_prefix"))


def stored_before(addressed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: how many of its groups documents with smaller ids have stored, without a gap from the first."""
    first = addressed.groupBy("address").agg(F.min(doc).alias("first"))
    joined = addressed.join(first, "address")
    gap = F.min(F.when(F.col("first") == F.col(doc), F.col("group_idx"))).cast("long")
    return joined.groupBy(doc).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(gap, F.count(F.lit(1))).alias("stored_prefix"))


#: Groups with chained addresses as SQL over a relation d(doc, tokens), for the oracles.
def sql(source: str, keep: str) -> str:
    return f"""
RECURSIVE d AS ({source}),
g AS (SELECT {keep}, 0 AS group_idx, tokens, len(tokens[1:32]) AS n_tokens, md5('' || '|' || array_to_string(tokens[1:32], ' ')) AS address FROM d
      UNION ALL
      SELECT {keep}, group_idx + 1, tokens, len(tokens[(group_idx + 1) * 32 + 1:(group_idx + 2) * 32]), md5(address || '|' || array_to_string(tokens[(group_idx + 1) * 32 + 1:(group_idx + 2) * 32], ' '))
      FROM g WHERE (group_idx + 1) * 32 < len(tokens))
"""
