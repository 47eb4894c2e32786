"""Exact dedup by content sort, with DataFrame functions only.

Rows are written once with the SHA-256 of their normalised text, so that no
later pass works it out again.  They are range-partitioned on a bounded key of
the normalised text (its first characters, then the digest), using Spark's
sampled splitters.  Inside a range an external sort on that key, then the whole
normalised text, places equal texts side by side; each text is compared in full
with the one before it, and a run of equals keeps its smallest id.

A text that makes up more than 1/``HOT_PARTS`` of all rows would be one range
that cannot be split.  There are fewer than ``HOT_PARTS`` such texts, so their
digests are broadcast, and their rows get a salt: each salted part is compared
by itself, and then one row per part is compared with the heads of the other
parts.

Defined cases: a null text counts as empty; rows with equal texts and equal ids
keep exactly one row; a null id sorts after all others, so it is kept only if
its group has no other id; an empty table gives an empty result.  Very long
texts are compared whole.  Columns beyond ``doc_id`` and ``text`` are carried
along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: A text with more than this part of all rows is salted: at most HOT_PARTS texts.
HOT_PARTS = 1000
#: Characters of the normalised text that lead the range key.
LEAD = 32


def normalised(text: Column) -> Column:
    """Null as empty; each run of space, tab, LF, VT, FF and CR becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept and text_sha256.

    ``keep_rows``: put the input row in a struct column ``row`` instead of the id.
    """
    norm = normalised(F.col(f"`{text_col}`"))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]) if keep_rows else F.lit(0)
    # A carried row holds its own text; the normalised one is then made again behind the shuffle, and not sent twice.
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), norm.alias("__norm"), row.alias("__row"))
    keyed = written(base.select(
        "__id", "__row", F.monotonically_increasing_id().alias("__at"), F.when(F.lit(not keep_rows), F.col("__norm")).alias("__norm"),
        F.substring("__norm", 1, LEAD).alias("__lead"), F.sha2(F.col("__norm").cast("binary"), 256).alias("__sha")), "digests")
    whole = normalised(F.col("__row").getField(text_col)) if keep_rows else F.col("__norm")

    sizes = keyed.groupBy("__sha").agg(F.count(F.lit(1)).alias("__n"))
    total = keyed.agg(F.count(F.lit(1))).scalar()
    hot = sizes.where(F.col("__n") * HOT_PARTS > total).select("__sha", F.greatest(F.lit(1), F.ceil(F.col("__n") * HOT_PARTS / total)).alias("__parts"))
    # At most HOT_PARTS rows. The row numbers are written, so a retried task deals alike; null ids are spread too.
    salt = F.pmod(F.xxhash64("__at"), F.coalesce(F.col("__parts"), F.lit(1)))
    key = ["__lead", "__sha", "__salt"]
    sorted_ = Window.partitionBy(*key).orderBy("__text", F.col("__id").asc_nulls_last())
    run = Window.partitionBy(*key, "__run")

    def runs(how: str, *carried: str) -> DataFrame:
        """Rows beside their equals: rank, smallest id and size within their (salted) part."""
        dealt = (
            keyed.join(F.broadcast(hot), "__sha", how)
            .withColumn("__salt", salt)
            .withColumn("__hot", F.col("__parts").isNotNull())
            .select("__id", "__norm", "__row", *key, "__hot")
            .repartitionByRange(*key)
            .withColumn("__text", whole)
        )
        # Whole texts of neighbours in sorted order; unlike ones start a new run.
        compared = dealt.select("*", F.coalesce(F.col("__text") != F.lag("__text").over(sorted_), F.lit(True)).cast("int").alias("__new"))
        numbered = compared.select("__id", *carried, *key, "__hot", F.when(F.col("__hot"), F.col("__text")).alias("__text"), F.sum("__new").over(sorted_.rowsBetween(Window.unboundedPreceding, 0)).alias("__run"))
        return numbered.select(
            "__id", "__sha", "__salt", "__hot", "__text", *carried,
            F.row_number().over(run.orderBy(F.col("__id").asc_nulls_last())).alias("__rank"),
            F.min("__id").over(run).alias("__keep"),
            F.count(F.lit(1)).over(run).alias("__size"),
        )

    # Heads of hot parts: fewer than 2 * HOT_PARTS rows, compared whole again. Only hot rows move for them.
    heads = runs("inner").where("__rank = 1").groupBy("__sha", "__text").agg(
        F.min("__keep").alias("__keep_all"), F.sum("__size").alias("__size_all"),
        F.min(F.struct(F.col("__keep").isNull().alias("none"), F.col("__keep").alias("id"), F.col("__salt").alias("salt"))).alias("__first"))
    merged = heads.select(
        "__sha", F.sha2(F.concat(F.lit("\x01"), F.col("__text")).cast("binary"), 256).alias("__tag"),
        "__keep_all", "__size_all", F.col("__first.salt").alias("__first_salt"))
    tagged = runs("left", "__row").withColumn("__tag", F.sha2(F.concat(F.lit("\x01"), F.col("__text")).cast("binary"), 256)).drop("__text")
    joined = tagged.join(F.broadcast(merged), ["__sha", "__tag"], "left")
    kept = (F.col("__rank") == 1) & F.coalesce(F.col("__salt") == F.col("__first_salt"), F.lit(True))
    out = joined.select(
        F.col("__id").alias(id_col), F.col("__row").alias("row"),
        F.when(F.col("__hot"), F.col("__keep_all")).otherwise(F.col("__keep")).alias("keep_id"),
        F.when(F.col("__hot"), F.col("__size_all")).otherwise(F.col("__size")).alias("group_size"),
        kept.alias("kept"), F.col("__sha").alias("text_sha256"))
    return out.drop(id_col) if keep_rows else out.drop("row")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    marked = mark_duplicates(docs, id_col, text_col, keep_rows=True).where("kept")
    return marked.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
