"""Corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result in the
shared folder and hands it on.  No stage's rows can be written as SQL.
"""

from palimpsest.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from palimpsest.llm.common import written


def toxicity_stage(spark, docs, sf_dir):
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group linked by five-word similarity of 0.8, the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark, docs, sf_dir):
    """Per document: its size, and the words the mix takes of it."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
