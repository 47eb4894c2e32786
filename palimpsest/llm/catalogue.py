"""Queries and SQL of this subpackage."""

from palimpsest.llm import decontaminate, exact_dedup, language, lattice, mixing, quality, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_language_id": language.op6_language_id,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_lm_scoring": lattice.op9_lm_scoring,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {"op2_warc": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
