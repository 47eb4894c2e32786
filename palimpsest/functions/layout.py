"""Cache layout maths of attention models, as columns over a table of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "name string, kind string, n_layers int, n_q_heads int, n_kv_heads int, head_dim int, dtype_bytes int, latent_dim int, rope_dim int, window int, attn_layers int, tokens_per_group int"
#: Published shapes of models. Name, kind, layers, query heads, kv heads, head size, bytes a number, latent, rope.
PRESETS = [
    ("llama-3.1-8b", "GQA", 32, 32, 8, 128, 2, 0, 0, 0, 0, 32),
    ("llama-3.1-70b", "GQA", 80, 64, 8, 128, 2, 0, 0, 0, 0, 32),
    ("llama-3.1-405b", "GQA", 126, 128, 8, 128, 2, 0, 0, 0, 0, 32),
    ("qwen2.5-1.5b", "GQA", 28, 12, 2, 128, 2, 0, 0, 0, 0, 32),
    ("qwen2.5-7b", "GQA", 28, 28, 4, 128, 2, 0, 0, 0, 0, 32),
    ("qwen2.5-72b", "GQA", 80, 64, 8, 128, 2, 0, 0, 0, 0, 32),
    ("mistral-7b", "GQA", 32, 32, 8, 128, 2, 0, 0, 0, 0, 32),
    ("gemma-2-9b", "GQA", 42, 16, 8, 256, 2, 0, 0, 0, 0, 32),
    ("glm-4-9b", "GQA", 40, 32, 2, 128, 2, 0, 0, 0, 0, 32),
    ("deepseek-v3", "MLA", 61, 128, 0, 128, 2, 512, 64, 0, 0, 32),
    ("falcon-7b", "MQA", 32, 71, 1, 64, 2, 0, 0, 0, 0, 32),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, FIELDS).coalesce(1)


def bytes_per_token_layer() -> Column:
    d = F.when(F.col("dtype_bytes") == 0, 2).otherwise(F.col("dtype_bytes")).cast("long")
    latent = (F.col("kind") == "MLA") | ((F.col("kind") == "SPARSE") & (F.col("latent_dim") > 0))
    return (F.when(F.col("kind") == "SSM", F.lit(0).cast("long")).when(latent, (F.col("latent_dim") + F.col("rope_dim")) * d)
            .when(F.col("kind") == "MQA", 2 * F.col("head_dim") * d).otherwise(2 * F.col("n_kv_heads") * F.col("head_dim") * d))


def kv_layers() -> Column:
    return F.when(F.col("kind") == "SSM", 0).when((F.col("kind") == "HYBRID") & (F.col("attn_layers") > 0), F.col("attn_layers")).otherwise(F.col("n_layers"))


def with_bytes(profiles: DataFrame) -> DataFrame:
    group = F.when(F.col("tokens_per_group") == 0, 32).otherwise(F.col("tokens_per_group"))
    df = profiles.withColumn("token_layer_bytes", bytes_per_token_layer()).withColumn("kv_layers", kv_layers())
    return df.withColumn("token_bytes", F.col("token_layer_bytes") * F.col("kv_layers")).withColumn("group_layer_bytes", F.col("token_layer_bytes") * group).withColumn("group_bytes", F.col("group_layer_bytes") * F.col("kv_layers"))


def context_bytes(tokens: Column) -> Column:
    """Needs ``with_bytes``: a sliding window keeps no more tokens than it holds."""
    return F.when((F.col("kind") == "SWA") & (F.col("window") > 0), F.least(tokens, F.col("window").cast("long"))).otherwise(tokens) * F.col("token_bytes")


def _up(x: Column, a: Column) -> Column:
    return F.ceil(x / a).cast("long") * a


def _down(x: Column, a: Column) -> Column:
    return F.floor(x / a).cast("long") * a


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold: 64-bit numbers need fewer than 93 steps."""
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), F.when(s.y == 0, F.lit(0).cast("long")).otherwise(s.x % F.greatest(s.y, F.lit(1).cast("long"))).alias("y"))), lambda s: s.x)


def tuned(profiles: DataFrame, page: int = 4096, region_bytes: int = 0, stripe: int = 256 << 10, batch: int = 256 << 10) -> DataFrame:
    """Alignment, stripe unit and threshold, batch, region alignment and largest memory entry of each profile with a cache."""
    df = with_bytes(profiles).where("group_bytes > 0")
    g, p, s = F.col("group_bytes"), F.lit(page).cast("long"), F.lit(stripe).cast("long")
    shared = _gcd(g, p)
    # The greatest power of two in a number that divides the page is that number's highest bit.
    df = df.withColumn("alignment", F.pow(F.lit(2), F.length(F.bin(shared)) - 1).cast("long"))
    df = df.withColumn("stripe_unit", _up(s, p * F.col("group_layer_bytes") / _gcd(p, F.col("group_layer_bytes"))).cast("long"))
    df = df.withColumn("stripe_threshold", F.when(g > s, _up(s, p)).otherwise(F.greatest(_down(s, g), g)))
    want = _up(F.greatest(F.lit(batch).cast("long"), g), p)
    df = df.withColumn("want", F.when(g <= F.col("stripe_threshold"), _up(want, g)).otherwise(want))
    df = df.withColumn("batch_min", F.greatest(F.when(F.col("want") > F.col("stripe_threshold"), _down(F.col("stripe_threshold"), p)).otherwise(F.col("want")), F.lit(0).cast("long")))
    df = df.withColumn("batch_min", F.when(F.col("batch_min") == 0, p).otherwise(F.col("batch_min"))).drop("want")
    aligned = _down(F.lit(region_bytes).cast("long"), g)
    return df.withColumn("region_align", F.when(aligned > 0, aligned).otherwise(g)).withColumn("dram_entry_max", _up(g, p))


def config_values(profiles: DataFrame, page: int = 4096) -> DataFrame:
    t = tuned(profiles, page)
    return t.select("name", F.when(F.col("tokens_per_group") == 0, 32).otherwise(F.col("tokens_per_group")).alias("n_groups_tokens"), F.col("kv_layers").alias("max_layers"), "stripe_unit", "stripe_threshold", F.col("batch_min").alias("batch_min_bytes"), F.col("group_bytes").alias("region_align_bytes"), F.col("dram_entry_max").alias("dram_entry_max_bytes"))


def _number(json: Column, key: str) -> Column:
    """First number of a key at any depth; 0 where there is none."""
    return F.coalesce(F.regexp_extract(json, f'"{key}"\\s*:\\s*(-?\\d+)', 1).try_cast("long"), F.lit(0).cast("long"))


def from_config_json(configs: DataFrame, json: Column) -> DataFrame:
    """Profiles from model configuration texts; ``rc`` is EINVAL where layers or heads are missing."""
    df = configs.select("*", *[_number(json, k).alias(v) for k, v in (("num_hidden_layers", "_layers"), ("num_attention_heads", "_q"), ("num_key_value_heads", "_kv"), ("head_dim", "_hd"), ("hidden_size", "_hidden"), ("kv_lora_rank", "_lora"), ("qk_rope_head_dim", "_rope"), ("qk_nope_head_dim", "_nope"))],
                        F.coalesce(F.nullif(F.regexp_extract(json, r'"torch_dtype"\s*:\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(json, r'"dtype"\s*:\s*"([^"]*)"', 1)).alias("_dt"))
    ok = (F.col("_layers") > 0) & (F.col("_q") > 0)
    kv = F.when(F.col("_kv") <= 0, F.col("_q")).otherwise(F.col("_kv"))
    hd = F.when(F.col("_nope") > 0, F.col("_nope")).otherwise(F.col("_hd"))
    hd = F.when(hd > 0, hd).when((F.col("_hidden") > 0) & (F.col("_q") > 0), F.expr("_hidden div nullif(_q, 0)")).otherwise(128)
    dt = F.when(F.col("_dt").contains("8"), 1).when(F.col("_dt").contains("32"), 4).otherwise(2)
    kind = F.when(F.col("_lora") > 0, "MLA").when(kv == 1, "MQA").when(kv == F.col("_q"), "MHA").otherwise("GQA")
    own = [c for c in configs.columns]
    return df.select(
        *own, F.when(ok, "OK").otherwise("EINVAL").alias("rc"), F.when(ok, kind).alias("kind"), *[F.when(ok, c).cast("int").alias(n) for c, n in ((F.col("_layers"), "n_layers"), (F.col("_q"), "n_q_heads"), (kv, "n_kv_heads"), (hd, "head_dim"), (dt, "dtype_bytes"), (F.col("_lora"), "latent_dim"), (F.col("_rope"), "rope_dim"), (F.lit(0), "window"), (F.lit(0), "attn_layers"), (F.lit(32), "tokens_per_group"))])
