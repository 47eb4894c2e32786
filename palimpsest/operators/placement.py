"""Placement: pages, stripes, replicas, shapes and live bytes. Lengths travel, payloads do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.running import running_sum

PAGE = 4096
STRIPE_UNIT = 256 << 10
STRIPE_THRESHOLD = 1 << 20
MAX_PARTS = 1024
CHUNK_HEADER = 64
RECORD_HEADER = 8


def payload_pages(length: Column) -> Column:
    return F.ceil(length / PAGE).cast("long")


def framed_pages(length: Column, n_records: Column) -> Column:
    """Pages of a chunk with its header and a header a record."""
    return F.ceil((length + RECORD_HEADER * n_records + CHUNK_HEADER) / PAGE).cast("long")


def device(prefix: Column, n_devices: int) -> Column:
    """A deterministic device; ``hashing.routed`` gives the exact hashed one."""
    return F.pmod(prefix, F.lit(n_devices)).cast("int")


def stripe_count(length: Column, unit: int = STRIPE_UNIT, threshold: int = STRIPE_THRESHOLD) -> Column:
    return F.when(length > threshold, F.greatest(F.lit(1), F.ceil(length / unit))).otherwise(1).cast("int")


def stripe_parts(puts: DataFrame, n_devices: int, unit: int = STRIPE_UNIT, threshold: int = STRIPE_THRESHOLD) -> DataFrame:
    """One row a part of each PUT (seq, prefix_id, payload_len): its index, bytes, pages and device."""
    n = stripe_count(F.col("payload_len"), unit, threshold)
    parts = puts.withColumn("n_parts", n).where(F.col("n_parts") <= MAX_PARTS).select("*", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
    size = F.when(F.col("n_parts") == 1, F.col("payload_len")).otherwise(F.least(F.lit(unit).cast("long"), F.col("payload_len") - F.col("part").cast("long") * unit))
    return parts.withColumn("part_len", size).withColumn("part_pages", payload_pages(F.col("part_len"))).withColumn("dev", F.pmod(device(F.col("prefix_id"), n_devices) + F.col("part"), F.lit(n_devices)).cast("int"))


def register_functions(spark) -> None:
    """The table function stripe_split(length): a row (part, part_len) for each part."""

    @F.udtf(returnType="part int, part_len bigint")
    class Split:
        def eval(self, length: int):
            n = -(-length // STRIPE_UNIT) if length > STRIPE_THRESHOLD else 1
            if n <= MAX_PARTS:
                for part in range(n):
                    yield part, length if n == 1 else min(STRIPE_UNIT, length - part * STRIPE_UNIT)

    spark.udtf.register("stripe_split", Split)


def stripe_balance(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dev").agg(F.count(F.lit(1)).alias("parts"), F.sum("part_len").alias("bytes"), F.sum("part_pages").alias("pages"))


def reassembled(parts: DataFrame) -> DataFrame:
    """Per PUT: whether all parts are there, and their bytes together."""
    return parts.groupBy("seq").agg(F.max("n_parts").alias("n_parts"), F.count_distinct("part").alias("have"), F.sum("part_len").alias("bytes")).withColumn("rc", F.when(F.col("have") == F.col("n_parts"), "OK").otherwise("EREAD"))


def reassembled_bytes(parts: DataFrame, crc: str = "crc") -> DataFrame:
    """Per seq: the parts' bytes in order, EREAD where one is missing, ECRC where the whole fails its check.

    Rows (seq, part, n_parts, bytes, crc): crc is the CRC-32 of the whole value.  A
    value has at most MAX_PARTS parts, so its list is bounded.
    """
    whole = parts.groupBy("seq").agg(F.max("n_parts").alias("n_parts"), F.count_distinct("part").alias("have"), F.max(crc).alias("crc"), F.sort_array(F.collect_set(F.struct("part", "bytes"))).alias("list"))
    # Binary joined in order; an array of binary is folded by concatenation.
    joined = whole.withColumn("value", F.aggregate(F.transform("list", lambda x: x.bytes), F.lit(b""), lambda a, x: F.concat(a, x)))
    rc = F.when(F.col("have") != F.col("n_parts"), "EREAD").when(F.crc32("value") != F.col("crc"), "ECRC").otherwise("OK")
    return joined.select("seq", "n_parts", rc.alias("rc"), "value")


def replicas(puts: DataFrame, hot: Column, n_devices: int, threshold: int = STRIPE_THRESHOLD) -> DataFrame:
    """Write slots: two, on neighbouring devices, for hot PUTs that are not striped."""
    two = hot & (F.col("payload_len") <= threshold) & F.lit(n_devices > 1)
    return puts.select("*", F.explode(F.when(two, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("slot")).withColumn("dev", F.pmod(device(F.col("prefix_id"), n_devices) + F.col("slot"), F.lit(n_devices)).cast("int"))


def replica_read(slots: DataFrame) -> DataFrame:
    """Per key: the first slot whose check holds, else -1 and EREAD. Columns seq, slot, valid."""
    return slots.groupBy("seq").agg(F.coalesce(F.min(F.when(F.col("valid"), F.col("slot"))), F.lit(-1)).alias("slot")).withColumn("rc", F.when(F.col("slot") < 0, "EREAD").otherwise("OK"))


def shapes(records: DataFrame, *key: str) -> DataFrame:
    """Interned vectors of layer lengths of rows (key.., layer, len): how often each occurs, and if it is uniform."""
    vectors = records.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "len"))), lambda x: x.len).alias("lens"))
    per = vectors.groupBy("lens").agg(F.count(F.lit(1)).alias("uses"))
    return per.select(F.array_join(F.transform("lens", lambda x: x.cast("string")), ",").alias("shape"), F.size("lens").alias("n_records"), (F.array_min("lens") == F.array_max("lens")).alias("uniform"), "uses")


def record_offsets(records: DataFrame, *key: str) -> DataFrame:
    """Exclusive prefix sums of lengths in a key's buffer."""
    w = Window.partitionBy(*key).orderBy("layer", "len").rowsBetween(Window.unboundedPreceding, -1)
    return records.select(*key, "layer", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("off"), "len")


def layer_slice(buffer: Column, offset: Column, length: Column) -> Column:
    """The bytes of one record of a buffer."""
    return F.substring(buffer, offset + 1, length)


def with_regions(puts: DataFrame, n_devices: int, region_pages: int) -> DataFrame:
    """A deterministic region: running pages of a device, cut into regions; the exact allocator is ``alloc``."""
    sized = puts.withColumn("dev", device(F.col("prefix_id"), n_devices)).withColumn("pages", payload_pages(F.col("payload_len")))
    placed = running_sum(sized, ["dev"], F.col("pages"), "start_page", inclusive=False)
    return placed.withColumn("epoch", (1 + F.floor(F.col("start_page") / region_pages)).cast("long"))


def live_bytes(placed: DataFrame, leaf: DataFrame) -> DataFrame:
    """Per device and region: pages written, live bytes, leaves."""
    joined = placed.join(leaf.select(F.col("ver").alias("seq"), F.lit(1).alias("is_live")), "seq", "left")
    return joined.groupBy("dev", "epoch").agg(
        F.sum("pages").alias("written_pages"), F.coalesce(F.sum(F.when(F.col("is_live") == 1, F.col("pages"))), F.lit(0)).alias("live_pages"),
        F.count("is_live").alias("leaves"), F.min("now_s").alias("base_s"), F.max("now_s").alias("close_s"),
    ).withColumn("live_bytes", F.col("live_pages") * PAGE)
