"""Structured Streaming twins: tumbling counters, sessions, and keyed outcomes.

Each runs what is available (``availableNow``) with its checkpoint in the shared
folder, and returns the table it has written.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palimpsest.operators.oplog import from_events
from palimpsest.sources.store import fresh_folder


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log as a stream, with an event time ``at`` in whole seconds."""
    path = f"{sf_dir}/events.parquet"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream watches a folder: that of a single file, of which only the file is taken.
    events = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else stream.parquet(path)
    return from_events(events).withColumn("at", F.timestamp_seconds("now_s"))


def available(df: DataFrame, mode: str) -> DataFrame:
    """The result of all that is available now."""
    spark, folder = df.sparkSession, fresh_folder(df.sparkSession, "stream")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")  # a complete result replaces the last one
        query = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def tumbling(ops: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = ops.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "op").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("bytes"))
    return w.select(F.unix_timestamp("w.start").alias("start_s"), "op", "n", "bytes")


def sliding(ops: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counters over windows that overlap: each operation is in width / step of them."""
    w = ops.withWatermark("at", late).groupBy(F.window("at", width, step).alias("w"), "op").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_len").alias("bytes"))
    return w.select(F.unix_timestamp("w.start").alias("start_s"), "op", "n", "bytes")


def sessions(ops: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions from their first operation to ``gap`` after the last, which is outside: one that comes exactly then begins the next.

    Spark joins windows that touch, so they are a microsecond, the least step of a
    timestamp, shorter than the gap, and get it back at the end.
    """
    s = ops.withWatermark("at", late).groupBy(F.session_window("at", f"{gap} -1 microseconds").alias("w"), "prefix_id").agg(F.count(F.lit(1)).alias("n"))
    end = F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")
    return s.select("prefix_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp(end).alias("end_s"), "n")


def keyed_outcomes(ops: DataFrame) -> DataFrame:
    """Outcomes with state per prefix: its tombstone and its leaves, at most 256, as a prefix has that many groups.

    Rows of a key in one batch are taken by seq.  Across batches the log must come
    in order of seq, as an append-only log does; a row that comes after a later
    one has been handled sees the later state.
    """

    def run(key, pdfs, state):
        held = json.loads(state.get[0]) if state.exists else {"leaf": {}, "tomb": False}
        rows = pd.concat(list(pdfs)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            g = str(r.group_idx)
            leaf = held["leaf"].get(g)
            if r.op == "PUT":
                result = "OK"
                if leaf is None or leaf[0] < r.seq:
                    held["leaf"][g] = [int(r.seq), int(r.expire_ts)]
            elif r.op == "EVICT":
                result = "OK" if leaf else "ENOENT"
                if leaf:
                    del held["leaf"][g]
                    held["tomb"] = held["tomb"] or r.prefix_id != 0
            elif leaf:
                result = "ENOENT (expired)" if leaf[1] and leaf[1] < r.now_s else "HIT"
            else:
                result = "EVICTED" if held["tomb"] else "ENOENT"
            out.append((r.seq, r.op, result, r.payload_len))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["seq", "op", "outcome", "payload_len"])

    slim = ops.select("seq", "now_s", "op", "prefix_id", "group_idx", "payload_len", "expire_ts")
    return slim.groupBy("prefix_id").applyInPandasWithState(run, "seq long, op string, outcome string, payload_len long", "held string", "append", GroupStateTimeout.NoTimeout)
