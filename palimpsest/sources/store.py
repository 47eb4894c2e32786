"""A store as Parquet tables: journal partitioned by device and epoch, snapshots, metrics CSV.

Dropping a region removes a partition's files, nothing is rewritten.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset and all runs in one process, it is in a temporary folder
    that goes with the process; a cluster without the setting is an error.
    """
    base, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local_folders:
            folder = tempfile.mkdtemp(prefix="palimpsest-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _local_folders[context.applicationId] = "file://" + folder
        base = _local_folders[context.applicationId]
    return f"{base.rstrip('/')}/palimpsest-{context.applicationId}/{name}-{uuid.uuid4().hex}"


def geometry_valid(logical_block: Column) -> Column:
    """A block size is not known (0), or a power of two from 512 to a page."""
    return (logical_block == 0) | (logical_block.between(512, 4096) & (logical_block.bitwiseAND(logical_block - 1) == 0))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append_journal(self, rows: DataFrame) -> None:
        """Rows with dev and epoch; each task writes few files."""
        rows.repartition("dev", "epoch").write.mode("append").partitionBy("dev", "epoch").parquet(f"{self.path}/journal")

    def journal(self, dev: int | None = None, since: int | None = None) -> DataFrame:
        """Filters on dev prune partitions; those on seq are pushed to the scan."""
        df = self.spark.read.parquet(f"{self.path}/journal")
        if dev is not None:
            df = df.where(F.col("dev") == dev)
        return df if since is None else df.where(F.col("seq") > since)

    def write_snapshot(self, leaf: DataFrame, version: int) -> None:
        leaf.write.mode("overwrite").parquet(f"{self.path}/snapshot/v={version}")

    def snapshot(self) -> DataFrame:
        """The newest snapshot."""
        every = self.spark.read.parquet(f"{self.path}/snapshot")
        newest = every.agg(F.max("v").alias("m")).first().m
        return every.where(F.col("v") == newest).drop("v")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def trim(self, dev: int, epoch: int) -> bool:
        """Removes a region's partition."""
        fs, jvm = self._fs()
        return fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/journal/dev={dev}/epoch={epoch}"), True)

    def clear(self) -> bool:
        fs, jvm = self._fs()
        return fs.delete(jvm.org.apache.hadoop.fs.Path(self.path), True)


def write_metrics_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_bench_csv(rows: DataFrame, path: str, model: str) -> None:
    """Rows (key, value) of a phase as key, model, value."""
    rows.select("key", F.lit(model).alias("model"), "value").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_config_texts(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Whole configuration files of at most a MiB: path and json."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")).where(F.octet_length("json") <= most_bytes)
