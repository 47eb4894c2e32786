"""Shared helpers: the session's shared folder, written tables, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the word and text contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (master ``local``, as in
    tests) it is a temporary folder, gone with the process; a cluster without
    the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[context.applicationId] = "file://" + folder
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def few_files(spark: SparkSession) -> int:
    """Tasks that write where partitions are small: up to four partitions each, but eight tasks a core."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here.

    With ``few`` in at most ``few_files`` files.  On a local file system Hadoop
    starts a process (chmod) for each folder, file and checksum that a task
    makes, which for an instant looks as large as the whole executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.coalesce(few_files(spark)) if few else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later step reads."""
    for df in tables:
        _remove(df.sparkSession, df.written_at)


def remove_all(spark: SparkSession) -> None:
    """Removes every table this application has written, when its results have been read."""
    _remove(spark, f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}")


def give_back() -> None:
    """Gives this process's free memory back to the system; a worker stays for a minute after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def released(run):
    """``run`` of ``mapInArrow``, after which the worker keeps no memory that it does not need."""

    def until_its_end(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return until_its_end


def remainder_of_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
