"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import store

#: White space of every word contract here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir; a local one only where it is unset and
    the executors run inside the driver."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/framelake-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/framelake-[^/]+$", uri):
            store.remove(uri)


def free_name(df: DataFrame, name: str, *others: DataFrame) -> str:
    """name, with as many underscores before it as no column of the frames has, in any case."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Shuffle partitions by the planner's size estimate of df, never below the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 58 else max(least, -(-size // bytes_each))


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers at most 1,000 rows and about 16 MB at once instead of Spark's 10,000 rows and 64 MB, as texts can be
    long. This holds for the session, whose settings stay where a user has changed them."""
    for key, usual, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", str(16 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)


def trim() -> None:
    """Hand freed memory back to the system at the end of a task, as Python workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(fold: int, mod: int):
    """Column: crc32 of doc_id as text, modulo mod, equals fold."""
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod) == fold
