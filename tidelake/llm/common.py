"""What the operators share: reading a table, cutting lineage, naming work folders."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one to three longs that are broadcast (72 bytes a row as sent, so 18 MB at most); more are joined by a shuffle.
FEW = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's full address. What has no scheme is a path in the default file system, as for Spark's own readers and
    writers; Python workers, who don't know which one that is, are given this address."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach; removed when the driver's JVM ends.

    Where that setting is unset, a folder of this machine stands in, if this machine is all there is: else it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{root.rstrip('/')}/tidelake-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(rows: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows. Where it has many, hot keys of the other side are left to AQE,
    which splits them, as this side has each key once."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    t = F.coalesce(text, F.lit(""))
    blank = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
    edges = [t == "", F.substring(t, 1, 1).isin(blank), F.substring(t, -1, 1).isin(blank)]
    return sum((-e.cast("long") for e in edges), F.size(F.split(t, SPACE)).cast("long"))


def let_go() -> None:
    """At a task's end in Python: memory that is free goes back to the system, as the worker lives on beside other stages'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # other C libraries give memory back by themselves
        trim(0)
