"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ship import ship

#: Buckets of ids, of which the ones that are wanted are broadcast: so many rows of a long at most.
ID_BUCKETS = 1 << 20

__all__ = ["ID_BUCKETS", "drop_path", "fresh_path", "shared_dir", "ship", "stage", "trimmed", "unstage", "without_ids"]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` where it is set, else, in a session of one machine only, a folder of that."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; what was made from them is written."""
    for df in tables:
        drop_path(df.sparkSession, df._staged_path)


def trimmed(run):
    """A function over batches that gives its memory back to the system when a task ends: workers live on."""

    def inner(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return inner


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone`` (doc_id).

    Only rows whose id shares a bucket with one that goes are shuffled; a list of buckets, of bounded length, tells the
    others where they are read.
    """
    gone = stage(gone.select(F.col("doc_id").cast("long").alias("__gone")), "gone")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    buckets = F.broadcast(gone.select(bucket(F.col("__gone")).alias("__bucket")).distinct())
    here = bucket(docs[id_col].cast("long")) == buckets["__bucket"]
    perhaps = docs.join(buckets, here, "left_semi")
    return docs.join(buckets, here, "left_anti").unionByName(perhaps.join(gone, perhaps[id_col].cast("long") == gone["__gone"], "left_anti"))
