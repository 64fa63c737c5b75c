"""Helpers that the operators here share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of the white space `[\x20\x09-\x0D]`, for splitting text into words.
SPACE = "[\\x20\\x09-\\x0D]+"
#: The same characters, for str.strip in Python.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder path under spark.checkpoint.dir, which executors and driver share; it is removed when the driver ends.

    Where the setting is absent and the master is local (tests on one machine) a temporary folder is set; on a cluster
    each machine would write its own, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corpusmill/{uuid.uuid4().hex}"
    store, where = _store(spark, path)
    store.deleteOnExit(where)
    return path


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    store, where = _store(spark, path)
    store.delete(where, True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors."""
    return write_table(df, shared_dir(df.sparkSession))


class Scratch:
    """Tables that an operator needs only while it works: ``keep`` is ``materialize`` until the block ends, which removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return write_table(df, f"{self.path}/{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower_sql(expr: str) -> str:
    return f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Most bytes of texts in one Arrow batch, on their way to and in a Python worker.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by size, so long texts don't meet by the thousand in one worker's memory. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


#: What a Python worker remembers from task to task: functions that forget it, by the name of the operator that uses it.
MEMORIES: dict[str, Callable[[], None]] = {}


def lean(run: Callable[[Iterator], Iterator], name: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` as a task of the operator ``name``: first the worker forgets what other operators remember, at the end it gives free memory back."""

    def task(batches: Iterator) -> Iterator:
        for other in [x for x in MEMORIES if x != name]:
            MEMORIES.pop(other)()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    """Give free memory of Arrow and of the C library back to the system; a worker process keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def own(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator works on, so extra columns with clashing names can do no harm."""
    bounded_batches(df.sparkSession)
    return df.select(*[df[c] for c in keep])
