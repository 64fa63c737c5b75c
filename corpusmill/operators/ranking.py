"""Places of rows in a total order, without bringing them to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read back; the folder is removed when the driver ends.

    Where the setting is absent a temporary folder is set on a local master; on a cluster that is an error.
    """
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/corpusmill/{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place from 1 in an order that has no ties.

    Rows are dealt to ranges and sorted there; a place is the rows of all ranges before, plus the place in its own. The
    ranges are written once, so that counts and places come from the same ones even if executors are lost. One
    number for each range reaches the driver.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = shared_table(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect())
    before, at = [], 0
    for part, n in counts:
        before.append((part, at))
        at += n
    if not before:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_part", "_at")
    start = F.create_map(*[F.lit(x) for kv in before for x in kv])
    return rows.withColumn(name, (start[F.col("_part")] + F.col("_at") + 1).cast("long")).drop("_part", "_at")
