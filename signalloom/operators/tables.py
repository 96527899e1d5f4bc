"""Intermediate tables: written to the folder that the driver and all executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset, on a local master only, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """df, written and read back (as ``schema``, if given): its lineage ends, lost executors cost nothing, and joins know its size."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(free)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with ``number`` from 0 in the order of the columns; ranges are counted apart, so no task sees all rows."""
    ranged = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(before, F.col("part") == F.col("p")).withColumn("number", (F.col("place") + F.col("before")).cast("long")).drop("part", "p", "place", "before")


def free() -> None:
    """Remove all tables written so far, once the results that read them are written."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session ended first: the shared folder is the cluster's to clean
            return
