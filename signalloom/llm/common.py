"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


_stored: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stored:
        atexit.register(free_tables)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def free_tables() -> None:
    """Remove all tables stored so far: for long sessions, once the results that read them are written."""
    while _stored:
        _remove(*_stored.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session ended first: the shared folder is the cluster's to clean
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session at most ARROW_BYTES (or one row) unless the session sets its own limit.

    Both the JVM and the worker hold a batch; Spark's default of 64 MB a task, grown by doubling, is most
    of the memory of operators that work on a megabyte at a time.
    """
    conf = df.sparkSession.conf
    if conf.get(ARROW_LIMIT) in ("67108864b", "64MB", "64m"):
        conf.set(ARROW_LIMIT, f"{ARROW_BYTES}b")
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """A row's identity (16 bytes) even where ids are null or repeat: rows with one key are equal in these columns."""
    parts = [F.coalesce(F.concat(F.lit("="), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat(*parts)))


def held_out(id_col: str, modulus: int):
    """Whether crc32 of the id as text is divisible by modulus; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == 0, F.lit(False))
