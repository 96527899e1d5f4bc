"""Sinks: write-once runs with a manifest, snapshots and line-delimited exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(tables: dict[str, DataFrame], folder: str, form: str = "json") -> None:
    """One folder per table; a table that exists already is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").format(form).save(f"{folder}/{name}")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of the data files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order; equal rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.select(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256).alias("d")).first().d


def persist_snapshot(df: DataFrame, folder: str) -> bool:
    """Write a snapshot once: True if written, False if the same rows are there; other rows are an error."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(folder)
        return True
    if digest(spark.read.parquet(folder)) != digest(df):
        raise ValueError(f"{folder} holds another snapshot")
    return False


def export_lines(df: DataFrame, folder: str) -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(folder)


def export_csv(df: DataFrame, folder: str) -> None:
    """A table with a header; an existing one is an error."""
    df.write.mode("errorifexists").csv(folder, header=True)


def review_pack(tables: dict[str, DataFrame], folder: str) -> None:
    """Sheets for reviewers, written only where none is there yet, so that no entry is lost."""
    for name, df in tables.items():
        df.write.mode("ignore").csv(f"{folder}/{name}", header=True)
