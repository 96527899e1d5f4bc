"""The collection loop as Structured Streaming: each micro-batch is one cycle that merges into stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalloom.functions import urls as U
from signalloom.operators.documents import merge_documents

STATE = "normalized_url string, payload string, first_seen string, last_seen string"
PENDING = "url string, payload string"
LEDGER = "cycle string, status string, documents long, error string"


def _complete(spark: SparkSession, folder: str, table: str) -> list[int]:
    """The cycles that have written a table in full, in order; one listing of the folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def run_cycle(batch: DataFrame, cycle: int, folder: str, url: str = "url", payload: str = "payload") -> None:
    """Merge a batch; a cycle that is run again writes the same folders again.

    An error ends the cycle, not the loop: the batch is kept aside and merged with the next cycle that
    succeeds.  If it cannot even be kept, the error is raised, so the stream offers the batch again.
    """
    spark, name = batch.sparkSession, f"cycle-{cycle:08d}"
    rows = batch.select(F.col(url).alias("url"), F.col(payload).alias("payload"))
    try:
        done = [n for n in _complete(spark, folder, "state") if n < cycle]
        last = done[-1] if done else -1
        state = spark.read.schema(STATE).parquet(f"{folder}/state/batch={last}") if done else spark.createDataFrame([], STATE)
        kept = [f"{folder}/pending/batch={n}" for n in _complete(spark, folder, "pending") if last < n < cycle]
        whole = rows.union(spark.read.schema(PENDING).parquet(*kept)) if kept else rows
        found = whole.select(U.normalize_url(F.col("url")).alias("normalized_url"), "payload").where(F.col("normalized_url").isNotNull())
        latest = found.groupBy("normalized_url").agg(F.max_by("payload", F.struct(F.length("payload"), "payload")).alias("payload"))
        state, archived = merge_documents(state, latest, "normalized_url", "payload", name)
        archived.write.mode("overwrite").parquet(f"{folder}/versions/batch={cycle}")
        state.write.mode("overwrite").parquet(f"{folder}/state/batch={cycle}")
        n = spark.read.schema(STATE).parquet(f"{folder}/state/batch={cycle}").where(F.col("last_seen") == name).count()
        row = (name, "ok", n, None)
    except Exception as e:
        rows.select(F.col("url").cast("string"), F.col("payload").cast("string")).write.mode("overwrite").parquet(f"{folder}/pending/batch={cycle}")
        row = (name, "error", 0, str(e)[:500])
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").json(f"{folder}/ledger/batch={cycle}")


def collect(stream: DataFrame, folder: str, interval: str | None = "1 hour", **columns: str) -> StreamingQuery:
    """Run cycles over a stream of (url, payload), every ``interval`` or, where it is None, over what there is now."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = stream.writeStream.foreachBatch(lambda batch, n: run_cycle(batch, n, folder, **columns))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
