"""Documents by address as state of a stream: a micro-batch of k rows reads and writes the state of its k addresses alone.

The state lives in the checkpoint's state store (RocksDB, by changelog); what a batch changed is its output, to be appended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from signalloom.functions import urls as U

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "payload string, first_seen timestamp, last_seen timestamp, times_seen long"
CHANGES = "normalized_url string, change string, payload string, first_seen timestamp, last_seen timestamp, times_seen long"


class Documents(StatefulProcessor):
    """Per address: the payload of its latest sighting (the longer of equal times), first and last time and number of sightings.

    Puts out the address as ``new``, ``changed`` or ``seen``, and the payload that a change replaced as ``archived``.  A sighting
    older than the last one counts and can move the first time, but replaces nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.known.get() if self.known.exists() else None
        payload, first, last, times = before if before else (None, None, None, 0)
        old = payload
        for part in rows:
            for text, at in sorted(zip(part["payload"], part["seen_at"], strict=True), key=lambda r: (r[1], len(r[0]), r[0])):
                times += 1
                if last is None or (at, len(text), text) > (last, len(payload), payload):
                    payload = text
                first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        self.known.update((payload, first, last, times))
        change = "new" if before is None else "changed" if payload != old else "seen"
        out = [(key[0], change, payload, first, last, times)]
        if change == "changed":
            out.append((key[0], "archived", old, before[1], before[2], before[3]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def document_changes(stream: DataFrame, url: str = "url", payload: str = "payload", seen_at: str = "seen_at") -> DataFrame:
    """The CHANGES of a stream of (url, payload, seen_at); rows without an address, payload or time go."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.select(U.normalize_url(F.col(url)).alias("normalized_url"), F.col(payload).alias("payload"), F.col(seen_at).cast("timestamp").alias("seen_at"))
    return rows.dropna().groupBy("normalized_url").transformWithStateInPandas(statefulProcessor=Documents(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def follow(stream: DataFrame, folder: str, interval: str | None = "1 hour", **columns: str) -> StreamingQuery:
    """Append the changes of every micro-batch to ``folder``/changes; a batch that is run again writes the same folder again."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = document_changes(stream, **columns).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they stand: each address's last change, by batch."""
    rows = spark.read.parquet(f"{folder}/changes").where("change <> 'archived'")
    columns = [c.split()[0] for c in CHANGES.split(", ") if c.split()[0] not in ("normalized_url", "change")]
    return rows.groupBy("normalized_url").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("normalized_url", "r.*")


class Heartbeat(StreamingQueryListener):
    """Writes a small JSON of the last micro-batch to ``folder``/heartbeat.json after each, through the cluster's file system: a new file, then a rename."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, body: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path("heartbeat.json").getFileSystem(conf)
        out = system.create(path("heartbeat.json.new"), True)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.close()
        system.delete(path("heartbeat.json"), False)
        system.rename(path("heartbeat.json.new"), path("heartbeat.json"))

    def onQueryStarted(self, event) -> None:
        self._write({"status": "started", "query": str(event.id), "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write({"status": "running", "query": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        self._write({"status": "idle", "query": str(event.id), "at": event.timestamp})

    def onQueryTerminated(self, event) -> None:
        self._write({"status": "error" if event.exception else "stopped", "query": str(event.id), "error": event.exception})
