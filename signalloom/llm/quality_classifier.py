"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text is measured once; labelled rows outside the held-out fold give, by sums over all of
them, each class's mean and covariance.  A covariance is shrunk toward the pooled one and
toward its own diagonal, factored once, and a text's score is the logistic of the difference of
its two Mahalanobis log-densities, tempered by ``TEMPER``, plus the log prior odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, held_out, store
from signalloom.llm.moments import estimate, factor, gather
from signalloom.llm.stats import NAMES, text_stats, vectors

FOLDS, THRESHOLD = 5, 0.3
SHRINK_POOLED, SHRINK_DIAGONAL, TEMPER = 0.1, 0.1, 0.5
FLOOR = 0.03
P = len(NAMES) + 2


def features(n: dict[str, np.ndarray]) -> np.ndarray:
    words = n["n_words"]
    variety = np.log((n["n_distinct"] + 20.0) / (words + 20.0))
    return np.column_stack((vectors(n), np.log1p(words) / 4, variety))


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for s in B.slices(b.column(1)):
                v = features(text_stats(s))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1, dtype=np.int32) * P), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), lists], names=["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, v array<double>")


class Model:
    """Priors, means and inverse Cholesky factors of the classes that have rows."""

    def __init__(self, rows: list):
        got = {r["label"]: (r["n"], *estimate(r["n"], r["s1"], r["s2"])) for r in rows if r["n"]}
        total = sum(x[0] for x in got.values())
        pooled = sum(x[0] * x[2] for x in got.values()) / total if total else 0
        self.classes = {}
        for label, (n, mean, cov) in got.items():
            cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
            cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov))
            root = factor(cov, np.full(len(mean), FLOOR))
            self.classes[label] = (np.log((n + 1) / (total + 2)), mean, root, float(np.log(np.abs(np.diag(root))).sum()))

    def scores(self, v: np.ndarray) -> np.ndarray:
        if set(self.classes) != {0, 1}:
            return np.full(len(v), {(0,): 0.0, (1,): 1.0}.get(tuple(self.classes), 0.5))
        logs = {}
        for label, (prior, mean, root, det) in self.classes.items():
            d = (v - mean) @ root.T
            logs[label] = prior + TEMPER * (det - 0.5 * (d * d).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of df.

    Labels (id_col, label_col) that are null, neither 0 nor 1, or that contradict one another for
    an id are not used.  Null texts count as empty and get a score like any other.  With labels of
    one class alone every score is that class; with none, 0.5.  An empty table gives no rows.
    """
    rows = store(measured(df, id_col, text_col), "features")
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, folds)).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most")).where("label = most")
    model = Model(gather(rows.join(known, "id"), "label", "v", P).collect())

    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, P)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(v))], names=["id", "score"])

    return rows.mapInArrow(run, "id long, score double").select("id", held_out("id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels).withColumnRenamed("id", "doc_id")
