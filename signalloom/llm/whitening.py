"""Embedding whitening: principal components of exactly centred rows, each scaled to variance 1.

Entries become whole numbers, so that sums and centred values are exact: x = floor(1024 * entry) +
100000, and n * x - S for the sum S of a dimension is a whole number too.  Divided by n, the centred
rows go to MLlib's RowMatrix, whose Gramian over n is the covariance; only its d x d matrix reaches
the driver, where eigh finds the components.  The d x k matrix that whitens is sent to the tasks, which
apply it batch by batch.  Sums are added up in each task before they meet, one row a task and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import small_batches, store

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries are taken as at most this far from 0, so that sums of 2**32 rows fit 64 bits.
FARTHEST = float(1 << 20)
#: A component with less than this share of the variance counts as having none.
LEAST_SHARE = 1e-13
WIDE = pa.decimal128(38, 0)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable rows' ids and their entries as whole numbers.

    A row is usable if its vector and all entries are there and finite, and if it has as many entries as
    most such rows (the larger number where two are tied).
    """
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(v) == (usual["d"] if usual else 0))
    near = lambda c: F.least(F.greatest(c, F.lit(-FARTHEST)), F.lit(FARTHEST))
    return rows.select("id", F.transform(v, lambda c: (F.floor(near(c) * SCALE) + SHIFT).cast("long")).alias("x"))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            s = _matrix(b.column(0)).sum(0)
            n, total = n + b.num_rows, s if total is None else total + s
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "s"])


def sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows there are, and each dimension's exact sum."""
    parts = rows.select("x").mapInArrow(_partial_sums, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "s"))
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), np.array([r["s"] for r in found], np.int64)


def covariance(rows: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """Of the rows' x: the Gramian of the centred rows, over n."""
    total = F.lit(s.tolist())
    centred = F.transform("x", lambda x, i: (x * n - F.get(total, i)).cast("double") / float(n))
    mllib = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(mllib, n, len(s)).computeGramianMatrix().toArray() / n


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues, their unit eigenvectors as columns, and each one's share of the trace.

    A vector's largest entry (the first of those tied) is positive, so reruns agree in sign.
    """
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value, kind="stable")[:k]
    value, vector = np.maximum(value[order], 0.0), vector[:, order]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(len(order))])
    total = float(np.trace(cov))
    return value, vector * np.where(sign == 0, 1.0, sign), value / total if total > 0 else np.zeros(len(order))


def _squares(gap: np.ndarray) -> list[int]:
    """Exact sums of the squares of each row."""
    rough = (gap.astype(float) ** 2).sum(1)
    if not len(gap) or rough.max() < 2.0**62:
        return (gap * gap).sum(1).tolist()
    wide = gap.astype(object)
    return (wide * wide).sum(1).tolist()


def _apply(n: int, s: np.ndarray, matrix: np.ndarray):
    schema = pa.schema([("row", pa.int64()), ("whitened", pa.list_(pa.float64())), ("deviation", WIDE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            gap = x * n - s
            out = (gap.astype(float) / n) @ matrix
            at = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel())), pa.array(_squares(gap), WIDE)], names=["id", *schema.names[1:]])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(id, n, whitened, deviation, explained, identity_error) for every usable row.

    ``whitened`` holds the row's min(k, d) components by falling eigenvalue, ``explained`` each one's share of the
    variance; ``deviation`` is the exact sum of (n * x - S)**2 as decimal(38, 0); ``identity_error`` is the
    largest absolute entry of the covariance of the whitened rows minus the identity.

    Rows with a null vector, null or non-finite entries, no entries, or another number of entries than most
    rows, are left out.  Entries beyond 2**20 are taken as 2**20.  A component without variance (equal
    rows, one row, fewer rows than components) is 0 in every row, and identity_error then is 1.
    Repeated rows and ids, and null ids, are rows like others; other columns are not read.  An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = store(vectors(small_batches(df), id_col, vector_col), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, whitened array<double>, deviation decimal(38,0)"
    n, s = sums(rows)
    if not n:
        return spark.createDataFrame([], f"id {kind}, n long, whitened array<double>, deviation decimal(38,0), explained array<double>, identity_error double")
    value, vector, explained = components(covariance(rows, n, s), k)
    real = explained > LEAST_SHARE
    matrix = np.where(real, vector / np.sqrt(np.where(real, value, 1.0)), 0.0)
    out = store(rows.mapInArrow(_apply(n, s, matrix), schema), "whitened")
    p = len(value)
    w = [F.col("whitened")[i] for i in range(p)]
    found = out.agg(*[F.avg(c) for c in w], *[F.avg(w[i] * w[j]) for i in range(p) for j in range(i, p)]).first()
    mean, second = np.array(found[:p]), np.zeros((p, p))
    second[np.triu_indices(p)] = found[p:]
    error = float(np.abs(second - np.triu(np.outer(mean, mean)) - np.eye(p)).max())
    return out.select("id", F.lit(n).cast("long").alias("n"), "whitened", "deviation", F.lit(explained.tolist()).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable row and component.  A deviation beyond 64 bits is null in ``deviation`` and whole in ``deviation_exact``."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = out.select("id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "w"))
    return each.select(
        F.col("id").alias("vec_id"),
        (F.col("i") + 1).alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("w").alias("whitened"),
        F.get("explained", "i").alias("explained"),
        "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )
