"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates.

Each text gives a vector of transformed statistics (``stats.vectors``).  For every (language,
source) group, every language and all rows together, concentration steps look for the ``COVERED``
share of rows whose covariance has the least determinant: from medians and median deviations,
distances are taken, the nearest share is kept (its limit comes from an exact histogram of
log distances), and mean and covariance are estimated anew from it.  A reweighting step
follows.  Then each language's estimate is drawn to that of all rows and each group's to its
language's, as if ``PULL`` rows of the larger set were added: a large group keeps its own
estimate, a small one has nearly its language's, and no size is a threshold.  Every step is one pass over the narrow table of vectors with sums gathered per
group, so a group of any size is never in one task, and all rows count.

A text is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``: the chi-squared quantile
that one normal vector in ten thousand exceeds, times ``MARGIN`` for the tails of the transformed
statistics, which are heavier than normal ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, row_key, small_batches, store
from signalloom.llm.moments import chi2_cdf, chi2_quantile, estimate, factor, gather
from signalloom.llm.stats import COUNTS, NAMES, text_stats, vectors

P = len(NAMES)
COVERED, STEPS, PULL = 0.75, 3, 5 * P
REJECTED, MARGIN = 0.0001, 1.5
CUTOFF = MARGIN * chi2_quantile(1 - REJECTED, P)
FLOOR = np.array([0.03, 0.03, 0.03, 0.04, 0.06, 0.05, 0.10, 0.05])
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BROADCAST_GROUPS, SALTS = 20_000, 64
PARAMS = "grp string, n long, mean array<double>, cov array<double>, root array<double>"


def measured(df: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, ...]) -> DataFrame:
    """(key, id, grp, counts, v): a row's key, its group and the statistics of its text."""
    rows = small_batches(df).select(
        row_key(id_col, text_col, *group_cols).alias("key"),
        F.col(id_col).cast("long").alias("id"),
        F.to_json(F.array(*[F.col(c).cast("string") for c in group_cols])).alias("grp"),
        F.col(text_col).alias("text"),
    )

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(3)):
                n = text_stats(s)
                v = vectors(n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1, dtype=np.int32) * P), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(s.first, s.rows) for i in range(3)), *(pa.array(n[c]) for c in COUNTS), lists], names=["key", "id", "grp", *COUNTS, "v"])

    return rows.mapInArrow(run, "key binary, id long, grp string, " + ", ".join(f"{c} long" for c in COUNTS) + ", v array<double>")


def _params(floor: np.ndarray, scale: float):
    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if r.n:
                    mean, cov = estimate(r.n, r.s1, r.s2)
                    out.append((r.grp, r.n, mean.tolist(), (cov * scale).ravel().tolist(), factor(cov * scale, floor).ravel().tolist()))
            import pandas as pd

            yield pd.DataFrame(out, columns=["grp", "n", "mean", "cov", "root"])

    return run


def _drawn(floor: np.ndarray, pull: float):
    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                own, gap = r.n / (r.n + pull), r.mean - r.up_mean
                cov = (own * r.cov + (1 - own) * r.up_cov).reshape(P, P) + own * (1 - own) * np.outer(gap, gap)
                out.append((r.grp, r.n, (r.up_mean + own * gap).tolist(), cov.ravel().tolist(), factor(cov, floor).ravel().tolist()))
            yield pd.DataFrame(out, columns=["grp", "n", "mean", "cov", "root"])

    return run


def prefix(grp: str, k):
    """The group of grp's first k values; none is all rows."""
    return F.to_json(F.slice(F.from_json(grp, "array<string>"), F.lit(1), k))


def drawn(params: DataFrame, levels: int, floor: np.ndarray = FLOOR, pull: float = PULL) -> DataFrame:
    """The parameters of the groups of ``levels`` values, each drawn to its parent's, and that to its own parent's."""
    level = params.withColumn("level", F.size(F.from_json("grp", "array<string>")))
    up = level.where("level = 0").drop("level")
    for k in range(1, levels + 1):
        parents = up.select(F.col("grp").alias("parent"), F.col("mean").alias("up_mean"), F.col("cov").alias("up_cov"))
        pairs = level.where(F.col("level") == k).withColumn("parent", prefix("grp", F.lit(k - 1))).join(parents, "parent")
        up = pairs.select("grp", "n", "mean", "cov", "up_mean", "up_cov").mapInPandas(_drawn(floor, pull), PARAMS)
    return up


def beside(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with their group's columns of the stored table params, without dealing rows by group alone."""
    if params.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(params), "grp")
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted, ["grp", "salt"]).drop("salt")


def distances(rows: DataFrame, params: DataFrame, *keep: str) -> DataFrame:
    """Squared Mahalanobis distance of each row of (.., grp, v) under its group's parameters (grp, mean, root, ..)."""
    both = beside(rows, params).select(*keep, "grp", "v", "mean", "root")
    x = [F.col("v")[i] - F.col("mean")[i] for i in range(P)]
    terms = []
    for i in range(P):
        dot = sum((F.col("root")[i * P + j] * x[j] for j in range(1, i + 1)), F.col("root")[i * P] * x[0])
        terms.append(dot * dot)
    return both.select(*keep, "grp", "v", sum(terms[1:], terms[0]).alias("d2"))


def mcd(rows: DataFrame, floor: np.ndarray = FLOOR, covered: float = COVERED, steps: int = STEPS) -> DataFrame:
    """(grp, n, mean, cov, root) of the groups of rows (grp, v): n rows count in the estimate; root is the inverse Cholesky factor, row by row."""
    middle = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("v")[i], [0.5, 0.25, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    mean = F.array(*[F.col(f"q{i}")[0] for i in range(P)])
    spread = [F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[1]) / 1.349, 2) + float(floor[i]) ** 2) for i in range(P)]
    root = F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    params = store(middle.select("grp", "n", mean.alias("mean"), root.alias("root")), "mcd")
    sizes = params.select("grp", F.col("n").alias("size"))
    bins = F.floor(F.log(F.col("d2") + 1e-9) * 50).cast("int")
    grow = covered / chi2_cdf(chi2_quantile(covered, P), P + 2)
    for step in range(steps + 1):
        if step < steps:
            counts = distances(rows, params.select("grp", "mean", "root")).groupBy("grp", bins.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
            run = counts.withColumn("below", F.sum("c").over(Window.partitionBy("grp").orderBy("bin")) - F.col("c")).join(sizes, "grp")
            limits = run.where(F.col("below") < covered * F.col("size")).groupBy("grp").agg(F.max("bin").alias("limit"))
            limited = store(params.select("grp", "mean", "root").join(limits, "grp"), "limits")
            near, scale = distances(rows, limited, "limit").where(bins <= F.col("limit")), grow
        else:
            d = distances(rows, params.select("grp", "mean", "root"))
            near, scale = d.where(F.col("d2") <= chi2_quantile(0.975, P)), 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2)
        found = gather(near, "grp", "v", P).mapInPandas(_params(floor, scale), PARAMS)
        params = store(found, "mcd")
    return params


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """(key, id, counts, base_failed, distance, kept) for every row.

    Null texts count as empty; texts under ``MIN_WORDS`` words or with over ``MAX_REPEAT_PERCENT``
    percent of words in repeated windows fail the base rules.  A null group value is a value of its
    own.  Rows equal in id, text and group have one key and one verdict.  Texts of any length are
    measured whole.  Only the columns named are read, so others cannot clash.  Empty table: no rows.
    """
    rows = store(measured(df, id_col, text_col, group_cols), "stats")
    levels = len(group_cols)
    fit = rows.select(F.explode(F.array(*[prefix("grp", F.lit(k)) for k in range(levels)], F.col("grp"))).alias("grp"), "v")
    params = store(drawn(mcd(fit), levels), "drawn")
    judged = distances(rows, params.select("grp", "mean", "root"), "key", "id", *COUNTS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select("key", "id", *COUNTS, failed.alias("base_failed"), F.col("d2").alias("distance"), (~failed & (F.col("d2") <= cutoff)).alias("kept"))


def filter_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of df that the rules keep, all columns as they are."""
    kept = judge(df, id_col, text_col, group_cols).where("kept").select("key").distinct()
    rows = df.select(F.struct("*").alias("original"), row_key(id_col, text_col, *group_cols).alias("key"))
    return rows.join(kept, "key", "left_semi").select("original.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
