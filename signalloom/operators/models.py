"""Small linear models fitted from one aggregated pass, and judged out of fold.

Sums over a fold's rows (counts, feature sums, products) are enough for ridge regression, so every fold's
model comes from the same grouped sums: all rows less the fold's own.  What reaches the driver is
folds x features squared numbers, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.tables import cut, numbered


def balanced_folds(df: DataFrame, group: str, label: str | None = None, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups in folds of nearly equal rows and, given a label of 0 and 1, nearly equal ones.

    Groups of one profile (rows, ones) are alike, so they are dealt round in the order of a digest; what is left of a profile, fewer groups than
    folds, goes one by one, large profiles first, where it keeps the folds most even.  Only the profiles' counts reach
    the driver.  Null groups are left out; null labels count as 0.
    """
    ones = F.sum(F.coalesce(F.col(label).cast("long"), F.lit(0))) if label else F.lit(0).cast("long")
    sums = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), ones.alias("ones"))
    sums = cut(sums.withColumn("digest", F.md5(F.col("g").cast("string"))))
    profiles = sums.groupBy("n", "ones").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n"), F.desc("ones")).collect()
    total = np.maximum(1.0, np.array([sum((r.n - r.ones) * r.m for r in profiles), sum(r.ones * r.m for r in profiles)], float))
    load, plan = np.zeros((folds, 2)), []
    for r in profiles:
        own = np.array([r.n - r.ones, r.ones]) / total
        load += own * (r.m // folds)
        rest = []
        for _ in range(r.m % folds):
            free = [k for k in range(folds) if k not in rest]
            rest.append(min(free, key=lambda k: (float(((load[k] + own) ** 2 - load[k] ** 2).sum()), k)))
            load[rest[-1]] += own
        plan.append((r.n, r.ones, r.m // folds * folds, rest))
    spark = df.sparkSession
    dealt = spark.createDataFrame(plan, "pn long, pones long, even long, rest array<int>")
    ranked = numbered(sums, "n", "ones", "digest", "g")
    starts = ranked.groupBy(F.col("n").alias("sn"), F.col("ones").alias("sones")).agg(F.min("number").alias("start"))
    placed = ranked.join(starts, (F.col("n") == F.col("sn")) & (F.col("ones") == F.col("sones"))).join(dealt, (F.col("n") == F.col("pn")) & (F.col("ones") == F.col("pones")))
    place = F.col("number") - F.col("start")
    fold = F.when(place < F.col("even"), place % folds).otherwise(F.get("rest", (place - F.col("even")).cast("int"))).cast("int")
    return placed.select(F.col("g").alias(group), fold.alias("fold"))


def _sums(df: DataFrame, features: list[str], target: str, fold: str) -> dict[int, np.ndarray]:
    """Per fold the matrix of products of (1, features.., target)."""
    names = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    cells = [F.sum(names[i] * names[j]) for i in range(len(names)) for j in range(i, len(names))]
    upper = np.triu_indices(len(names))
    out = {}
    for r in df.na.drop(subset=[*features, target]).groupBy(fold).agg(F.array(*cells).alias("s")).collect():
        m = np.zeros((len(names), len(names)))
        m[upper] = r.s
        out[r[fold]] = m + np.triu(m, 1).T
    return out


def solve_ridge(m: np.ndarray, alpha: float, scaled: bool) -> tuple[float, np.ndarray]:
    """(intercept, weights) from products of (1, features.., target); the intercept is not shrunken.

    ``scaled`` shrinks weights of features brought to unit population deviation, and gives them back
    in the features' own units; a constant feature has weight 0.
    """
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    x, xy = centred[:-1, :-1], centred[:-1, -1]
    spread = np.sqrt(np.clip(np.diag(x), 0, None) / n)
    live = spread > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))
    scale = np.where(live, spread, 1.0) if scaled else np.ones(len(xy))
    weights = np.zeros(len(xy))
    if live.any():
        a = (x / np.outer(scale, scale))[np.ix_(live, live)] + alpha * np.eye(live.sum())
        weights[live] = np.linalg.solve(a, (xy / scale)[live]) / scale[live]
    return float(mean[-1] - weights @ mean[:-1]), weights


def _apply(features: list[str], intercept: float, weights: np.ndarray) -> Column:
    out = F.lit(intercept)
    for f, w in zip(features, weights):
        out = out + F.lit(float(w)) * F.col(f)
    return out


def ridge(df: DataFrame, features: list[str], target: str, group: str, alpha: float, scaled: bool, low: float, high: float, folds: int = 5) -> tuple[dict, DataFrame, dict]:
    """(model, out-of-fold rows, report) of ridge regression with whole groups held out.

    The rows gain fold, prediction (clipped to low .. high) and baseline, the median target of the other
    folds.  ``deploy`` is true if the model's mean absolute error is below the baseline's.  Rows
    with a null feature, target or group are left out; a table without two folds is an error.
    """
    rows = df.na.drop(subset=[*features, target, group])
    rows = rows.join(balanced_folds(rows, group, folds=folds), group)
    sums = _sums(rows, features, target, "fold")
    if len(sums) < 2:
        raise ValueError("groups fill fewer than two folds")
    whole = sum(sums.values())
    medians = rows.agg(*[F.percentile(F.when(F.col("fold") != k, F.col(target).cast("double")), 0.5).alias(str(k)) for k in sums]).first()
    guess, base = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, m in sums.items():
        guess = F.when(F.col("fold") == k, _apply(features, *solve_ridge(whole - m, alpha, scaled))).otherwise(guess)
        base = F.when(F.col("fold") == k, F.lit(float(medians[str(k)]))).otherwise(base)
    judged = rows.withColumn("prediction", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), guess))).withColumn("baseline", base)
    errors = judged.agg(F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae"), F.avg(F.abs(F.col("baseline") - F.col(target))).alias("baseline_mae"), F.count(F.lit(1)).alias("rows")).first().asDict()
    intercept, weights = solve_ridge(whole, alpha, scaled)
    model = {"intercept": intercept, "weights": dict(zip(features, map(float, weights))), "bounds": (low, high), "deploy": errors["mae"] < errors["baseline_mae"]}
    return model, judged, errors


def balanced_logistic(df: DataFrame, features: list[str], target: str, c: float = 1.0) -> dict:
    """Weights of a logistic model with L2 penalty 1 / c, classes weighted to equal sums; a missing class is an error.

    Fitted by the library's distributed solver: with class weights that add up to n, its penalty is 1 / (c n).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.na.drop(subset=[*features, target])
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(F.col(target).cast("int"))).first()
    if not ones or ones == n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col(target) == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    ready = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.withColumn("_w", weight).withColumn("_y", F.col(target).cast("double")))
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(ready)
    return {"intercept": float(fitted.intercept), "weights": dict(zip(features, map(float, fitted.coefficients)))}


def judge_logistic(df: DataFrame, features: list[str], target: str, group: str, c: float = 1.0, folds: int = 3) -> tuple[DataFrame, dict]:
    """(out-of-fold rows, report) of balanced_logistic with whole groups held out, folds balanced by rows and by ones.

    The rows gain fold and probability; the report has accuracy, precision, recall and F1 at 0.5, and the rows of each fold.  A fold whose
    other folds lack a class has no probability.
    """
    rows = df.na.drop(subset=[*features, target, group])
    rows = cut(rows.join(balanced_folds(rows, group, target, folds), group))
    guess = F.lit(None).cast("double")
    for k in range(folds):
        others = rows.where(F.col("fold") != k)
        if others.select(target).distinct().count() == 2:
            model = balanced_logistic(others, features, target, c)
            z = _apply(features, model["intercept"], [model["weights"][f] for f in features])
            guess = F.when(F.col("fold") == k, 1 / (1 + F.exp(-z))).otherwise(guess)
    judged = rows.withColumn("probability", guess)
    yes, one = F.col("probability") >= 0.5, F.col(target) == 1
    n = judged.where("probability IS NOT NULL").agg(F.count_if(yes & one).alias("tp"), F.count_if(yes & ~one).alias("fp"), F.count_if(~yes & one).alias("fn"), F.count_if(~yes & ~one).alias("tn")).first()
    share = lambda a, b: a / b if b else 0.0
    p, r = share(n.tp, n.tp + n.fp), share(n.tp, n.tp + n.fn)
    sizes = {x["fold"]: x["count"] for x in judged.groupBy("fold").count().collect()}
    return judged, {"accuracy": share(n.tp + n.tn, sum(n)), "precision": p, "recall": r, "f1": share(2 * p * r, p + r), "rows": sizes}
