"""Decisions held against labels, resampled errors, and groups of rows that must stay in one fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.operators.overlap import components

DECISIONS = {"likely_weak": "positive", "likely_mature": "negative", "needs_review": "abstain"}


def one_to_one(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The joined rows; ValueError unless every key stands once on either side.  One aggregated row comes to the driver."""
    left = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n_predictions"))
    right = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n_labels"))
    both = left.join(right, left[key].eqNullSafe(right[key]), "full")
    good = F.coalesce((F.col("n_predictions") == 1) & (F.col("n_labels") == 1), F.lit(False))
    bad = both.agg(F.count_if(~good).alias("bad")).first().bad
    if bad:
        raise ValueError(f"{bad} keys lack exactly one prediction and one label")
    return predictions.join(labels, key)


def decision_matrix(df: DataFrame, truth: str, decision: str, truths: list) -> DataFrame:
    """(truth, positive, negative, abstain): one row for each of ``truths``, with zeros where it does not occur."""
    counts = df.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(decision) == d).alias(n) for d, n in DECISIONS.items()])
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in truths])).alias("truth"))
    return every.join(counts, "truth", "left").na.fill(0, list(DECISIONS.values()))


def binary_report(df: DataFrame, truth: str, decision: str) -> DataFrame:
    """One row of ratios; abstaining on a positive case misses it; truth other than 0 and 1 is unresolved and counted apart."""
    c, yes, no = F.col, F.col(truth) == 1, F.col(truth) == 0
    is_ = lambda d: F.col(decision) == d
    n = df.agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(yes | no).alias("n_resolved"), F.count_if(yes & is_("likely_weak")).alias("tp"), F.count_if(no & is_("likely_weak")).alias("fp"),
        F.count_if(yes & ~is_("likely_weak")).alias("fn"), F.count_if(no & is_("likely_mature")).alias("tn"), F.count_if((yes | no) & is_("needs_review")).alias("abstained"),
        F.count_if(~F.coalesce(yes | no, F.lit(False)) & is_("likely_weak")).alias("unresolved_called_weak"),
    )
    return n.select(
        "*",
        F.try_divide("tp", c("tp") + c("fp")).alias("precision"),
        F.try_divide("tp", c("tp") + c("fn")).alias("recall"),
        F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        F.try_divide(c("n_resolved") - c("abstained"), "n_resolved").alias("decision_coverage"),
        F.try_divide(c("tp") + c("tn"), "n_resolved").alias("correct_fraction"),
    )


def _draw(sample: Column, place: Column, seed: int, n: Column) -> Column:
    """A place from 0 to n - 1, the same in every run: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), sample, place)), 1, 15), 16, 10).cast("long") % n


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Add place, 0 to rows - 1 in the order of (start of the key's digest, key): 4096 small sorts, no task for all rows."""
    rows = df.withColumn("slot", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    before = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n_slot"))
    before = before.select("slot", (F.sum("n_slot").over(Window.orderBy("slot")) - F.col("n_slot")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(key)) - 1
    return rows.withColumn("inside", inside).join(before, "slot").withColumn("place", (F.col("before") + F.col("inside")).cast("long")).drop("slot", "inside", "before")


def bootstrap_error(df: DataFrame, truth: str, guess: str, group: str, samples: int = 2000, seed: int = 42, levels: tuple = (0.025, 0.975)) -> DataFrame:
    """(low, high) of the mean absolute error over ``samples`` resamples of whole groups.

    Rows are summed by group first; each resample draws as many groups as there are, with replacement,
    as one join of samples x groups small rows, so nothing but the quantiles leaves the executors.
    """
    error = F.abs(F.col(guess) - F.col(truth))
    sums = df.groupBy(group).agg(F.sum(error).alias("e"), F.count(error).alias("n"))
    ranked = _numbered(sums, group)
    size = ranked.count()
    if not size:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    grid = df.sparkSession.range(samples * size).select((F.col("id") % samples).alias("sample"), F.floor(F.col("id") / samples).alias("i"))
    drawn = grid.select("sample", _draw(F.col("sample"), F.col("i"), seed, F.lit(size)).alias("place")).join(ranked, "place")
    means = drawn.groupBy("sample").agg((F.sum("e") / F.sum("n")).alias("mean"))
    return means.agg(F.percentile("mean", levels[0]).alias("low"), F.percentile("mean", levels[1]).alias("high"))


def merged_groups(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """(row, group): rows that share a value of any key column, directly or through others; the least row names the group.

    Null keys join nothing.  Rows are tied to a value's least row, not to each other.
    """
    tagged = df.select(F.col(row).alias("row"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("key")).where(F.col("key.value").isNotNull())
    heads = tagged.groupBy("key").agg(F.min("row").alias("a"))
    edges = tagged.join(heads, "key").select("a", F.col("row").alias("b"))
    alone = df.select(F.col(row).alias("a"), F.col(row).alias("b"))
    return components(edges.union(alone)).select(F.col("node").alias(row), F.col("component").alias("group"))


def token_features(text: Column, domain: Column) -> Column:
    """Map of features: each distinct word of two letters or more at 1 / sqrt(words), and the domain at 1; none for blank text."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(T.fold(text), F.lit(T.TOKEN), F.lit(0)), lambda w: F.length(w) >= 2))
    known = F.array(F.struct(F.concat(F.lit("domain:"), F.coalesce(domain, F.lit("unknown"))).alias("k"), F.lit(1.0).alias("v")))

    def weighted(found: Column) -> Column:
        share = 1 / F.sqrt(F.size(found))
        return F.map_from_entries(F.concat(F.transform(found, lambda w: F.struct(F.concat(F.lit("word:"), w).alias("k"), share.alias("v"))), known))

    return F.when(F.trim(text) != "", T.once(words, weighted))


def rank_report(assessed: DataFrame, limit: int = 15) -> tuple[DataFrame, DataFrame, dict]:
    """(results, suppressed, summary) of rows (candidate_id, technology_group_id, decision, score).

    Weak candidates by score, one a group, at most ``limit``; the others of a group are suppressed.
    A limit below 1 and a repeated id are errors; a missing group is the candidate's own.
    """
    if type(limit) is not int or limit < 1:
        raise ValueError("limit must be a positive integer")
    if not assessed.groupBy("candidate_id").count().where("count > 1").isEmpty():
        raise ValueError("repeated candidate_id")
    group = F.coalesce(F.nullif(F.col("technology_group_id").cast("string"), F.lit("")), F.col("candidate_id").cast("string"))
    weak = assessed.where("decision = 'weak'").withColumn("g", group)
    first = weak.groupBy("g").agg(F.min_by("candidate_id", F.struct(-F.col("score"), "candidate_id")).alias("first"))
    ranked = weak.join(first, "g").drop("g")
    chosen = ranked.where("candidate_id = first").drop("first")
    counts = {d: F.count_if(F.col("decision") == d).alias(d) for d in ("weak", "reject", "needs_review")}
    totals = assessed.agg(*counts.values()).first().asDict()
    summary = {"requested_limit": limit, "insufficient_results": chosen.count() < limit, "counts": totals}
    return chosen.orderBy(F.desc("score"), "candidate_id").limit(limit), ranked.where("candidate_id <> first").select("candidate_id"), summary
