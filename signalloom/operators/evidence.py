"""Evidence extraction and the rule engines that score it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import vocabulary as V


def extract_evidence(df: DataFrame, doc: str, text: str, stages: dict[str, list[str]], advantages: list[str], cases: list[str], future: list[str], limit: int = 10) -> DataFrame:
    """(doc, pos, quote, claim_type, label, is_future) of the first ``limit`` sentences of a text that hold a marker.

    A sentence is a stage claim by the first label that matches, else an advantage, else a case.
    """
    rows = df.select(doc, F.posexplode(T.sentences(F.col(text))).alias("pos", "quote"))
    label = F.when(F.lit(False), "")
    for name, markers in stages.items():
        label = label.when(T.contains_any(F.col("quote"), markers), name)
    rows = rows.withColumn("label", label)
    kind = F.when(F.col("label").isNotNull(), "stage").when(T.contains_any(F.col("quote"), advantages), "advantage").when(T.contains_any(F.col("quote"), cases), "case")
    rows = rows.withColumn("claim_type", kind).where(F.col("claim_type").isNotNull()).withColumn("is_future", T.future_looking(F.col("quote"), future))
    first = Window.partitionBy(doc).orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).select(doc, "pos", "quote", "claim_type", "label", "is_future")


def candidate_features(evidence: DataFrame, documents: DataFrame, by: str, early: list[str]) -> DataFrame:
    """One row per candidate: counts and ratios over its claims and its documents that are no duplicates."""
    claims = evidence.groupBy(by).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("claim_type") == "stage").alias("stage_fact_count"),
        F.try_divide(F.count_if(F.col("label").isin(early)), F.count_if(F.col("claim_type") == "stage")).alias("early_stage_marker_ratio"),
        F.try_divide(F.count_if("is_future"), F.count(F.lit(1))).alias("future_looking_ratio"),
        F.coalesce(F.bool_or(F.col("claim_type") == "advantage"), F.lit(False)).alias("has_advantage_evidence"),
        F.coalesce(F.bool_or(F.col("claim_type") == "case"), F.lit(False)).alias("has_case_example_evidence"),
    )
    docs = documents.where(F.col("duplicate_of").isNull()).groupBy(by).agg(
        F.count_if(F.col("trust_level") == "high").alias("high_trust_source_count"),
        F.bool_or(F.col("source_type").isin("academic", "patent")).alias("has_academic_or_patent_evidence"),
        F.bool_and(F.col("source_type").isin(V.LOW_TYPES)).alias("lowest_trust_only"),
        F.countDistinct("domain").alias("distinct_domain_count"),
        F.when(F.count("published") >= 2, F.datediff(F.max("published"), F.min("published"))).alias("days_since_earliest_mention"),
        F.max("published").alias("latest_publication"),
    )
    return docs.join(claims, by, "left")


def relevance(f: DataFrame, as_of: str) -> DataFrame:
    """Add score, verdict and is_actual; weights are added in the rules' order, so sums agree at the thresholds."""
    c = F.col
    age = F.datediff(F.lit(as_of).cast("date"), c("latest_publication"))
    # Fixed values of the rule: weights, thresholds and ages.
    score = F.lit(0.5) + F.when(c("confirmations") == 0, -0.35).when(c("confirmations") == 1, 0.10).otherwise(0.30)
    for weight, rule in (
        (-0.25, c("lowest_trust_only")),
        (0.15, c("has_academic_or_patent_evidence")),
        (0.10, c("high_trust_source_count") > 0),
        (0.10, c("early_stage_marker_ratio") >= 0.5),
    ):
        score = score + F.when(rule, weight).otherwise(0.0)
    score = score + F.when(c("future_looking_ratio") >= 0.999, -0.05).when(c("future_looking_ratio").isNotNull(), 0.05).otherwise(0.0)
    score = score + F.when(c("has_advantage_evidence") | c("has_case_example_evidence"), 0.05).otherwise(0.0)
    score = score + F.when(age <= 180, 0.15).when(age > 540, -0.20).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    out = f.withColumn("score", score).withColumn("is_actual", F.when(age <= 180, True).when(age > 540, False))
    verdict = F.when((c("confirmations") == 0) & c("latest_publication").isNull(), "insufficient_evidence")
    return out.withColumn("verdict", verdict.when(c("score") >= 0.65, "likely_emerging_signal").when(c("score") >= 0.40, "worth_monitoring").otherwise("likely_noise"))


def feature_flags(claims: DataFrame, by: str, features: list[str]) -> DataFrame:
    return claims.groupBy(by).agg(*[F.coalesce(F.bool_or(F.col("feature") == f), F.lit(False)).alias(f) for f in features])


def _weighted(weights: dict[str, int]) -> Column:
    terms = [F.when(F.col(f), w).otherwise(0) for f, w in weights.items()]
    return sum(terms[1:], terms[0])


def automatic_decision(flags: DataFrame) -> DataFrame:
    """Add decision, reason and score of the automatic rules to a candidate's flags."""
    mature = F.col("mass_adoption") | F.col("industry_standard")
    complete = F.col("early_stage") & F.col("limited_adoption") & F.col("relevance")
    reason = F.when(mature & F.col("early_stage"), "conflicting_stage_claims").when(mature & F.col("relevance"), "explicit_maturity_claim")
    reason = reason.when(complete, "explicit_early_and_limited_scope_claims").otherwise("insufficient_explicit_evidence")
    decision = F.when(F.col("reason") == "explicit_maturity_claim", "likely_mature").when(F.col("reason") == "explicit_early_and_limited_scope_claims", "likely_weak").otherwise("needs_review")
    return flags.withColumn("reason", reason).withColumn("decision", decision).withColumn("score", _weighted(V.AUTOMATIC_WEIGHTS))


def reviewed_decision(flags: DataFrame) -> DataFrame:
    """Add decision and score of the reviewed-evidence rules: exclusions reject, gaps ask for review."""
    any_of = lambda names, test: test([F.col(n) for n in names])
    excluded = any_of(V.DETECTOR_EXCLUSIONS, lambda c: c[0] | c[1] | c[2] | c[3] | c[4])
    complete = any_of(V.DETECTOR_REQUIRED, lambda c: c[0] & c[1] & c[2] & c[3])
    scored = flags.withColumn("score", _weighted(V.DETECTOR_WEIGHTS))
    return scored.withColumn("decision", F.when(excluded, "reject").when(complete & (F.col("score") >= 70), "weak").otherwise("needs_review"))


def preliminary(assessed: DataFrame, taken: DataFrame, limit: int = 15) -> DataFrame:
    """Candidates for free places: an early claim on the topic, no maturity, otherwise too little evidence."""
    if limit <= 0:
        return assessed.limit(0)
    pool = assessed.where("decision = 'needs_review' AND reason = 'insufficient_explicit_evidence' AND early_stage AND relevance AND NOT mass_adoption AND NOT industry_standard")
    return pool.join(taken.select("candidate_id"), "candidate_id", "left_anti").orderBy(F.desc("score"), "candidate_id").limit(limit)


def logistic(terms: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), terms))))


def confusion(df: DataFrame, truth: str, decision: str, positive: str, negative: str) -> DataFrame:
    """Counts and ratios of decisions against 0/1 truth; every other decision abstains; ratios are null over nothing."""
    yes, no = F.col(decision) == positive, F.col(decision) == negative
    hit, miss = F.col(truth) == 1, F.col(truth) == 0
    counts = df.agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(yes & miss).alias("fp"), F.count_if(no & hit).alias("fn"), F.count_if(no & miss).alias("tn"), F.count_if(~yes & ~no).alias("abstained"), F.count(F.lit(1)).alias("n")
    )
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(F.col("n") - F.col("abstained"), "n").alias("coverage"))


def regression_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean absolute and root mean squared error, and the share of guesses that round half up to the truth."""
    d = F.col(guess) - F.col(truth)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg((F.floor(F.col(guess) + 0.5) == F.col(truth)).cast("int")).alias("exact"))
