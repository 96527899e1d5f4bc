"""Exported candidates joined to their documents, and reviews held against evidence and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions import vocabulary as V


def adapt_sources(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """(candidate_id, source_id, place, source_type, published_at, warning) of candidates (candidate_id, source_doc_ids).

    Each listed id once, by its first place.  ``warning`` names an unknown document or one without text or
    title; such rows carry no source.  An estimated date is null.  Documents have (doc_id, text, title,
    source_type, published_at, published_at_is_estimated).
    """
    c = F.col
    listed = candidates.select("candidate_id", F.posexplode(F.array_distinct("source_doc_ids")).alias("place", "source_id"))
    known = documents.select(F.col("doc_id").alias("source_id"), "text", "title", "source_type", "published_at", "published_at_is_estimated", F.lit(True).alias("here"))
    both = listed.join(known, "source_id", "left")
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    warning = F.when(c("here").isNull(), F.concat(F.lit("Missing document: "), "source_id")).when(blank("text") | blank("title"), F.concat(F.lit("Empty document: "), "source_id"))
    kinds = F.create_map(*[F.lit(x) for pair in V.ADAPTED_TYPES.items() for x in pair])
    day = F.when(~F.coalesce("published_at_is_estimated", F.lit(False)), F.nullif(F.substring("published_at", 1, 10), F.lit("")))
    good = lambda x: F.when(c("warning").isNull(), x)
    rows = both.withColumn("warning", warning)
    return rows.select("candidate_id", "source_id", "place", good(F.coalesce(kinds[c("source_type")], F.lit("unknown"))).alias("source_type"), good(day).alias("published_at"), "warning")


def review_errors(reviews: DataFrame, evidence: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """The reviews with doc_id, quote and ``error``, the first that applies; null for a review that may be imported.

    reviews (candidate_id, evidence_id, feature, reviewer, rationale, event_status), evidence (candidate_id,
    evidence_id, doc_id, quote, is_future_looking, is_generated_summary), documents (doc_id, text,
    is_generated_summary), sources from adapt_sources().
    """
    c, no = F.col, F.lit(False)
    keys = ["candidate_id", "evidence_id"]
    usable = sources.where("warning IS NULL").select("candidate_id", F.col("source_id").alias("doc_id"), F.lit(True).alias("usable"))
    texts = documents.select("doc_id", F.col("text").alias("source_text"), F.col("is_generated_summary").alias("generated"))
    repeated = reviews.groupBy(*keys, "feature").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    owners = sources.select("candidate_id", F.lit(True).alias("owner")).distinct()
    rows = reviews.join(repeated, [*keys, "feature"], "left").join(evidence, keys, "left").join(usable, ["candidate_id", "doc_id"], "left").join(texts, "doc_id", "left").join(owners, "candidate_id", "left")
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    quoted = F.coalesce((c("quote") != "") & c("source_text").contains(c("quote")), no)
    error = F.when(c("owner").isNull(), "unknown_candidate").when(c("usable").isNull(), "missing_evidence_or_source").when(~F.coalesce(c("feature").isin(V.REVIEW_FEATURES), no), "unknown_feature")
    error = error.when(c("repeated"), "repeated_review").when(blank("reviewer") | blank("rationale"), "reviewer_and_rationale_required")
    error = error.when(F.coalesce("is_generated_summary", no) | F.coalesce("generated", no), "generated_summary").when(~quoted, "quote_not_in_document")
    error = error.when(F.coalesce("is_future_looking", no) & c("event_status").eqNullSafe("observed"), "future_claim_as_observed")
    return rows.withColumn("error", error).drop("repeated", "usable", "owner", "source_text", "generated")


def import_reviews(checked: DataFrame) -> DataFrame:
    """The reviews as evidence of their candidate; ValueError if review_errors() found any fault."""
    bad = checked.where("error IS NOT NULL").select("error").distinct().orderBy("error")
    found = [r.error for r in bad.collect()]  # at most one row for each kind of fault
    if found:
        raise ValueError("reviews refused: " + ", ".join(found))
    return checked.drop("error").withColumn("evidence_id", F.concat("evidence_id", F.lit(":"), "feature")).withColumnRenamed("doc_id", "source_id")


def with_notes(cards: DataFrame, notes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cards with the editor's fields in place of their own where a note gives them."""
    theirs = notes.select(key, *[F.col(f).alias(f"note_{f}") for f in fields])
    joined = cards.join(theirs, key, "left")
    return joined.select(*[F.coalesce(f"note_{f}", f).alias(f) if f in fields else F.col(f) for f in cards.columns])
