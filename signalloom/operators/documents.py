"""Operators on collected documents: filters, exact duplicates, trust, confirmations, corpus upkeep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import terms
from signalloom.functions import text as T
from signalloom.functions import vocabulary as V


def matches_topic(text: Column, keywords: list[str]) -> Column:
    """Any keyword as a substring; without keywords everything matches."""
    return F.lit(True) if not keywords else T.contains_any(text, keywords)


def topic_match(text: Column, keywords: list[str], bilingual: bool = False) -> Column:
    """At least two (or all, if fewer) distinct keywords among the text's words; nothing matches without keywords.

    If ``bilingual``, Russian words stand for their English terms on both sides, and a Cyrillic keyword
    of over five letters matches any word that begins with all but its last two.
    """
    keywords = list(dict.fromkeys(keywords))
    if not keywords:
        return F.lit(False)
    words = (lambda x: terms.expand(T.topic_words(x))) if bilingual else T.topic_words

    def hit(w: Column, k: str) -> Column:
        found = F.arrays_overlap(w, words(F.lit(k)))
        if bilingual and len(k) > 5 and re.search("[а-яё]", k.lower()):
            found = found | F.exists(w, lambda x: x.startswith(k.lower()[:-2]))
        return F.coalesce(found, F.lit(False)).cast("int")

    return T.once(words(text), lambda w: sum((hit(w, k) for k in keywords[1:]), hit(w, keywords[0])) >= min(2, len(keywords)))


def exclusion_reason(match: Column, as_of: str, max_age_days: int | None, status: Column, text: Column, scope: Column, published: Column) -> Column:
    """Null for a selected document, else the first reason that applies; an unknown date passes."""
    age = F.datediff(F.lit(as_of).cast("date"), published)
    out = F.when(status != "ok", "fetch_failed").when((F.trim(F.coalesce(text, F.lit(""))) == "") | (scope == "search_snippet"), "no_source_text")
    out = out.when(~match, "insufficient_topic_overlap").when(age < 0, "future_publication")
    return out if max_age_days is None else out.when(age > max_age_days, "outside_time_window")


def keep_longest(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row per key: the longest text, the first of equals.  Partial maxima come before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.length(text), -F.col(order))).alias("r"))
    return best.select("r.*")


def trust_level(status: Column, kind: Column, confidence: Column, corroborating: Column) -> Column:
    low = F.when(corroborating >= 1, "medium").otherwise("low")
    backed = F.when(kind == "analyst_report", "high").otherwise("medium")
    middle = F.when((corroborating >= 1) | (kind == "developer_publication"), backed).when(confidence >= 0.6, "medium").otherwise("low")
    return F.when(status != "ok", "unverified").when(kind.isin(V.HIGH_TYPES), "high").when(kind.isin(V.LOW_TYPES), low).otherwise(middle)


def confirmations(df: DataFrame, by: str, cluster: str = "cluster", doc: str = "doc_id", domain: str = "domain", kind: str = "source_type", duplicate: str = "duplicate_of") -> DataFrame:
    """(by, confirmations, clusters): event clusters that are more than one low-trust domain."""
    own = df.where(F.col(duplicate).isNull()).withColumn("c", F.coalesce(F.col(cluster).cast("string"), F.col(doc).cast("string")))
    events = own.groupBy(by, "c").agg(F.countDistinct(domain).alias("domains"), F.bool_and(F.col(kind).isin(V.LOW_TYPES)).alias("low"))
    return events.groupBy(by).agg(F.count_if(~((F.col("domains") == 1) & F.col("low"))).alias("confirmations"), F.count(F.lit(1)).alias("clusters"))


def merge_documents(state: DataFrame, batch: DataFrame, key: str, payload: str, cycle: str) -> tuple[DataFrame, DataFrame]:
    """(new state, archived versions) of rows (key, payload, first_seen, last_seen) and a batch (key, payload)."""
    new = batch.select(key, F.col(payload).alias("new"))
    both = state.join(new, key, "full")
    merged = both.select(
        key,
        F.coalesce("new", payload).alias(payload),
        F.coalesce("first_seen", F.lit(cycle)).alias("first_seen"),
        F.when(F.col("new").isNotNull(), F.lit(cycle)).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    return merged, both.where(F.col("new").isNotNull() & F.col(payload).isNotNull()).select(key, payload, F.lit(cycle).alias("archived_in"))


def merge_candidates(state: DataFrame, batch: DataFrame, key: str, cycle: str, refreshed: list[str]) -> DataFrame:
    """State rows (key, refreshed.., times_seen, first_seen, last_seen): seen again adds one and refreshes scores."""
    both = state.alias("s").join(batch.select(key, *refreshed, F.lit(True).alias("here")).alias("b"), key, "full")
    return both.select(
        key,
        *[F.when(F.col("b.here"), F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in refreshed],
        (F.coalesce("s.times_seen", F.lit(0)) + F.when(F.col("b.here"), 1).otherwise(0)).alias("times_seen"),
        F.coalesce("s.first_seen", F.lit(cycle)).alias("first_seen"),
        F.when(F.col("b.here"), F.lit(cycle)).otherwise(F.col("s.last_seen")).alias("last_seen"),
    )


def least_recently_queried(labels: DataFrame, rotation: DataFrame, limit: int) -> DataFrame:
    """Labels never queried come first, then the longest ago, then the least often."""
    both = labels.join(rotation, "label", "left")
    return both.orderBy(F.col("last_queried_cycle").asc_nulls_first(), F.coalesce("times_queried", F.lit(0)), "label").limit(limit).select("label")


def adaptive_seeds(candidates: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """The best candidates that have not seeded a query yet."""
    return candidates.join(used, "candidate_id", "left_anti").orderBy(F.desc("relevance_score"), "candidate_id").limit(limit)


def within_days(pairs: DataFrame, df: DataFrame, doc: str, at: str, days: int) -> DataFrame:
    """The pairs (a, b) whose dates are at most ``days`` apart; an unknown date passes."""
    one, two = (df.select(F.col(doc).alias(c), F.col(at).alias(f"at_{c}")) for c in "ab")
    near = F.abs(F.datediff("at_a", "at_b")) <= days
    return pairs.join(one, "a").join(two, "b").where(F.coalesce(near, F.lit(True))).select("a", "b")


def primary_document(df: DataFrame, by: str, doc: str, text: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(doc, F.struct(F.length(text), -F.col(doc))).alias(doc))


def one_per_group(df: DataFrame, group: str, score: str, tie: str, limit: int) -> DataFrame:
    best = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place").orderBy(F.desc(score), tie).limit(limit)
