"""Independent sources of a claim, subjects that several of them confirm, and the stage these amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.functions import vocabulary as V
from signalloom.operators.evidence import feature_flags
from signalloom.operators.gates import stage_of, strict_date
from signalloom.operators.overlap import components

EARLY, MATURE = ("early_stage", "limited_adoption"), ("mass_adoption", "industry_standard")
LASTING_DAYS = 90


def valid_claims(claims: DataFrame, sources: DataFrame, by: str, as_of: str, order: str) -> DataFrame:
    """Claims (by, source_id, feature, quote, order, ..) whose quote stands in the source (source_id, text, published_at),
    dated in full and not after ``as_of``; of equal ones the first by ``order``.  Unknown sources and null quotes drop out."""
    texts = sources.select("source_id", F.col("text").alias("source_text"), strict_date(F.col("published_at")).alias("published"))
    held = claims.join(texts, "source_id").where((F.col("quote") != "") & F.col("source_text").contains(F.col("quote")))
    held = held.where(F.col("published") <= F.lit(as_of).cast("date")).drop("source_text")
    first = held.groupBy(by, "source_id", "feature", "quote").agg(F.min_by(F.struct(*held.columns), order).alias("r"))
    return first.select("r.*")


def anchors(words: Column) -> Column:
    """All pairs (x, y) of a sorted array's terms, x before y."""
    return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def independent_groups(members: DataFrame, links: DataFrame, bucket: list[str]) -> DataFrame:
    """(bucket.., feature, source_id, independent): sources of a bucket and feature, joined if they share ``grp`` or a link.

    ``members`` has the bucket's columns, feature, source_id and grp; ``links`` (a, b, feature) count for
    one feature, or for all where it is null.  ``independent`` is the least source that one is joined to.
    Sources of one grp are joined to its least, not to each other, so a large group gives one edge a row.
    """
    keys = [*bucket, "feature"]
    m = members.select(*keys, "source_id", "grp").distinct()
    node = lambda c: F.struct(*keys, F.col(c).alias("source_id"))
    first = m.groupBy(*keys, "grp").agg(F.min("source_id").alias("first"))
    same = m.join(first, [*keys, "grp"]).select(node("first").alias("a"), node("source_id").alias("b"))
    sides = links.select(F.col("a").alias("source_id"), "b", F.col("feature").alias("only"))
    near = m.join(sides, "source_id").where("only IS NULL OR only = feature").select(*keys, "source_id", "b").distinct()
    linked = near.join(m.select(*keys, F.col("source_id").alias("b")).distinct(), [*keys, "b"]).select(node("source_id").alias("a"), node("b").alias("b"))
    return components(same.union(linked)).select("node.*", F.col("component")["source_id"].alias("independent"))


def _reviewed(claims: DataFrame) -> DataFrame:
    return claims.where(F.coalesce("reviewed", F.lit(False)) & (F.coalesce("grp", F.lit("")) != ""))


def independent_counts(claims: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """(by, feature, groups): independent sources behind each feature, of claims with a reviewed grp."""
    return independent_groups(_reviewed(claims), links, [by]).groupBy(by, "feature").agg(F.countDistinct("independent").alias("groups"))


def scope_groups(claims: DataFrame, links: DataFrame, by: str, least: int = 2) -> DataFrame:
    """(by, x, y, feature, groups, first_date, span_days): pairs of subject terms under which at least ``least`` independent
    sources state a feature; the span lies between the groups' first dates, so a later reprint adds no time.

    Over claims (by, source_id, feature, terms, grp, reviewed, published); terms are sorted and distinct.
    """
    keys = [by, "x", "y", "feature"]
    rows = _reviewed(claims).select(by, "source_id", "feature", "grp", "published", F.inline(anchors(F.col("terms"))))
    dated = rows.groupBy(*keys, "source_id").agg(F.min("published").alias("published"))
    found = independent_groups(rows, links, [by, "x", "y"]).join(dated, [*keys, "source_id"])
    firsts = found.groupBy(*keys, "independent").agg(F.min("published").alias("published"))
    out = firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.min("published").alias("first_date"), F.datediff(F.max("published"), F.min("published")).alias("span_days"))
    return out.where(F.col("groups") >= least)


def evaluate_signals(claims: DataFrame, sources: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """(by, flags.., stage, support) of candidates from their valid claims (as in scope_groups) and sources (by, source_type).

    A candidate with sources but no claims is uncertain; without sources it has no row.
    """
    c = F.col
    scope = scope_groups(claims, links, by)
    long = lambda f: F.bool_or((c("feature") == f) & (c("span_days") >= LASTING_DAYS))
    pairs = scope.groupBy(by, "x", "y").agg((long(EARLY[0]) & long(EARLY[1])).alias("lasting"), F.bool_or(c("feature").isin(*EARLY, *MATURE)).alias("shared"))
    shared = pairs.groupBy(by).agg(F.bool_or("lasting").alias("lasting"), F.bool_or("shared").alias("shared"))
    side = lambda names: claims.where(c("feature").isin(*names)).select(by, F.inline(anchors(c("terms")))).distinct()
    # two claims share two terms or more just where they share a pair of terms, so no pairs of claims are made
    conflicts = side(EARLY).join(side(MATURE), [by, "x", "y"], "left_semi").select(by).distinct().withColumn("potential_conflict", F.lit(True))
    flags = feature_flags(claims, by, [*EARLY, *MATURE, "relevance"]).withColumn("any_claim", F.lit(True))
    all_low = sources.groupBy(by).agg(F.bool_and(F.coalesce(c("source_type").isin(V.LOW_TYPES), F.lit(False))).alias("promotional"))
    out = all_low.join(flags, by, "left").join(shared, by, "left").join(conflicts, by, "left")
    return stage_of(out.na.fill(False))
