"""Queries of the evidence gates, bilingual terms and saved payloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.functions import terms
from signalloom.functions import text as T
from signalloom.functions import vocabulary as V
from signalloom.operators import gates as G
from signalloom.operators import profile as R
from signalloom.plans.registry import AS_OF, BASE, FOLD, ORACLES, QUERIES, TOK, documents, query  # noqa: F401
from signalloom.sources import pages as W
from signalloom.sources import payloads as P

_pick = lambda values, c="doc_id": F.array(*[F.lit(v) for v in values])[(F.col(c) % len(values)).cast("int")]
_pick_sql = lambda values, c="doc_id": "list_extract([" + ",".join("NULL" if v is None else f"'{v}'" for v in values) + f"], CAST({c} % {len(values)} AS INTEGER) + 1)"
FEATURES = ["relevance", "early_stage", "limited_adoption", "mass_adoption"]
DATES = ["2026-01-15", "2026-02", "2026-05-01", None, "2026-06-30", "2027-01-01", "2025-12-31"]
STATUSES = ["observed", "observed", "planned"]

_ev = f"""SELECT doc_id, {_pick_sql(FEATURES)} AS feature, doc_id % 5 <> 0 AS reviewed, doc_id % 7 <> 0 AS scope_matches, CASE WHEN doc_id % 6 = 0 THEN 'zz ' || substr(text, 11, 40) ELSE substr(text, 11, 40) END AS quote,
 CASE WHEN doc_id % 8 = 0 THEN 'other' ELSE 'topic' END AS evidence_query, {_pick_sql(STATUSES)} AS event_status, {_pick_sql(DATES)} AS observed_at, {_pick_sql(DATES, '(doc_id // 7)')} AS published_at, CASE WHEN doc_id % 10 <> 3 THEN text END AS source_text FROM documents"""
_valid = lambda c: f"regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}')"


def _reviewed(spark, d):
    c = F.col
    return documents(spark, d).select(
        "doc_id",
        _pick(FEATURES).alias("feature"),
        (c("doc_id") % 5 != 0).alias("reviewed"),
        (c("doc_id") % 7 != 0).alias("scope_matches"),
        F.concat(F.when(c("doc_id") % 6 == 0, "zz ").otherwise(""), F.substring("text", 11, 40)).alias("quote"),
        F.when(c("doc_id") % 8 == 0, "other").otherwise("topic").alias("evidence_query"),
        _pick(STATUSES).alias("event_status"),
        _pick(DATES).alias("observed_at"),
        F.array(*[F.lit(v) for v in DATES])[(F.expr("doc_id div 7") % len(DATES)).cast("int")].alias("published_at"),
        F.when(c("doc_id") % 10 != 3, c("text")).alias("source_text"),
    )


@query(
    "evidence_gate",
    f"""SELECT doc_id, CASE WHEN source_text IS NULL THEN 'unknown_source' WHEN NOT reviewed THEN 'semantic_review_required' WHEN NOT scope_matches THEN 'candidate_scope_not_confirmed'
 WHEN trim(quote) = '' OR NOT contains(source_text, quote) THEN 'quote_not_found_in_source' WHEN feature = 'relevance' AND evidence_query <> 'topic' THEN 'relevance_review_for_different_query'
 WHEN feature <> 'relevance' AND event_status <> 'observed' THEN 'not_an_observed_fact' WHEN published_at IS NULL OR observed_at IS NULL THEN 'date_required_for_as_of_assessment' WHEN NOT {_valid('published_at')} THEN 'invalid_date'
 WHEN published_at > '{AS_OF}' THEN 'future_evidence' WHEN NOT {_valid('observed_at')} THEN 'invalid_date' WHEN observed_at > '{AS_OF}' THEN 'future_evidence' END AS reason FROM ({_ev})""",
)
def evidence_gate(spark, d):
    return _reviewed(spark, d).select("doc_id", G.evidence_reason(AS_OF, F.lit("topic")).alias("reason"))


TYPES = ["research", "official", "university", "patent", "professional_media", "unknown"]
TOPIC = ["the", "from"]
_words = f"regexp_extract_all({FOLD.format('text')}, '{TOK}')"


@query(
    "source_gate",
    f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR doc_id % 11 = 0 THEN 'not_original_source_text' WHEN kind = 'unknown' OR doc_id % 5 = 4 THEN 'insufficient_source_trust' WHEN published IS NOT NULL AND NOT {_valid('published')} THEN 'invalid_publication_date'
 WHEN published IS NULL OR published > '{AS_OF}' THEN 'missing_or_future_publication_date' WHEN NOT list_has_any(w, ['thata', 'rehe', 'onen', 'thatas', 'rehes', 'onens']) THEN 'source_topic_not_established' END AS reason
 FROM (SELECT doc_id, {_pick_sql(TYPES)} AS kind, {_pick_sql(DATES)} AS published, {_words} AS w FROM documents)""",
)
def source_gate(spark, d):
    c = F.col
    rows = documents(spark, d).select(
        "doc_id", F.col("text").alias("title"), _pick(TYPES).alias("source_type"), F.when(c("doc_id") % 5 == 4, "low").otherwise("high").alias("trust_level"), F.lit("listed").alias("trust_reason"),
        (c("doc_id") % 9 == 0).alias("is_generated"), F.lit(False).alias("is_translated"), F.when(c("doc_id") % 11 == 0, "search_snippet").alias("text_scope"), _pick(DATES).alias("published_at"),
    )
    return rows.select("doc_id", G.source_reason(AS_OF, F.array(*[F.lit(x) for x in ("thata", "rehe", "onen")])).alias("reason"))


_flags = ["early_stage", "limited_adoption", "mass_adoption", "industry_standard", "relevance", "potential_conflict", "lasting", "shared", "any_claim", "promotional"]
_bits = ", ".join(f"(doc_id >> {i}) % 2 = 1 AS {f}" for i, f in enumerate(_flags))


@query(
    "stage_ladder",
    f"""SELECT doc_id, stage, CASE WHEN stage = 'conflicting' THEN 'conflicting' WHEN shared THEN 'corroborated' WHEN any_claim AND (early_stage OR limited_adoption OR mass_adoption OR industry_standard) THEN 'preliminary' WHEN promotional THEN 'promotional_only' ELSE 'insufficient' END AS support
 FROM (SELECT *, CASE WHEN (mass_adoption OR industry_standard) AND (early_stage OR limited_adoption) THEN CASE WHEN potential_conflict THEN 'conflicting' ELSE 'uncertain' END WHEN (mass_adoption OR industry_standard) AND relevance THEN 'mature'
 WHEN early_stage AND limited_adoption AND relevance THEN CASE WHEN lasting THEN 'emerging_trend' ELSE 'early_signal' END ELSE 'uncertain' END AS stage FROM (SELECT doc_id, {_bits} FROM documents))""",
)
def stage_ladder(spark, d):
    flags = documents(spark, d).select("doc_id", *[(F.shiftright("doc_id", i) % 2 == 1).alias(f) for i, f in enumerate(_flags)])
    return G.stage_of(flags).select("doc_id", "stage", "support")


_generic = "[" + ",".join(f"'{w}'" for w in V.GENERIC) + "]"


@query("subject_terms", rf"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({FOLD.format('text')}, '{TOK}'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\p{{Nd}}+') AND NOT list_contains({_generic}, w)))), ' ') AS terms FROM documents")
def subject_terms(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(terms.subject_terms(F.col("text")), " ").alias("terms"))


@query("companies", "SELECT n_nationkey, array_to_string(list_sort(['X ' || replace(n_name, ' ', '') || ' Robotics', replace(n_name, ' ', '') || ' Labs']), '|') AS found FROM nation")
def companies(spark, d):
    name = F.replace("n_name", F.lit(" "), F.lit(""))
    text = F.concat(F.lit("today X "), name, F.lit(" Robotics met "), name, F.lit(" Labs"))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.array_join(terms.companies(text, F.lit(None).cast("string")), "|").alias("found"))


@query("payload_github", "SELECT 'https://code.example/' || doc_id AS url, text AS title, lang AS snippet FROM documents")
def payload_github(spark, d):
    item = F.struct(F.concat(F.lit("https://code.example/"), "doc_id").alias("html_url"), F.col("text").alias("full_name"), F.col("lang").alias("description"), F.lit("2026-01-02T03:04:05Z").alias("created_at"))
    return P.github(documents(spark, d).select(F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))).select("url", "title", "snippet")


@query("payload_crossref", "SELECT 'https://doi.org/10.1000/' || doc_id AS url, make_date(CAST(2020 + doc_id % 5 AS INTEGER), CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 1 + doc_id % 12 END AS INTEGER), 1) AS published, TRUE AS date_estimated FROM documents")
def payload_crossref(spark, d):
    year, month = (F.lit(2020) + F.col("doc_id") % 5).cast("int"), (F.lit(1) + F.col("doc_id") % 12).cast("int")
    parts = F.array(F.when(F.col("doc_id") % 3 == 0, F.array(year)).otherwise(F.array(year, month)))
    item = F.struct(F.concat(F.lit("https://doi.org/10.1000/"), "doc_id").alias("URL"), F.array("title").alias("title"), F.struct(parts.alias("date-parts")).alias("issued"))
    rows = documents(spark, d).select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("payload"))
    return P.crossref(rows).select("url", F.to_date("published_at").alias("published"), "date_estimated")


@query("trust_summary", f"{BASE}, n AS (SELECT cand, trust_level, count(*) AS n FROM d GROUP BY cand, trust_level) SELECT cand, string_agg(trust_level || ': ' || n, '; ' ORDER BY trust_level || ': ' || n) AS summary FROM n GROUP BY cand")
def trust_summary(spark, d):
    return R.trust_summary(documents(spark, d), "cand")


@query("status_counts", f"{BASE} SELECT status, count(*) AS n FROM d GROUP BY status UNION ALL SELECT 'blocked', 0")
def status_counts(spark, d):
    return R.status_counts(documents(spark, d), "status", ["ok", "http_error", "blocked"])


@query("linear_score", "SELECT doc_id, greatest(3.0, least(7.0, 2.5 + 0.5 * (doc_id % 7) + 1.25 * (doc_id % 3))) AS score FROM documents")
def linear_score(spark, d):
    number = lambda m: (F.col("doc_id") % m).cast("double")
    rows = documents(spark, d).select("doc_id", F.create_map(F.lit("a"), number(7), F.lit("b"), number(3), F.lit("other"), F.lit(9.0)).alias("f"))
    return R.linear_score(rows, "doc_id", "f", {"a": 0.5, "b": 1.25}, 2.5, 3, 7).select("doc_id", "score")


@query("page_texts")
def page_texts(spark, d):
    """Main texts of raw pages; no SQL, tests hold the parser against small pages."""
    return W.parse_pages(spark.read.parquet(f"{d}/pages.parquet"))
