"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it.

The documents have no title, address, date or source type; both sides derive them from the
row's own columns alike.  Marker lists are parameters, here words that these texts use.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import urls as U
from signalloom.functions import vocabulary as V
from signalloom.operators import documents as D
from signalloom.operators import evidence as E
from signalloom.operators import overlap as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF, MAX_AGE = "2026-06-30", 540
STAGES = {"pilot": ["rehan", "erwh"], "patent": ["thst", "enst"], "launch": ["tionre"]}
EARLY, ADVANTAGES, CASES, FUTURE, MODALS = ["pilot", "patent"], ["inthe"], [" with "], ["heingat", "schver"], ["that", "für"]
KEYWORDS = {"alpha": ["the", "and"], "beta": ["der", "die"], "gamma": ["de", "la"]}
TOPIC = ["that", "from", "with"]
FEATURES = {"early_stage": " that ", "limited_adoption": " from the ", "mass_adoption": "idiot", "industry_standard": "rights reserved", "relevance": " the "}
TOK = r"[\p{L}\p{N}_]+"


def documents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.substring("text", 1, 80).alias("title"),
        F.date_add(F.lit("2025-01-01").cast("date"), (c("doc_id") % 600).cast("int")).alias("published"),
        F.array(*[F.lit(t) for t in V.SOURCE_TYPES])[(c("doc_id") % 15).cast("int")].alias("source_type"),
        F.concat("source", F.lit("-"), "lang").alias("cand"),
        F.concat("source", F.lit(".example")).alias("domain"),
        F.expr("doc_id div 3").alias("cluster"),
        F.when(c("doc_id") % 11 == 0, c("doc_id") - 1).alias("duplicate_of"),
        ((F.lit(35) + 10 * (c("doc_id") % 7)) / 100.0).alias("confidence"),
        F.when(c("doc_id") % 13 == 0, "http_error").otherwise("ok").alias("status"),
    )
    return rows.withColumn("trust_level", D.trust_level(c("status"), c("source_type"), c("confidence"), F.lit(0)))


_types = "[" + ",".join(f"'{t}'" for t in V.SOURCE_TYPES) + "]"
_in = lambda names: "(" + ",".join(f"'{n}'" for n in names) + ")"
BASE = f"""WITH d0 AS (SELECT doc_id, text, lang, source, substr(text,1,80) AS title, DATE '2025-01-01' + CAST(doc_id % 600 AS INTEGER) AS published,
 list_extract({_types}, CAST(doc_id % 15 AS INTEGER) + 1) AS source_type, source || '-' || lang AS cand, source || '.example' AS domain, doc_id // 3 AS cluster,
 CASE WHEN doc_id % 11 = 0 THEN doc_id - 1 END AS duplicate_of, (35 + 10 * (doc_id % 7)) / 100.0 AS confidence, CASE WHEN doc_id % 13 = 0 THEN 'http_error' ELSE 'ok' END AS status FROM documents),
d AS (SELECT *, CASE WHEN status <> 'ok' THEN 'unverified' WHEN source_type IN {_in(V.HIGH_TYPES)} THEN 'high' WHEN source_type IN {_in(V.LOW_TYPES)} THEN 'low'
 WHEN source_type = 'developer_publication' THEN 'medium' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS trust_level FROM d0)"""
SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([А-ЯA-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 15)"
FOLD = "replace(lower({0}), 'ß', 'ss')"


def _like(col: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{m}')" for m in markers) + ")"


def _future(col: str) -> str:
    return rf"(regexp_matches(lower({col}), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(MODALS)})($|[^\p{{L}}\p{{N}}_])') OR {_like(col, FUTURE)})"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


_q = "list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains([" + ",".join(f"'{t}'" for t in V.TRACKING) + "], lower(split_part(p, '=', 1)))))"
NORM = rf"""SELECT page_id, url, coalesce(nullif(lower(regexp_extract(url, '^([A-Za-z]+):', 1)), ''), 'https') || '://' || host ||
 CASE WHEN length(path) > 1 AND ends_with(path, '/') THEN left(path, length(path) - 1) WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS normalized, host
 FROM (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, {_q} AS q FROM pages)"""


@query("url_normalize", f"SELECT page_id, normalized FROM ({NORM})")
def url_normalize(spark, d):
    return _pages(spark, d).select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query("url_domain", f"SELECT host AS domain, count(*) AS n_pages FROM ({NORM}) GROUP BY host")
def url_domain(spark, d):
    return _pages(spark, d).groupBy(U.domain_of(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n_pages"))


@query("url_doc_id", f"SELECT page_id, 'doc_' || substr(sha256(normalized), 1, 24) AS document_id FROM ({NORM})")
def url_doc_id(spark, d):
    return _pages(spark, d).select("page_id", U.document_id(F.col("url")).alias("document_id"))


_hosts = [h.lstrip("=") for _, _, hosts in V.HOST_TYPES for h in hosts] + ["example.com", "notarxiv.org"]


@query(
    "source_type",
    "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(host, '{'|'.join(('^' + h[1:] if h[0] == '=' else '(^|[.])' + h).replace('.', '[.]').replace('[[.]]', '[.]') + '$' for h in hosts)}') THEN '{k}'" for k, _, hosts in V.HOST_TYPES)
    + " ELSE 'general_media' END AS source_type FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'a.' ELSE '' END || list_extract([" + ",".join(f"'{h}'" for h in _hosts) + f"], CAST(doc_id % {len(_hosts)} AS INTEGER) + 1) AS host FROM documents)",
)
def source_type(spark, d):
    host = F.concat(F.when(F.col("doc_id") % 3 == 1, "a.").otherwise(""), F.array(*[F.lit(h) for h in _hosts])[(F.col("doc_id") % len(_hosts)).cast("int")])
    return documents(spark, d).select("doc_id", U.source_type(F.concat(F.lit("https://"), host, F.lit("/x")))["type"].alias("source_type"))


@query("exact_dedup_url", f"SELECT page_id, normalized FROM (SELECT n.page_id, n.normalized, row_number() OVER (PARTITION BY n.normalized ORDER BY length(p.html) DESC, n.page_id) AS r FROM ({NORM}) n JOIN pages p USING (page_id)) WHERE r = 1")
def exact_dedup_url(spark, d):
    rows = _pages(spark, d).select("page_id", "html", U.normalize_url(F.col("url")).alias("normalized"))
    return D.keep_longest(rows, "normalized", "html", "page_id").select("page_id", "normalized")


@query("exact_dedup_text", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_text(spark, d):
    return documents(spark, d).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("tokens_count", f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all({FOLD.format('text')}, '{TOK}') AS t FROM documents)")
def tokens_count(spark, d):
    rows = documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_stop = "[" + ",".join(f"'{w}'" for w in V.STOP) + "]"


@query(
    "topic_words",
    rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({FOLD.format('text')}, '{TOK}'), lambda w: length(w) > 2 AND NOT list_contains({_stop}, w)),
 lambda w: CASE WHEN regexp_matches(w, '^[\x00-\x7F]{{5,}}$') AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END))), ' ') AS words FROM documents""",
)
def topic_words(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.topic_words(F.col("text")), " ").alias("words"))


@query("sentences", f"SELECT doc_id, len(s) AS n_sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def sentences(spark, d):
    rows = documents(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("n_chars"))


@query(
    "sentence_offsets",
    r"""WITH t AS (SELECT doc_id, unnest(p) AS tile, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS p FROM documents)),
 o AS (SELECT doc_id, tile, sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i) - length(tile) AS start FROM t)
 SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM o WHERE length(trim(tile)) >= 20 GROUP BY doc_id""",
)
def sentence_offsets(spark, d):
    tiles = documents(spark, d).select("doc_id", F.posexplode(T.tiles(F.col("text"))).alias("i", "tile"))
    start = F.sum(F.length("tile")).over(Window.partitionBy("doc_id").orderBy("i")) - F.length("tile")
    return tiles.withColumn("start", start).where(F.length(F.trim("tile")) >= 20).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"))


@query("future_claims", f"SELECT lang, count(*) AS n, CAST(sum(CASE WHEN {_future('s')} THEN 1 ELSE 0 END) AS BIGINT) AS n_future FROM (SELECT lang, unnest({SENT}) AS s FROM documents) GROUP BY lang")
def future_claims(spark, d):
    rows = documents(spark, d).select("lang", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.future_looking(F.col("s"), FUTURE, MODALS)).alias("n_future"))


_kw = {k: " + ".join(f"len(list_filter(w, lambda x: starts_with(x, '{m}')))" for m in ms) for k, ms in KEYWORDS.items()}


@query("domain_guess", f"SELECT doc_id, CASE WHEN greatest(a, b, g) = 0 THEN NULL WHEN a >= b AND a >= g THEN 'alpha' WHEN b >= g THEN 'beta' ELSE 'gamma' END AS domain FROM (SELECT doc_id, {_kw['alpha']} AS a, {_kw['beta']} AS b, {_kw['gamma']} AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOK}') AS w FROM documents))")
def domain_guess(spark, d):
    return documents(spark, d).select("doc_id", T.guess_domain(F.col("text"), KEYWORDS).alias("domain"))


@query("query_variants", "SELECT n_nationkey, trim(n_name || ' ' || m) AS query FROM nation, (SELECT unnest(['', 'prototype', 'pilot', 'preprint']) AS m)")
def query_variants(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.explode(T.query_variants(F.col("n_name"))).alias("query"))


@query("topic_filter", f"SELECT doc_id FROM documents WHERE {_like('text', ['thstand', 'schheit'])}")
def topic_filter(spark, d):
    return documents(spark, d).where(D.matches_topic(F.col("text"), ["thstand", "schheit"])).select("doc_id")


_terms = ["rehe", "erst", "thed", "onen"]
_match = " + ".join(f"CAST(list_contains(w, '{t}') AS INTEGER)" for t in _terms)
_words = f"regexp_extract_all({FOLD.format('text')}, '{TOK}')"


@query("topic_match", f"SELECT doc_id FROM (SELECT doc_id, {_words} AS w FROM documents) WHERE {_match} >= 2")
def topic_match(spark, d):
    return documents(spark, d).where(D.topic_match(F.col("text"), _terms)).select("doc_id")


_reason = f"""CASE WHEN status <> 'ok' THEN 'fetch_failed' WHEN trim(coalesce(text, '')) = '' THEN 'no_source_text' WHEN ({_match}) < 2 THEN 'insufficient_topic_overlap'
 WHEN published > DATE '{AS_OF}' THEN 'future_publication' WHEN DATE '{AS_OF}' - published > {MAX_AGE} THEN 'outside_time_window' END"""


def _reasons(spark, d):
    reason = D.exclusion_reason(D.topic_match(F.col("text"), _terms), AS_OF, MAX_AGE, F.col("status"), F.col("text"), F.lit(None).cast("string"), F.col("published"))
    return documents(spark, d).select("doc_id", reason.alias("reason"))


@query("select_documents", f"{BASE} SELECT doc_id FROM (SELECT *, {_words} AS w FROM d) WHERE {_reason} IS NULL")
def select_documents(spark, d):
    return _reasons(spark, d).where("reason IS NULL").select("doc_id")


@query("excluded_reasons", f"{BASE} SELECT reason, count(*) AS n FROM (SELECT {_reason} AS reason FROM (SELECT *, {_words} AS w FROM d)) WHERE reason IS NOT NULL GROUP BY reason")
def excluded_reasons(spark, d):
    return _reasons(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_label = "CASE " + " ".join(f"WHEN {_like('quote', ms)} THEN '{k}'" for k, ms in STAGES.items()) + " END"
EVIDENCE = f"""s AS (SELECT doc_id, cand, unnest({SENT}) AS quote, generate_subscripts({SENT}, 1) - 1 AS pos FROM d),
 m AS (SELECT *, {_label} AS label, {_future('quote')} AS is_future FROM s),
 k AS (SELECT *, CASE WHEN label IS NOT NULL THEN 'stage' WHEN {_like('quote', ADVANTAGES)} THEN 'advantage' WHEN {_like('quote', CASES)} THEN 'case' END AS claim_type FROM m),
 e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM k WHERE claim_type IS NOT NULL) WHERE n <= 10)"""


def _evidence(spark, d):
    rows = documents(spark, d)
    found = E.extract_evidence(rows, "doc_id", "text", STAGES, ADVANTAGES, CASES, FUTURE)
    return found.drop("is_future").withColumn("is_future", T.future_looking(F.col("quote"), FUTURE, MODALS))


@query("evidence_extract", f"{BASE}, {EVIDENCE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, quote, claim_type, label, is_future FROM e")
def evidence_extract(spark, d):
    return _evidence(spark, d).select("doc_id", "pos", "quote", "claim_type", "label", "is_future")


CONFIRM = f"""c AS (SELECT cand, count(CASE WHEN NOT (domains = 1 AND low) THEN 1 END) AS confirmations, count(*) AS clusters FROM
 (SELECT cand, cluster, count(DISTINCT domain) AS domains, bool_and(source_type IN {_in(V.LOW_TYPES)}) AS low FROM d WHERE duplicate_of IS NULL GROUP BY cand, cluster) GROUP BY cand)"""
FEATURE = f"""fe AS (SELECT cand, count(*) AS claims, count(CASE WHEN claim_type = 'stage' THEN 1 END) AS stage_fact_count,
 CASE WHEN count(CASE WHEN claim_type = 'stage' THEN 1 END) > 0 THEN count(CASE WHEN label IN {_in(EARLY)} THEN 1 END) / count(CASE WHEN claim_type = 'stage' THEN 1 END) END AS early_ratio, count(CASE WHEN is_future THEN 1 END) / count(*) AS future_ratio,
 bool_or(claim_type = 'advantage') AS has_advantage, bool_or(claim_type = 'case') AS has_case FROM e GROUP BY cand),
 fd AS (SELECT cand, count(CASE WHEN trust_level = 'high' THEN 1 END) AS high_docs, bool_or(source_type IN ('academic', 'patent')) AS academic, bool_and(source_type IN {_in(V.LOW_TYPES)}) AS low_only,
 count(DISTINCT domain) AS domains, CASE WHEN count(published) >= 2 THEN max(published) - min(published) END AS span, max(published) AS latest FROM d WHERE duplicate_of IS NULL GROUP BY cand),
 f AS (SELECT * FROM fd LEFT JOIN fe USING (cand))"""


def _features(spark, d):
    docs = documents(spark, d)
    return E.candidate_features(_evidence(spark, d).join(docs.select("doc_id", "cand"), "doc_id"), docs, "cand", EARLY)


@query("candidate_features", f"{BASE}, {EVIDENCE}, {FEATURE} SELECT cand, claims, stage_fact_count, round(early_ratio, 6) AS early_ratio, round(future_ratio, 6) AS future_ratio, has_advantage, has_case, high_docs, academic, low_only, domains, CAST(span AS INTEGER) AS span FROM f")
def candidate_features(spark, d):
    return _features(spark, d).select(
        "cand", "claims", "stage_fact_count", F.round("early_stage_marker_ratio", 6).alias("early_ratio"), F.round("future_looking_ratio", 6).alias("future_ratio"), F.col("has_advantage_evidence").alias("has_advantage"), F.col("has_case_example_evidence").alias("has_case"),
        F.col("high_trust_source_count").alias("high_docs"), F.col("has_academic_or_patent_evidence").alias("academic"), F.col("lowest_trust_only").alias("low_only"), F.col("distinct_domain_count").alias("domains"), F.col("days_since_earliest_mention").alias("span"),
    )


@query("confirmations", f"{BASE}, {CONFIRM} SELECT * FROM c")
def confirmations(spark, d):
    return D.confirmations(documents(spark, d), "cand")


@query("trust_levels", f"{BASE} SELECT doc_id, trust_level FROM d")
def trust_levels(spark, d):
    return documents(spark, d).select("doc_id", "trust_level")


SCORE = f"""r AS (SELECT *, date '{AS_OF}' - latest AS age FROM f LEFT JOIN c USING (cand)),
 q AS (SELECT cand, age, confirmations, latest, greatest(0.0, least(1.0, CAST(0.5 AS DOUBLE) + CASE WHEN confirmations = 0 THEN -0.35 WHEN confirmations = 1 THEN 0.10 ELSE 0.30 END + CASE WHEN low_only THEN -0.25 ELSE 0 END + CASE WHEN academic THEN 0.15 ELSE 0 END
 + CASE WHEN high_docs > 0 THEN 0.10 ELSE 0 END + CASE WHEN early_ratio >= 0.5 THEN 0.10 ELSE 0 END + CASE WHEN future_ratio >= 0.999 THEN -0.05 WHEN future_ratio IS NOT NULL THEN 0.05 ELSE 0 END
 + CASE WHEN has_advantage OR has_case THEN 0.05 ELSE 0 END + CASE WHEN age <= 180 THEN 0.15 WHEN age > 540 THEN -0.20 ELSE 0 END)) AS score FROM r),
 v AS (SELECT cand, round(score, 6) AS score, CASE WHEN coalesce(confirmations, 0) = 0 AND latest IS NULL THEN 'insufficient_evidence' WHEN round(score, 6) >= 0.65 THEN 'likely_emerging_signal' WHEN round(score, 6) >= 0.40 THEN 'worth_monitoring' ELSE 'likely_noise' END AS verdict,
 CASE WHEN age <= 180 THEN true WHEN age > 540 THEN false END AS is_actual FROM q)"""


def _scored(spark, d):
    f = _features(spark, d).join(D.confirmations(documents(spark, d), "cand"), "cand", "left")
    return E.relevance(f, AS_OF)


@query("relevance_score", f"{BASE}, {EVIDENCE}, {FEATURE}, {CONFIRM}, {SCORE} SELECT * FROM v")
def relevance_score(spark, d):
    return _scored(spark, d).select("cand", F.round("score", 6).alias("score"), "verdict", "is_actual")


@query("verdict_counts", f"{BASE}, {EVIDENCE}, {FEATURE}, {CONFIRM}, {SCORE} SELECT k.verdict, count(v.cand) AS n FROM (SELECT unnest(['likely_emerging_signal', 'worth_monitoring', 'likely_noise', 'insufficient_evidence']) AS verdict) k LEFT JOIN v USING (verdict) GROUP BY k.verdict")
def verdict_counts(spark, d):
    kinds = spark.createDataFrame([(x,) for x in ("likely_emerging_signal", "worth_monitoring", "likely_noise", "insufficient_evidence")], "verdict string")
    return kinds.join(_scored(spark, d), "verdict", "left").groupBy("verdict").agg(F.count("cand").alias("n"))


@query("top15", f"{BASE}, {EVIDENCE}, {FEATURE}, {CONFIRM}, {SCORE} SELECT cand, score, verdict FROM v ORDER BY score DESC, cand LIMIT 15")
def top15(spark, d):
    return _scored(spark, d).select("cand", F.round("score", 6).alias("score"), "verdict").orderBy(F.desc("score"), "cand").limit(15)


@query("latest_publication", f"{BASE} SELECT cand, max(published) AS latest, CAST(max(published) - min(published) AS INTEGER) AS span_days FROM d GROUP BY cand")
def latest_publication(spark, d):
    return documents(spark, d).groupBy("cand").agg(F.max("published").alias("latest"), F.datediff(F.max("published"), F.min("published")).alias("span_days"))


@query("primary_document", f"{BASE} SELECT cand, doc_id FROM (SELECT cand, doc_id, row_number() OVER (PARTITION BY cand ORDER BY length(text) DESC, doc_id) AS r FROM d) WHERE r = 1")
def primary_document(spark, d):
    return D.primary_document(documents(spark, d), "cand", "doc_id", "text")


SHINGLE = rf"""tk AS (SELECT KEY_ AS doc, regexp_extract_all({FOLD.format('text')}, '{TOK}') AS t FROM TABLE_),
 sh AS (SELECT DISTINCT doc, unnest(list_transform(range(1, len(t) - 2), lambda i: t[i] || chr(1) || t[i+1] || chr(1) || t[i+2] || chr(1) || t[i+3])) AS g FROM tk WHERE len(t) >= 8), sn AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM sh)"""
PAIRS = f"{SHINGLE.replace('KEY_', 'doc_id').replace('TABLE_', 'documents')}, pr AS (SELECT a.doc AS a, b.doc AS b, count(*) / min(least(a.n, b.n)) AS s FROM sn a JOIN sn b USING (g) WHERE a.doc < b.doc GROUP BY a.doc, b.doc HAVING count(*) / min(least(a.n, b.n)) >= 0.8)"


def _overlaps(spark, d):
    rows = O.shingles(documents(spark, d), "doc_id", "text")
    return O.containment_pairs(rows, rows, same=True)


@query("shingle_overlap", f"WITH {PAIRS} SELECT a, b, round(s, 6) AS similarity FROM pr")
def shingle_overlap(spark, d):
    return _overlaps(spark, d).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("overlap_components", f"WITH RECURSIVE {PAIRS}, ed AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), re AS (SELECT DISTINCT a AS node, a AS top FROM ed UNION SELECT ed.b, re.top FROM re JOIN ed ON ed.a = re.node) SELECT node AS doc_id, min(top) AS component FROM re GROUP BY node")
def overlap_components(spark, d):
    return O.components(_overlaps(spark, d)).select(F.col("node").alias("doc_id"), "component")


_items = re.sub(r"\b(tk|sh|sn)\b", r"\1_items", SHINGLE.replace("KEY_", "item_id").replace("TABLE_", "benchmark"))


@query("benchmark_overlap", f"WITH {SHINGLE.replace('KEY_', 'doc_id').replace('TABLE_', 'documents')}, {_items} SELECT a.doc AS doc_id, b.doc AS item_id, round(count(*) / min(least(a.n, b.n)), 6) AS similarity FROM sn a JOIN sn_items b USING (g) GROUP BY a.doc, b.doc HAVING count(*) / min(least(a.n, b.n)) >= 0.8")
def benchmark_overlap(spark, d):
    items = O.shingles(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")
    pairs = O.containment_pairs(O.shingles(documents(spark, d), "doc_id", "text"), items)
    return pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("similarity", 6).alias("similarity"))


_ref = lambda i: f"'https://doi.org/10.1234/w' || ((doc_id * 7 + {i}) % 600)"


@query("work_relations", f"WITH w AS (SELECT DISTINCT doc_id, unnest([{_ref(0)}, {_ref(3)}]) AS u FROM documents), i AS (SELECT doc_id, 'doi:' || regexp_extract(u, '10[.].*$') AS work FROM w) SELECT a.doc_id AS a, b.doc_id AS b, string_agg(DISTINCT work, ',' ORDER BY work) AS works FROM i a JOIN i b USING (work) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id")
def work_relations(spark, d):
    link = lambda i: F.concat(F.lit("https://doi.org/10.1234/w"), ((F.col("doc_id") * 7 + i) % 600).cast("string"))
    ids = documents(spark, d).select(F.col("doc_id").alias("source_id"), F.explode(F.array(link(0), link(3))).alias("u"))
    return O.shared_works(ids.select("source_id", U.work_id(F.col("u")).alias("work")))


CLAIMS = f"""cl AS (SELECT doc_id, cand, published, pos, quote, unnest(['{"', '".join(FEATURES)}']) AS feature, unnest([{', '.join(f"contains(quote, '{m}')" for m in FEATURES.values())}]) AS yes FROM
 (SELECT doc_id, cand, published, unnest({SENT}) AS quote, generate_subscripts({SENT}, 1) - 1 AS pos FROM d WHERE published <= DATE '{AS_OF}')), cm AS (SELECT * FROM cl WHERE yes)"""
FLAGS = "fl AS (SELECT cand, " + ", ".join(f"bool_or(feature = '{f}') AS {f}" for f in FEATURES) + " FROM cm GROUP BY cand)"
DECIDED = """de AS (SELECT *, CASE WHEN (mass_adoption OR industry_standard) AND early_stage THEN 'conflicting_stage_claims' WHEN (mass_adoption OR industry_standard) AND relevance THEN 'explicit_maturity_claim'
 WHEN early_stage AND limited_adoption AND relevance THEN 'explicit_early_and_limited_scope_claims' ELSE 'insufficient_explicit_evidence' END AS reason,
 30 * CAST(early_stage AS INTEGER) + 40 * CAST(limited_adoption AS INTEGER) + 30 * CAST(relevance AS INTEGER) AS score FROM fl),
 dd AS (SELECT *, CASE reason WHEN 'explicit_maturity_claim' THEN 'likely_mature' WHEN 'explicit_early_and_limited_scope_claims' THEN 'likely_weak' ELSE 'needs_review' END AS decision FROM de)"""


def _claims(spark, d):
    rows = documents(spark, d).where(F.col("published") <= F.lit(AS_OF).cast("date"))
    rows = rows.select("doc_id", "cand", "published", F.posexplode(T.sentences(F.col("text"))).alias("pos", "quote"))
    found = F.array_compact(F.array(*[F.when(F.col("quote").contains(m), F.lit(f)) for f, m in FEATURES.items()]))
    return rows.select("*", F.explode(found).alias("feature"))


def _flags(spark, d):
    return E.feature_flags(_claims(spark, d), "cand", list(FEATURES))


@query("auto_flags", f"{BASE}, {CLAIMS}, {FLAGS} SELECT * FROM fl")
def auto_flags(spark, d):
    return _flags(spark, d)


@query("auto_decision", f"{BASE}, {CLAIMS}, {FLAGS}, {DECIDED} SELECT cand, decision, reason, score FROM dd")
def auto_decision(spark, d):
    return E.automatic_decision(_flags(spark, d)).select("cand", "decision", "reason", "score")


@query("preliminary_fill", f"{BASE}, {CLAIMS}, {FLAGS}, {DECIDED} SELECT cand AS candidate_id, score FROM dd WHERE decision = 'needs_review' AND reason = 'insufficient_explicit_evidence' AND early_stage AND relevance AND NOT mass_adoption AND NOT industry_standard AND cand NOT LIKE 'src1%' ORDER BY score DESC, cand LIMIT 6")
def preliminary_fill(spark, d):
    assessed = E.automatic_decision(_flags(spark, d)).withColumnRenamed("cand", "candidate_id")
    return E.preliminary(assessed, assessed.where(F.col("candidate_id").startswith("src1")), 6).select("candidate_id", "score")


_review = {"early_stage": 2, "limited_adoption": 3, "emerging_activity": 5, "relevance": 1, "trusted_source": 1, "independent_sources": 7, "irrelevant": 17, "mass_adoption": 19, "established_market": 23, "industry_standard": 29, "hype_only": 31}


@query("detector_score", "WITH x AS (SELECT o_orderkey, " + ", ".join(f"o_orderkey % {m} = 0 AS {f}" for f, m in _review.items()) + " FROM orders), y AS (SELECT *, " + " + ".join(f"{w} * CAST({f} AS INTEGER)" for f, w in V.DETECTOR_WEIGHTS.items()) + " AS score FROM x) SELECT decision, score, count(*) AS n FROM (SELECT score, CASE WHEN irrelevant OR mass_adoption OR established_market OR industry_standard OR hype_only THEN 'reject' WHEN early_stage AND limited_adoption AND relevance AND trusted_source AND score >= 70 THEN 'weak' ELSE 'needs_review' END AS decision FROM y) GROUP BY ALL")
def detector_score(spark, d):
    flags = spark.read.parquet(f"{d}/orders.parquet").select(*[(F.col("o_orderkey") % m == 0).alias(f) for f, m in _review.items()])
    return E.reviewed_decision(flags).groupBy("decision", "score").agg(F.count(F.lit(1)).alias("n"))


@query("signal_span", f"{BASE}, {CLAIMS} SELECT cand, feature, count(DISTINCT doc_id) AS sources, min(published) AS first_date, CAST(max(published) - min(published) AS INTEGER) AS span_days FROM cm GROUP BY cand, feature")
def signal_span(spark, d):
    return _claims(spark, d).groupBy("cand", "feature").agg(F.countDistinct("doc_id").alias("sources"), F.min("published").alias("first_date"), F.datediff(F.max("published"), F.min("published")).alias("span_days"))


_terms_sql = rf"list_distinct(list_filter(regexp_extract_all({FOLD.format('quote')}, '{TOK}'), lambda t: length(t) > 3))"


@query("stage_conflicts", f"{BASE}, {CLAIMS}, tm AS (SELECT cand, feature, doc_id * 10000 + pos AS id, {_terms_sql} AS t FROM cm) SELECT a.cand, a.id AS early_id, b.id AS mature_id, CAST(len(list_intersect(a.t, b.t)) AS INTEGER) AS common, CASE WHEN len(list_intersect(a.t, b.t)) >= 2 THEN 'potential_conflict' ELSE 'scope_unresolved' END AS status FROM tm a JOIN tm b ON a.cand = b.cand WHERE a.feature = 'limited_adoption' AND b.feature = 'mass_adoption'")
def stage_conflicts(spark, d):
    rows = _claims(spark, d).select("cand", "feature", (F.col("doc_id") * 10000 + F.col("pos")).alias("claim_id"), F.array_distinct(F.filter(T.tokens(F.col("quote")), lambda t: F.length(t) > 3)).alias("terms"))
    return O.stage_conflicts(rows.where("feature = 'limited_adoption'"), rows.where("feature = 'mass_adoption'"), "cand")


@query("rank_one_per_group", f"{BASE} SELECT doc_id, cand FROM (SELECT doc_id, cand, length(text) AS n, row_number() OVER (PARTITION BY cand ORDER BY length(text) DESC, doc_id) AS r FROM d) WHERE r = 1 ORDER BY n DESC, doc_id LIMIT 15")
def rank_one_per_group(spark, d):
    rows = documents(spark, d).select("doc_id", "cand", F.length("text").alias("n"))
    return D.one_per_group(rows, "cand", "n", "doc_id", 15).select("doc_id", "cand")


@query("label_rotation", "SELECT n_name AS label FROM nation LEFT JOIN (SELECT n_name, 'cycle' || (n_nationkey % 4) AS last, n_nationkey % 3 AS times FROM nation WHERE n_nationkey % 5 <> 0) r USING (n_name) ORDER BY last NULLS FIRST, coalesce(times, 0), n_name LIMIT 12")
def label_rotation(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    used = nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("label"), F.concat(F.lit("cycle"), (F.col("n_nationkey") % 4).cast("string")).alias("last_queried_cycle"), (F.col("n_nationkey") % 3).alias("times_queried"))
    return D.least_recently_queried(nation.select(F.col("n_name").alias("label")), used, 12)


@query("adaptive_seeds", "SELECT s_suppkey AS candidate_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 2000 = 0) ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def adaptive_seeds(spark, d):
    pool = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("candidate_id"), F.col("s_acctbal").alias("relevance_score"))
    used = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 2000 = 0").select(F.col("l_suppkey").alias("candidate_id"))
    return D.adaptive_seeds(pool, used, 10).select("candidate_id")


@query("corpus_stats", f"{BASE} SELECT coalesce(CASE WHEN doc_id % 17 = 0 THEN NULL ELSE trust_level END, 'not_evaluated') AS verdict, count(*) AS n, count(CASE WHEN status = 'ok' THEN 1 END) AS n_ok FROM d GROUP BY 1")
def corpus_stats(spark, d):
    verdict = F.coalesce(F.when(F.col("doc_id") % 17 != 0, F.col("trust_level")), F.lit("not_evaluated"))
    return documents(spark, d).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"))


_old = "SELECT doc_id, sha256(text) AS payload FROM documents WHERE doc_id % 3 <> 0"
_new = "SELECT doc_id, sha256(text || 'x') AS fresh FROM documents WHERE doc_id % 2 = 0"


def _cycles(spark, d):
    rows = documents(spark, d)
    state = rows.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("payload"), F.lit("c1").alias("first_seen"), F.lit("c1").alias("last_seen"))
    return D.merge_documents(state, rows.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.concat("text", F.lit("x")), 256).alias("payload")), "doc_id", "payload", "c2")


@query("merge_documents", f"SELECT doc_id, coalesce(fresh, payload) AS payload, CASE WHEN payload IS NULL THEN 'c2' ELSE 'c1' END AS first_seen, CASE WHEN fresh IS NULL THEN 'c1' ELSE 'c2' END AS last_seen FROM ({_old}) FULL JOIN ({_new}) USING (doc_id)")
def merge_documents(spark, d):
    return _cycles(spark, d)[0]


@query("document_versions", f"SELECT doc_id, payload, 'c2' AS archived_in FROM ({_old}) JOIN ({_new}) USING (doc_id)")
def document_versions(spark, d):
    return _cycles(spark, d)[1]


@query("times_seen", "SELECT p_partkey AS candidate_id, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS score, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS times_seen, CASE WHEN p_partkey % 3 = 0 THEN 'c2' ELSE 'c1' END AS first_seen, CASE WHEN p_partkey % 2 = 0 THEN 'c2' ELSE 'c1' END AS last_seen FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0")
def times_seen(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("score"))
    state = part.where("candidate_id % 3 <> 0").select("*", F.lit(1).alias("times_seen"), F.lit("c1").alias("first_seen"), F.lit("c1").alias("last_seen"))
    batch = part.where("candidate_id % 2 = 0").withColumn("score", F.col("score") + 1)
    return D.merge_candidates(state, batch, "candidate_id", "c2", ["score"])


@query("quality_profile", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT text) AS duplicate_rows, count(DISTINCT source) AS n_sources, count(CASE WHEN length(text) < 100 THEN 1 END) AS short_texts FROM documents")
def quality_profile(spark, d):
    return documents(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("duplicate_rows"), F.countDistinct("source").alias("n_sources"), F.count_if(F.length("text") < 100).alias("short_texts"))


_stage = ["Концепция", "Исследование → прототип", "Пилот и PoC", "массовое внедрение", "ранние поставки", "epoch"]


@query("stage_flags", "SELECT doc_id, k IN (0) AS stage_concept, k IN (1) AS stage_research, k IN (1, 2) AS stage_prototype, k IN (2) AS stage_pilot, k IN (4) AS stage_early_adoption, k IN (3) AS stage_mass_adoption, k IN (1, 2) AS stage_multiple, k IN (5) AS stage_unknown, k IN (1) AS stage_has_transition FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)")
def stage_flags(spark, d):
    text = F.array(*[F.lit(x) for x in _stage])[(F.col("doc_id") % 6).cast("int")]
    return documents(spark, d).select("doc_id", *[c.alias(k) for k, c in T.stage_flags(text).items()])


_trend = [*V.TRENDS, "падает"]


@query("trend_category", "SELECT doc_id, list_extract([" + ", ".join(f"'{x}'" for x in [*V.TRENDS.values(), "unknown"]) + "], CAST(doc_id % 6 AS INTEGER) + 1) AS trend FROM documents")
def trend_category(spark, d):
    text = F.concat(F.array(*[F.lit(x) for x in _trend])[(F.col("doc_id") % 6).cast("int")], F.lit(" : по данным"))
    return documents(spark, d).select("doc_id", T.trend_category(text).alias("trend"))


@query("source_features", f"{BASE} SELECT cand, round(avg(CASE WHEN {_like('text', ['thst'])} THEN 1.0 ELSE 0.0 END), 6) AS marker_share, round(avg(CASE WHEN DATE '{AS_OF}' - published <= 180 THEN 1.0 ELSE 0.0 END), 6) AS recent_share, round(avg(ln(1 + length(text))), 6) AS mean_log_length, round(ln(1 + count(*)), 6) AS log_count FROM d GROUP BY cand")
def source_features(spark, d):
    return documents(spark, d).groupBy("cand").agg(
        F.round(F.avg(T.contains_any(F.col("text"), ["thst"]).cast("double")), 6).alias("marker_share"), F.round(F.avg((F.datediff(F.lit(AS_OF).cast("date"), "published") <= 180).cast("double")), 6).alias("recent_share"),
        F.round(F.avg(F.log1p(F.length("text"))), 6).alias("mean_log_length"), F.round(F.log1p(F.count(F.lit(1))), 6).alias("log_count"),
    )


@query("linear_priority", "SELECT s_suppkey, round(greatest(3.0, least(7.0, 4.5 + 0.0003 * s_acctbal + 0.05 * s_nationkey)), 6) AS priority, round(1 / (1 + exp(-(s_acctbal / 1000 - 5))), 6) AS gate FROM supplier")
def linear_priority(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    score = F.lit(4.5) + 0.0003 * F.col("s_acctbal") + 0.05 * F.col("s_nationkey")
    return rows.select("s_suppkey", F.round(F.greatest(F.lit(3.0), F.least(F.lit(7.0), score)), 6).alias("priority"), F.round(E.logistic(F.col("s_acctbal") / 1000 - 5), 6).alias("gate"))


@query("confusion", "WITH x AS (SELECT quality AS t, CASE WHEN doc_id % 5 = 0 THEN 'review' WHEN length(text) > 900 THEN 'weak' ELSE 'mature' END AS p FROM labels JOIN documents USING (doc_id)), y AS (SELECT count(CASE WHEN p = 'weak' AND t = 1 THEN 1 END) AS tp, count(CASE WHEN p = 'weak' AND t = 0 THEN 1 END) AS fp, count(CASE WHEN p = 'mature' AND t = 1 THEN 1 END) AS fn, count(CASE WHEN p = 'mature' AND t = 0 THEN 1 END) AS tn, count(CASE WHEN p = 'review' THEN 1 END) AS abstained, count(*) AS n FROM x) SELECT tp, fp, fn, tn, abstained, n, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((n - abstained) / n, 6) AS coverage FROM y")
def confusion(spark, d):
    rows = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    guess = F.when(F.col("doc_id") % 5 == 0, "review").when(F.length("text") > 900, "weak").otherwise("mature")
    out = E.confusion(rows.withColumn("p", guess), "quality", "p", "weak", "mature")
    return out.select("tp", "fp", "fn", "tn", "abstained", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "coverage")])


@query("mae_rmse", "SELECT round(avg(abs(g - p_size)), 6) AS mae, round(sqrt(avg((g - p_size) * (g - p_size))), 6) AS rmse, round(avg(CASE WHEN floor(g + 0.5) = p_size THEN 1.0 ELSE 0.0 END), 6) AS exact FROM (SELECT p_size, p_size + (p_partkey % 7 - 3) / 4.0 AS g FROM part)")
def mae_rmse(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_size", (F.col("p_size") + (F.col("p_partkey") % 7 - 3) / 4.0).alias("g"))
    out = E.regression_errors(rows, "p_size", "g")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _sets(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_totalprice > 200000").select("o_custkey")


_sa, _sb = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey FROM orders WHERE o_totalprice > 200000"


@query("set_union", f"{_sa} UNION {_sb}")
def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("set_intersect", f"{_sa} INTERSECT {_sb}")
def set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


@query("set_except", f"{_sa} EXCEPT {_sb}")
def set_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


_event = f"{BASE}, {PAIRS}, bp AS (SELECT p.a, p.b FROM pr p JOIN d x ON x.doc_id = p.a JOIN d y ON y.doc_id = p.b WHERE abs(x.published - y.published) <= 10)"


def _event_pairs(spark, d):
    return D.within_days(_overlaps(spark, d).select("a", "b"), documents(spark, d), "doc_id", "published", 10)


@query("event_band_join", f"{_event} SELECT a, b FROM bp")
def event_band_join(spark, d):
    return _event_pairs(spark, d)


@query("event_clusters", f"{_event.replace('WITH', 'WITH RECURSIVE', 1)}, ed AS (SELECT a, b FROM bp UNION SELECT b, a FROM bp), re AS (SELECT DISTINCT a AS node, a AS top FROM ed UNION SELECT ed.b, re.top FROM re JOIN ed ON ed.a = re.node) SELECT node AS doc_id, min(top) AS cluster FROM re GROUP BY node")
def event_clusters(spark, d):
    return O.components(_event_pairs(spark, d)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
