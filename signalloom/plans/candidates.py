"""Queries of candidates, rated lists and saved answers, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.functions import terms
from signalloom.functions import vocabulary as V
from signalloom.operators import candidates as C
from signalloom.operators import language as N
from signalloom.operators import presentation as P
from signalloom.operators import textmodel as M
from signalloom.operators.tables import cut
from signalloom.sources import answers as W
from signalloom.plans.gates import _pick, _pick_sql
from signalloom.plans.registry import BASE, CONFIRM, EVIDENCE, FEATURE, KEYWORDS, ORACLES, QUERIES, SCORE, SENT, TOK, _evidence, _in, _kw, _scored, documents, query  # noqa: F401

TOPIC = "new materials"
_ids = "string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))"
_sha = lambda prefix, parts: f"'{prefix}' || substr(sha256({parts}), 1, 24)"


# candidates: (source, lang) groups for the whole, groups of three documents for evidence
@query("candidate_clusters")
def candidate_clusters(spark, d):
    """Leader clusters by opening words and companies; no SQL, tests hold them against a plain loop."""
    c = F.col
    rows = documents(spark, d).where("duplicate_of IS NULL")
    work = F.when(c("doc_id") % 50 < 2, F.array(F.concat(F.lit("doi:10.1000/"), F.expr("doc_id div 100"))))
    return C.cluster_candidates(rows.select("doc_id", C.cluster_keys(c("text"), c("title"), c("domain")).alias("key"), work.alias("ids")), "doc_id", "key", "ids")


@query("candidate_companies")
def candidate_companies(spark, d):
    """Companies named in whole texts, by candidate; no SQL (its word classes differ), tests use re."""
    rows = documents(spark, d).select("cand", terms.companies(F.col("text"), F.col("title")).alias("found"))
    return C.distinct_companies(rows, "cand", "found").select("cand", F.array_join("companies", "|").alias("companies"), "distinct_company_count")


@query(
    "build_candidates",
    f"""{BASE}, {CONFIRM}, w AS (SELECT cand, doc_id, title, text, row_number() OVER (PARTITION BY cand ORDER BY length(text) DESC, doc_id) AS r FROM d),
 k AS (SELECT cand, doc_id, title, text, regexp_extract_all(lower(title || ' ' || text), '{TOK}') AS w FROM w WHERE r = 1), s AS (SELECT *, {_kw['alpha']} AS a, {_kw['beta']} AS b, {_kw['gamma']} AS g FROM k),
 n AS (SELECT cand, count(*) AS documents, coalesce(bool_and(source_type IN {_in(V.LOW_TYPES)}) FILTER (WHERE duplicate_of IS NULL), TRUE) AS lowest_trust_only, {_sha('cand_', f"'{TOPIC}' || chr(10) || " + _ids)} AS candidate_id FROM d GROUP BY cand)
 SELECT cand, candidate_id, documents, lowest_trust_only, s.doc_id AS primary_doc, trim(title) AS technology_name, trim(substr(text, 1, 300)) AS short_description,
 CASE WHEN greatest(a, b, g) = 0 THEN NULL WHEN a >= b AND a >= g THEN 'alpha' WHEN b >= g THEN 'beta' ELSE 'gamma' END AS category, coalesce(confirmations, 0) AS confirmations FROM s JOIN n USING (cand) LEFT JOIN c USING (cand)""",
)
def build_candidates(spark, d):
    return C.build_candidates(documents(spark, d), "cand", "doc_id", KEYWORDS, TOPIC).drop("companies", "distinct_company_count")


_three = f"""z AS (SELECT doc_id // 3 AS grp, * FROM d), ze AS (SELECT e.doc_id // 3 AS grp, doc_id, pos, quote, claim_type, label FROM e),
 lo AS (SELECT grp, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length(text) DESC, doc_id) AS r FROM z ANTI JOIN ze USING (grp)) WHERE r = 1),
 al AS (SELECT * FROM ze UNION ALL SELECT grp, doc_id, 0, {SENT}[1], 'general', NULL FROM lo WHERE len({SENT}) > 0),
 u AS (SELECT grp, doc_id, min(pos) AS pos, quote, claim_type, arg_min(label, pos) AS label FROM al GROUP BY grp, doc_id, quote, claim_type)"""


def _group_evidence(spark, d):
    docs = documents(spark, d).withColumn("grp", F.expr("doc_id div 3"))
    found = _evidence(spark, d).withColumn("grp", F.expr("doc_id div 3"))
    return C.stable_evidence(C.with_fallback(found, docs, "grp", "doc_id", "text"), "grp", "doc_id")


@query("stable_evidence", f"{BASE}, {EVIDENCE}, {_three} SELECT grp, doc_id, CAST(pos AS INTEGER) AS pos, claim_type, label, {_sha('ev_', 'CAST(doc_id AS VARCHAR) || chr(10) || quote || chr(10) || claim_type')} AS evidence_id FROM u")
def stable_evidence(spark, d):
    return _group_evidence(spark, d).select("grp", "doc_id", "pos", "claim_type", "label", "evidence_id")


@query("candidate_facts", f"{BASE}, {EVIDENCE}, {_three} SELECT * FROM (SELECT grp, claim_type, doc_id, quote, CAST(row_number() OVER (PARTITION BY grp, claim_type ORDER BY doc_id, pos) AS INTEGER) AS place FROM u WHERE claim_type <> 'general') WHERE place <= 8")
def candidate_facts(spark, d):
    return C.candidate_facts(_group_evidence(spark, d), "grp", "doc_id").select("grp", "claim_type", "doc_id", "quote", "place")


# rated lists
@query("ranked_candidates", f"{BASE}, {EVIDENCE}, {FEATURE}, {CONFIRM}, {SCORE}, x AS (SELECT cand, count(*) AS n_documents FROM d GROUP BY cand) SELECT cand, n_documents, score, verdict FROM x JOIN v USING (cand) WHERE verdict <> 'likely_noise'")
def ranked_candidates(spark, d):
    rated = _scored(spark, d).select("cand", F.round("score", 6).alias("score"), "verdict")
    return C.ranked_candidates(C.assessed(documents(spark, d).groupBy("cand").agg(F.count(F.lit(1)).alias("n_documents")), rated, "cand"), "cand")


_parts = "SELECT p_partkey AS candidate_id, p_size AS score, p_partkey % 17 AS priority FROM part WHERE p_partkey % 3 = 0"


@query("reranked", f"{_parts} ORDER BY score DESC, priority DESC, candidate_id LIMIT 15")
def reranked(spark, d):
    n = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(n.alias("candidate_id"), F.col("p_size").alias("score"), (n % 17).alias("priority"), F.when(n % 3 == 0, "likely_weak").otherwise("needs_review").alias("decision"))
    return C.reranked(rows).drop("decision")


@query("latest_candidates", f"{BASE} SELECT doc_id, published FROM d ORDER BY published DESC, doc_id DESC LIMIT 50")
def latest_candidates(spark, d):
    return C.latest(documents(spark, d).select("doc_id", "published"), "published", "doc_id", 50)


_kinds = [*V.TRUSTED_TYPES, "unknown"]


@query("trusted_sources", f"{BASE} SELECT doc_id FROM d WHERE {_pick_sql(_kinds)} <> 'unknown' AND trust_level IN ('high', 'medium') AND doc_id % 5 > 1")
def trusted_sources(spark, d):
    reason = _pick([None, "  ", "stated", "stated", "stated"])
    return documents(spark, d).where(C.trusted_source(_pick(_kinds), F.col("trust_level"), reason)).select("doc_id")


# saved answers
_plain = "regexp_replace(regexp_replace(text, '<!--.*?-->', ' ', 'gs'), '<[/!?A-Za-z][^>]*>', ' ', 'g')"
for _name, _sign in W.ENTITIES.items():
    _plain = f"replace({_plain}, '{_name}', {'chr(39)' if _sign == chr(39) else repr(_sign)})"
_addresses = ["https://arxiv.org/abs/2401.0000", "https://www.reddit.com/r/", "https://blog.example.org/p"]


@query(
    "api_documents",
    f"SELECT {_pick_sql(_addresses)} || (doc_id % 10) AS url, {_pick_sql(['academic', 'social_media', 'industry_media'])} AS source_type, {_pick_sql(['0.9', '0.9', '0.7'])}::DOUBLE AS confidence, sha256(CASE WHEN t <> '' THEN t ELSE CAST(doc_id AS VARCHAR) END) AS content_hash, t AS text, doc_id AS title FROM (SELECT doc_id, CASE WHEN contains(text, '<') THEN trim(regexp_replace({_plain}, '\\s+', ' ', 'g')) ELSE coalesce(text, '') END AS t FROM documents)",
)
def api_documents(spark, d):
    rows = documents(spark, d).select(
        F.concat(_pick(_addresses), F.col("doc_id") % 10).alias("url"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("snippet"), F.col("published").cast("timestamp").alias("published_at"),
        F.lit(False).alias("date_estimated"), F.lit("feed").alias("connector"), F.lit("abstract").alias("text_scope"),
    )
    out = W.api_documents(rows, "industry_media")
    return out.select("url", "source_type", "confidence", "content_hash", "text", F.col("title").cast("long").alias("title"))


@query(
    "citation_status",
    f"""WITH x AS (SELECT doc_id, {_pick_sql(['ok', 'ok', 'http_error', 'ok', 'blocked'])} AS f, {_pick_sql(['text/html', 'application/PDF', 'image/png', None], '(doc_id // 5)')} AS k, coalesce(text, '') || CASE WHEN doc_id % 21 = 0 THEN ' Access denied' ELSE '' END AS t, doc_id % 4 <> 0 AS dated, doc_id % 3 = 0 AS estimated, (35 + 10 * (doc_id % 7)) / 100.0 AS confidence FROM documents),
 s AS (SELECT *, CASE WHEN f <> 'ok' THEN f WHEN k IN ('application/PDF', 'image/png') THEN 'unsupported_content' WHEN doc_id % 21 = 0 THEN 'possible_challenge_page' WHEN length(trim(t)) >= 300 THEN 'retrieved_unverified' ELSE 'insufficient_text' END AS status FROM x)
 SELECT doc_id, status, CASE WHEN status IN ('http_error', 'blocked', 'unsupported_content') THEN '' ELSE concat_ws(',', CASE WHEN NOT dated THEN 'publication_date_missing' END, CASE WHEN estimated THEN 'publication_date_estimated' END, CASE WHEN confidence < 0.6 THEN 'source_type_requires_review' END, CASE WHEN status = 'possible_challenge_page' THEN 'content_may_be_antibot_page' END) END AS warnings FROM s""",
)
def citation_status(spark, d):
    c = F.col
    rows = documents(spark, d).withColumn("t", F.concat(F.coalesce("text", F.lit("")), F.when(c("doc_id") % 21 == 0, " Access denied").otherwise("")))
    rows = rows.withColumn("five", F.expr("doc_id div 5")).withColumn("status", W.citation_status(_pick(["ok", "ok", "http_error", "ok", "blocked"]), _pick(["text/html", "application/PDF", "image/png", None], "five"), c("t")))
    warnings = W.quality_warnings(c("status"), F.when(c("doc_id") % 4 != 0, c("published")), c("doc_id") % 3 == 0, c("confidence"))
    return rows.select("doc_id", "status", F.array_join(warnings, ",").alias("warnings"))


@query("uncached_links", "SELECT url FROM (SELECT DISTINCT url FROM pages) WHERE NOT url IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND page_id % 2 = 0)")
def uncached_links(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    cache = rows.where("page_id % 3 = 0").select(W.cache_key(F.col("url")).alias("key"), F.when(F.col("page_id") % 2 == 0, "retrieved_unverified").otherwise("error").alias("status"))
    return W.uncached(rows.select("url").distinct(), cache, retry_failed=True).select("url")


@query("link_status", "SELECT page_id, status FROM pages JOIN (SELECT DISTINCT url, 'stored' AS status FROM pages WHERE page_id % 3 = 0) USING (url)")
def link_status(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    cache = rows.where("page_id % 3 = 0").select(W.cache_key(F.col("url")).alias("key"), F.lit("stored").alias("status")).distinct()
    return W.link_status(rows.select("page_id", "url"), cache).select("page_id", "status")


_work = "'https://arxiv.org/abs/2401.' || (10000 + doc_id % 80000)"


@query(
    "follow_ups",
    f"""WITH x AS (SELECT {_work} AS url, 'https://arxiv.org/html/2401.' || (10000 + doc_id % 80000) AS own, 'https://doi.org/10.1000/a' || (doc_id // 2) AS doi FROM documents), t AS (SELECT own AS target, url, 'same_work_full_text' AS relation FROM x UNION ALL SELECT doi, url, 'cited_work' FROM x)
 SELECT target, relation FROM t WHERE target NOT IN (SELECT 'https://doi.org/10.1000/a' || doc_id FROM documents WHERE doc_id % 5 = 0) GROUP BY target, relation ORDER BY min(CASE WHEN url IN (SELECT {_work} FROM documents WHERE doc_id % 40 = 0) THEN 0 ELSE 1 END), target LIMIT 12""",
)
def follow_ups(spark, d):
    docs, c = documents(spark, d), F.col
    url = F.concat(F.lit("https://arxiv.org/abs/2401."), 10000 + c("doc_id") % 80000)
    doi = lambda n: F.concat(F.lit("https://doi.org/10.1000/a"), n)
    targets = W.follow_ups(docs.select(url.alias("url"), F.array(doi(F.expr("doc_id div 2")), url, F.lit("https://blog.example.org/x")).alias("links")), "url", "links")
    return W.next_targets(targets, docs.where("doc_id % 5 = 0").select(doi(c("doc_id")).alias("url")), docs.where("doc_id % 40 = 0").select(url.alias("url")))


@query("recover_dates", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN DATE '2025-01-01' WHEN doc_id % 3 <> 0 THEN DATE '2024-05-06' END AS published, CASE WHEN doc_id % 2 = 0 THEN FALSE WHEN doc_id % 3 <> 0 THEN TRUE ELSE FALSE END AS estimated FROM documents")
def recover_dates(spark, d):
    c = F.col
    docs = documents(spark, d)
    number = F.concat(F.lit("2401."), F.lpad((c("doc_id") % 100000).cast("string"), 5, "0"), F.lit("v"), F.expr("doc_id div 100000") + 1)
    rows = docs.select("doc_id", F.concat(F.lit("https://www.arxiv.org/html/"), number).alias("url"), F.concat(F.lit("On Things: "), "doc_id").alias("title"), F.when(c("doc_id") % 2 == 0, F.lit("2025-01-01").cast("date")).alias("published"), F.lit(False).alias("estimated"))
    pages = docs.select(number.alias("id"), F.concat(F.when(c("doc_id") % 3 == 0, "Other ").otherwise("ON things "), "doc_id").alias("citation_title"), F.lit("2024-05-06").cast("date").alias("page_date"), F.lit(True).alias("page_estimated"))
    return W.recover_dates(rows, pages).select("doc_id", "published", "estimated")


@query("rerank_results", "SELECT doc_id FROM (SELECT doc_id, CAST(doc_id % 3 = 1 AS INTEGER) + CAST(doc_id % 5 = 1 AS INTEGER) AS overlap FROM documents WHERE doc_id % 7 <> 0) ORDER BY overlap DESC, doc_id LIMIT 10")
def rerank_results(spark, d):
    n = F.col("doc_id")
    said = F.concat(F.when(n % 3 == 1, "Glass fibres").otherwise("Other"), F.when(n % 5 == 1, " for lasers").otherwise(""))
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("https://news.example.edu/"), F.when(n % 7 == 0, "about/").otherwise("2025/"), "doc_id").alias("url"), said.alias("said"))
    return W.rerank_results(rows, "glass laser", "url", "said", "doc_id", r"^/\d{4}/[^/]+$", 10).select("doc_id")


@query("russian_terms", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{en}') THEN '{ru}' END" for en, ru in V.FIELD_NAMES.items()) + "], lambda x: x IS NOT NULL), ',') AS names FROM documents")
def russian_terms(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(terms.russian_terms(F.col("text")), ",").alias("names"))


LANGUAGE_WORDS = {"en": ["the", "and", "that", "with", "this"], "de": ["der", "die", "und", "das", "ist"], "es": ["el", "los", "que", "una", "por"], "fr": ["le", "les", "des", "une", "est"]}
_hits = ", ".join(f"len(list_filter(w, lambda x: x IN {_in(ws)})) AS {k}" for k, ws in LANGUAGE_WORDS.items())


@query(
    "detect_language",
    f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'pt' WHEN length(trim(text)) < 20 THEN NULL WHEN greatest(en, de, es, fr) = 0 THEN NULL WHEN en >= greatest(de, es, fr) THEN 'en' WHEN de >= greatest(es, fr) THEN 'de' WHEN es >= fr THEN 'es' ELSE 'fr' END AS language, CASE WHEN doc_id % 9 = 0 THEN 1.0::DOUBLE END AS confidence FROM (SELECT doc_id, text, {_hits} FROM (SELECT doc_id, text, string_split_regex(lower(substr(trim(text), 1, 3000)), '[^\\p{{L}}]+') AS w FROM documents))",
)
def detect_language(spark, d):
    found = W.detect_language(F.col("text"), F.when(F.col("doc_id") % 9 == 0, "PT-br"), LANGUAGE_WORDS)
    return documents(spark, d).select("doc_id", found.alias("x")).select("doc_id", "x.language", "x.confidence")


# text weights and lists of a run
@query(
    "text_weights",
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{TOK}'), lambda x: length(x) >= 2) AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
 c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term ORDER BY sum(n) DESC, term LIMIT 5000),
 r AS (SELECT doc_id, (1 + ln(n)) * idf AS x FROM c JOIN v USING (term)) SELECT doc_id, count(*) AS n_terms, round(sum(x) / sqrt(sum(x * x)), 5) AS total, round(max(x) / sqrt(sum(x * x)), 5) AS largest FROM r GROUP BY doc_id""",
)
def text_weights(spark, d):
    rows = documents(spark, d)
    terms = cut(M.frequent_terms(rows, "text", rows.count()))
    found = M.weighted(cut(M.known_counts(rows, "doc_id", "text", terms)), terms, "doc_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("largest"))


@query(
    "run_lists",
    "WITH r AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) AS place FROM (SELECT p_partkey AS candidate_id FROM part WHERE p_partkey % 25 = 0 ORDER BY 1 LIMIT 6)), f AS (SELECT p_partkey AS candidate_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT candidate_id FROM r)), k AS (SELECT count(*) AS taken FROM r) SELECT candidate_id, CAST(place AS INTEGER) AS place, FALSE AS preliminary FROM r UNION ALL SELECT candidate_id, CAST(n + taken AS INTEGER), TRUE FROM f, k WHERE n + taken <= 15",
)
def run_lists(spark, d):
    n, yes = F.col("p_partkey"), F.lit(True)
    parts = spark.read.parquet(f"{d}/part.parquet")
    rated = parts.select(
        n.alias("candidate_id"), F.col("p_size").alias("score"), F.lit("needs_review").alias("decision"), F.when(n % 2 == 0, "insufficient_explicit_evidence").otherwise("explicit_maturity_claim").alias("reason"),
        yes.alias("early_stage"), yes.alias("relevance"), F.lit(False).alias("mass_adoption"), F.lit(False).alias("industry_standard"),
    )
    results = parts.where(n % 25 == 0).orderBy(n).limit(6).select(n.alias("candidate_id"), n.alias("place"))
    return P.run_lists(rated, results)


# language of texts, learned from four fifths of them
_gram = r"""g AS (SELECT doc_id, lang, h, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM (SELECT doc_id, lang, doc_id % 5 = 0 AS h, length(text) AS size, regexp_replace(lower(substr(text, 1, 3000)), '[^\p{L}]+', ' ', 'g') AS t FROM documents) WHERE length(t) >= 3),
 n AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT lang, gram, count(*) AS c FROM g WHERE NOT h AND lang IS NOT NULL GROUP BY ALL),
 l AS (SELECT lang, ln(0.5 / (sum(c) + 0.5 * ((SELECT count(DISTINCT gram) FROM c) + 1))) AS least FROM c GROUP BY lang),
 s AS (SELECT n.doc_id, l.lang, round(sum(n.n) * any_value(l.least) + coalesce(sum(n.n * ln((c.c + 0.5) / 0.5)), 0), 6) AS score FROM n CROSS JOIN l LEFT JOIN c ON c.lang = l.lang AND c.gram = n.gram GROUP BY n.doc_id, l.lang)"""


@query("language_model", f"WITH {_gram} SELECT d.doc_id, d.lang, d.doc_id % 5 = 0 AS held_out, CASE WHEN length(text) >= 20 THEN p.language END AS language FROM documents d LEFT JOIN (SELECT doc_id, arg_min(lang, (-score, lang)) AS language FROM s GROUP BY doc_id) p USING (doc_id)")
def language_model(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    found = N.detect(rows, "doc_id", "text", N.train(rows.where("NOT held_out"), "doc_id", "text", "lang"))
    return rows.select("doc_id", "lang", "held_out").join(found.select("doc_id", "language"), "doc_id")
