"""Queries of likeness, adapters, scope, evaluation and models, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import urls as U
from signalloom.functions import vocabulary as V
from signalloom.operators import adapter as A
from signalloom.operators import evaluation as X
from signalloom.operators import events as Y
from signalloom.operators import likeness as K
from signalloom.operators import models as M
from signalloom.operators import scope as S
from signalloom.plans.gates import _pick, _pick_sql
from signalloom.plans.registry import AS_OF, BASE, FOLD, ORACLES, QUERIES, TOK, documents, query  # noqa: F401

# scope: claims on three made subject words each, sources in four made groups, links between neighbours
_kinds = ["early_stage", "limited_adoption", "mass_adoption", "relevance", "early_stage", "limited_adoption", "industry_standard"]
_claims = f"""cl AS (SELECT doc_id, source || '-' || lang AS cand, {_pick_sql(_kinds)} AS feature, ['a' || (doc_id % 2), 'b' || (doc_id // 3 % 3), 'c' || (doc_id // 7 % 2)] AS t,
 'g' || (doc_id // 5 % 6) AS grp, doc_id % 5 <> 0 AS reviewed, DATE '2025-01-01' + CAST(doc_id % 600 AS INTEGER) AS published FROM documents)"""
_groups = """, an AS (SELECT cand, feature, doc_id, grp, published, t[1] AS x, t[2] AS y FROM cl WHERE reviewed UNION ALL SELECT cand, feature, doc_id, grp, published, t[1], t[3] FROM cl WHERE reviewed UNION ALL SELECT cand, feature, doc_id, grp, published, t[2], t[3] FROM cl WHERE reviewed),
 hd AS (SELECT *, min(doc_id) OVER (PARTITION BY cand, x, y, feature, grp) AS head FROM an),
 e0 AS (SELECT cand, x, y, feature, doc_id AS p, head AS q FROM hd UNION SELECT l.cand, l.x, l.y, l.feature, l.doc_id, r.doc_id FROM an l JOIN an r USING (cand, x, y, feature) WHERE l.doc_id % 4 = 0 AND r.doc_id = l.doc_id + 210),
 ed AS (SELECT * FROM e0 UNION SELECT cand, x, y, feature, q, p FROM e0),
 re AS (SELECT DISTINCT cand, x, y, feature, p AS node, p AS top FROM ed UNION SELECT ed.cand, ed.x, ed.y, ed.feature, ed.q, re.top FROM re JOIN ed ON ed.cand = re.cand AND ed.x = re.x AND ed.y = re.y AND ed.feature = re.feature AND ed.p = re.node),
 co AS (SELECT cand, x, y, feature, node AS doc_id, min(top) AS comp FROM re GROUP BY ALL),
 fi AS (SELECT cand, x, y, feature, comp, min(published) AS published FROM co JOIN an USING (cand, x, y, feature, doc_id) GROUP BY ALL),
 sg AS (SELECT cand, x, y, feature, count(*) AS groups, min(published) AS first_date, max(published) - min(published) AS span_days FROM fi GROUP BY ALL HAVING count(*) >= 2)"""


def _claim_rows(spark, d):
    c = F.col
    word = lambda p, div, m: F.concat(F.lit(p), F.expr(f"doc_id div {div}") % m)
    rows = documents(spark, d).select(
        F.col("cand"), c("doc_id").alias("source_id"), c("doc_id").alias("claim_id"), _pick(_kinds).alias("feature"), F.array(word("a", 1, 2), word("b", 3, 3), word("c", 7, 2)).alias("terms"),
        word("g", 5, 6).alias("grp"), (c("doc_id") % 5 != 0).alias("reviewed"), "published", "source_type",
    )
    links = rows.where("source_id % 4 = 0").select(F.col("source_id").alias("a"), (F.col("source_id") + 210).alias("b"), F.lit(None).cast("string").alias("feature"))
    return rows, links


@query("scope_groups", f"WITH RECURSIVE {_claims}{_groups} SELECT * FROM sg")
def scope_groups(spark, d):
    return S.scope_groups(*_claim_rows(spark, d), "cand")


@query("independent_counts", f"WITH RECURSIVE {_claims}, m AS (SELECT *, min(doc_id) OVER (PARTITION BY cand, feature, grp) AS head FROM cl WHERE reviewed), e0 AS (SELECT cand, feature, doc_id AS p, head AS q FROM m UNION SELECT l.cand, l.feature, l.doc_id, r.doc_id FROM m l JOIN m r USING (cand, feature) WHERE l.doc_id % 4 = 0 AND r.doc_id = l.doc_id + 210), ed AS (SELECT * FROM e0 UNION SELECT cand, feature, q, p FROM e0), re AS (SELECT DISTINCT cand, feature, p AS node, p AS top FROM ed UNION SELECT ed.cand, ed.feature, ed.q, re.top FROM re JOIN ed ON ed.cand = re.cand AND ed.feature = re.feature AND ed.p = re.node), co AS (SELECT cand, feature, node, min(top) AS top FROM re GROUP BY ALL) SELECT cand, feature, count(DISTINCT top) AS groups FROM co GROUP BY ALL")
def independent_counts(spark, d):
    return S.independent_counts(*_claim_rows(spark, d), "cand")


_any = lambda f: f"coalesce(bool_or(feature = '{f}'), FALSE) AS {f}"


@query(
    "evaluate_signals",
    f"""WITH RECURSIVE {_claims}{_groups}, pr AS (SELECT cand, x, y, bool_or(feature = 'early_stage' AND span_days >= 90) AND bool_or(feature = 'limited_adoption' AND span_days >= 90) AS lasting, bool_or(feature <> 'relevance') AS shared FROM sg GROUP BY ALL),
 sh AS (SELECT cand, bool_or(lasting) AS lasting, bool_or(shared) AS shared FROM pr GROUP BY cand),
 cf AS (SELECT cand, bool_or(len(list_intersect(a.t, b.t)) >= 2) AS clash FROM cl a JOIN cl b USING (cand) WHERE a.feature IN ('early_stage', 'limited_adoption') AND b.feature IN ('mass_adoption', 'industry_standard') GROUP BY cand),
 fl AS (SELECT cand, {', '.join(_any(f) for f in ('early_stage', 'limited_adoption', 'mass_adoption', 'industry_standard', 'relevance'))} FROM cl GROUP BY cand),
 st AS (SELECT cand, (mass_adoption OR industry_standard) AS mature, (early_stage OR limited_adoption) AS early, early_stage AND limited_adoption AND relevance AS whole, relevance, coalesce(clash, FALSE) AS clash, coalesce(lasting, FALSE) AS lasting, coalesce(shared, FALSE) AS shared FROM fl LEFT JOIN sh USING (cand) LEFT JOIN cf USING (cand)),
 s2 AS (SELECT *, CASE WHEN mature AND early THEN CASE WHEN clash THEN 'conflicting' ELSE 'uncertain' END WHEN mature AND relevance THEN 'mature' WHEN whole THEN CASE WHEN lasting THEN 'emerging_trend' ELSE 'early_signal' END ELSE 'uncertain' END AS stage FROM st),
 lo AS (SELECT source || '-' || lang AS cand, bool_and(list_extract([{','.join(f"'{t}'" for t in V.SOURCE_TYPES)}], CAST(doc_id % 15 AS INTEGER) + 1) IN ({','.join(f"'{t}'" for t in V.LOW_TYPES)})) AS promotional FROM documents GROUP BY ALL)
 SELECT cand, stage, CASE WHEN stage = 'conflicting' THEN 'conflicting' WHEN shared THEN 'corroborated' WHEN mature OR early THEN 'preliminary' WHEN promotional THEN 'promotional_only' ELSE 'insufficient' END AS support FROM s2 JOIN lo USING (cand)""",
)
def evaluate_signals(spark, d):
    rows, links = _claim_rows(spark, d)
    return S.evaluate_signals(rows, rows.select("cand", "source_type"), links, "cand").select("cand", "stage", "support")


_quotes = f"SELECT doc_id AS claim_id, source || '-' || lang AS cand, doc_id // 2 * 2 AS source_id, 'early_stage' AS feature, CASE WHEN doc_id % 7 = 0 THEN 'not there' ELSE ' ' END AS quote FROM documents"


@query("valid_claims", f"SELECT q.cand, min(q.claim_id) AS claim_id, q.source_id, q.quote FROM ({_quotes}) q JOIN documents s ON s.doc_id = q.source_id WHERE contains(s.text, q.quote) AND s.doc_id % 3 <> 0 AND s.doc_id % 4 <> 0 GROUP BY q.cand, q.source_id, q.feature, q.quote")
def valid_claims(spark, d):
    rows = documents(spark, d)
    claims = rows.select(F.col("doc_id").alias("claim_id"), "cand", F.expr("doc_id div 2 * 2").alias("source_id"), F.lit("early_stage").alias("feature"), F.when(F.col("doc_id") % 7 == 0, "not there").otherwise(" ").alias("quote"))
    sources = rows.select(F.col("doc_id").alias("source_id"), "text", F.when(F.col("doc_id") % 3 == 0, "2027-01-01").when(F.col("doc_id") % 4 == 0, "2026-01").otherwise("2026-01-01").alias("published_at"))
    return S.valid_claims(claims, sources, "cand", AS_OF, "claim_id").select("cand", "claim_id", "source_id", "quote")


# adapters: candidates list their own document, one before it, one that is not there
_adapt = "SELECT c.doc_id AS candidate_id, l.source_id, s.doc_id AS found, s.text, s.doc_id % 9 AS k FROM (SELECT doc_id, unnest([doc_id, doc_id - 1]) AS source_id FROM documents) l JOIN documents c USING (doc_id) LEFT JOIN documents s ON s.doc_id = l.source_id"
_adapted = [*V.ADAPTED_TYPES, "forum"]
_adapted_sql = _pick_sql([*V.ADAPTED_TYPES.values(), "unknown"], "source_id")


def _adapter_rows(spark, d):
    rows, c = documents(spark, d), F.col
    listed = rows.select(c("doc_id").cast("string").alias("candidate_id"), F.transform(F.array("doc_id", F.col("doc_id") - 1, "doc_id"), lambda x: x.cast("string")).alias("source_doc_ids"))
    docs = rows.select(
        c("doc_id").cast("string").alias("doc_id"), "text", F.when(c("doc_id") % 10 == 0, " ").otherwise("t").alias("title"), _pick(_adapted).alias("source_type"),
        F.lit("2026-02-03T00:00:00Z").alias("published_at"), (c("doc_id") % 4 == 0).alias("published_at_is_estimated"), F.lit(False).alias("is_generated_summary"),
    )
    return listed, docs


@query("adapt_sources", f"SELECT CAST(candidate_id AS VARCHAR) AS candidate_id, CAST(source_id AS VARCHAR) AS source_id, CAST(candidate_id - source_id AS INTEGER) AS place, CASE WHEN w IS NULL THEN {_adapted_sql} END AS source_type, CASE WHEN w IS NULL AND source_id % 4 <> 0 THEN '2026-02-03' END AS published_at, w AS warning FROM (SELECT *, CASE WHEN found IS NULL THEN 'Missing document: ' || source_id WHEN trim(text) = '' OR text IS NULL OR source_id % 10 = 0 THEN 'Empty document: ' || source_id END AS w FROM ({_adapt}))")
def adapt_sources(spark, d):
    return A.adapt_sources(*_adapter_rows(spark, d))


@query(
    "review_errors",
    """SELECT CAST(d.doc_id AS VARCHAR) AS candidate_id, CASE WHEN trim(d.text) = '' OR d.text IS NULL OR d.doc_id % 10 = 0 THEN 'missing_evidence_or_source' WHEN d.doc_id % 7 = 0 THEN 'unknown_feature' WHEN d.doc_id % 9 = 0 THEN 'reviewer_and_rationale_required'
 WHEN d.doc_id % 11 = 0 OR substr(d.text, 1, 30) = '' THEN 'quote_not_in_document' WHEN d.doc_id % 13 = 0 THEN 'future_claim_as_observed' END AS error FROM documents d""",
)
def review_errors(spark, d):
    listed, docs = _adapter_rows(spark, d)
    c = F.col
    n = c("doc_id").cast("long")
    evidence = docs.select(c("doc_id").alias("candidate_id"), F.lit("e").alias("evidence_id"), "doc_id", F.concat(F.when(n % 11 == 0, "\u0001").otherwise(""), F.substring("text", 1, 30)).alias("quote"), (n % 13 == 0).alias("is_future_looking"), "is_generated_summary")
    reviews = docs.select(c("doc_id").alias("candidate_id"), F.lit("e").alias("evidence_id"), F.when(n % 7 == 0, "other").otherwise("relevance").alias("feature"), F.when(n % 9 == 0, " ").otherwise("r").alias("reviewer"), F.lit("because").alias("rationale"), F.lit("observed").alias("event_status"))
    return A.review_errors(reviews, evidence, docs, A.adapt_sources(listed, docs)).select("candidate_id", "error")


# evaluation
_dec = "list_extract(['likely_weak','likely_mature','needs_review'], CAST(doc_id % 3 AS INTEGER) + 1)"


def _judged(spark, d):
    guess = documents(spark, d).select("doc_id", _pick(list(X.DECISIONS)).alias("decision"))
    return guess, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").dropDuplicates(["doc_id"])


@query("decision_matrix", f"SELECT t.truth, count(CASE WHEN p = 'likely_weak' THEN 1 END) AS positive, count(CASE WHEN p = 'likely_mature' THEN 1 END) AS negative, count(CASE WHEN p = 'needs_review' THEN 1 END) AS abstain FROM (VALUES (0), (1), (2)) t(truth) LEFT JOIN (SELECT quality, {_dec} AS p FROM labels) ON quality = truth GROUP BY t.truth")
def decision_matrix(spark, d):
    guess, labels = _judged(spark, d)
    return X.decision_matrix(X.one_to_one(guess.join(labels.select("doc_id"), "doc_id"), labels, "doc_id"), "quality", "decision", [0, 1, 2])


@query("binary_report", f"WITH x AS (SELECT CASE WHEN doc_id % 4 <> 0 THEN quality END AS t, {_dec} AS p FROM labels), n AS (SELECT count(*) AS n_all, count(t) AS n_resolved, count(CASE WHEN t = 1 AND p = 'likely_weak' THEN 1 END) AS tp, count(CASE WHEN t = 0 AND p = 'likely_weak' THEN 1 END) AS fp, count(CASE WHEN t = 1 AND p <> 'likely_weak' THEN 1 END) AS fn, count(CASE WHEN t = 0 AND p = 'likely_mature' THEN 1 END) AS tn, count(CASE WHEN t IS NOT NULL AND p = 'needs_review' THEN 1 END) AS abstained, count(CASE WHEN t IS NULL AND p = 'likely_weak' THEN 1 END) AS unresolved_called_weak FROM x) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((n_resolved - abstained) / n_resolved, 6) AS decision_coverage, round((tp + tn) / n_resolved, 6) AS correct_fraction FROM n")
def binary_report(spark, d):
    guess, labels = _judged(spark, d)
    rows = labels.join(guess, "doc_id").withColumn("truth", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    out = X.binary_report(rows, "truth", "decision")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


_md = "CAST('0x' || substr(md5('42-' || s.i || '-' || p.i), 1, 15) AS BIGINT)"


@query("bootstrap_error", f"WITH g AS (SELECT p_brand AS k, sum(abs((p_partkey % 7 - 3) / 4.0)) AS e, count(*) AS n FROM part GROUP BY p_brand), o AS (SELECT *, row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) - 1 AS place, count(*) OVER () AS size FROM g), dr AS (SELECT s.i AS sample, {_md} % (SELECT count(*) FROM g) AS place FROM range(200) s(i), (SELECT place AS i FROM o) p), m AS (SELECT sample, sum(e) / sum(n) AS mean FROM dr JOIN o USING (place) GROUP BY sample) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m")
def bootstrap_error(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_brand", F.col("p_size").cast("double").alias("y"), (F.col("p_size") + (F.col("p_partkey") % 7 - 3) / 4.0).alias("g"))
    out = X.bootstrap_error(rows, "y", "g", "p_brand", samples=200)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_tied = "SELECT doc_id, 'c' || (doc_id // 3) AS k1, CASE WHEN doc_id % 12 = 0 THEN 'd' || (doc_id // 48) END AS k2 FROM documents"


@query("merged_groups", f'WITH RECURSIVE x AS ({_tied}), h AS (SELECT doc_id AS p, min(doc_id) OVER (PARTITION BY k1) AS q FROM x UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY k2) FROM x WHERE k2 IS NOT NULL), ed AS (SELECT p, q FROM h UNION SELECT q, p FROM h), re AS (SELECT doc_id AS node, doc_id AS top FROM x UNION SELECT ed.q, re.top FROM re JOIN ed ON ed.p = re.node) SELECT node AS doc_id, min(top) AS "group" FROM re GROUP BY node')
def merged_groups(spark, d):
    n = F.col("doc_id")
    rows = documents(spark, d).select("doc_id", F.concat(F.lit("c"), F.expr("doc_id div 3")).alias("k1"), F.when(n % 12 == 0, F.concat(F.lit("d"), F.expr("doc_id div 48"))).alias("k2"))
    return X.merged_groups(rows, "doc_id", ["k1", "k2"])


@query("token_features", f"SELECT doc_id, len(w) + 1 AS n_features, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(w) * (1 / sqrt(len(w))) + 1 END, 6) AS total FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all({FOLD.format('text')}, '{TOK}'), lambda w: length(w) >= 2)) AS w FROM documents WHERE trim(text) <> '')")
def token_features(spark, d):
    rows = documents(spark, d).select("doc_id", X.token_features(F.col("text"), F.col("lang")).alias("f")).where("f IS NOT NULL")
    total = F.aggregate(F.map_values("f"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.size("f").cast("long").alias("n_features"), F.round(total, 6).alias("total"))


@query("rank_report", "SELECT p_partkey AS candidate_id, p_brand AS technology_group_id, p_size AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_partkey % 3 = 0) WHERE r = 1 ORDER BY p_size DESC, p_partkey LIMIT 15")
def rank_report(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("candidate_id"), F.col("p_brand").alias("technology_group_id"), F.col("p_size").alias("score"), F.when(F.col("p_partkey") % 3 == 0, "weak").otherwise("reject").alias("decision"))
    return X.rank_report(rows)[0].drop("decision")


# texts and addresses
@query("source_links", "SELECT page_id, 'p' || page_id AS title, url, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www[.]', '')) AS host FROM pages WHERE regexp_full_match(url, 'https?://[^)\\s]+') UNION ALL SELECT page_id, 'x', 'https://x.example/y', 'x.example' FROM pages")
def source_links(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.lit("see [p"), "page_id", F.lit("]("), "url", F.lit(") and [x](https://x.example/y), not [z](ftp://z)")).alias("t"))
    return rows.select("page_id", F.inline(U.source_links(F.col("t"))))


@query("strict_url", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN list_extract(['http','https'], CAST(doc_id % 3 AS INTEGER) + 1) || '://www.a.example/x/?b=' || doc_id END AS url FROM documents")
def strict_url(spark, d):
    raw = F.concat(_pick(["HTTP", "https", "ftp"]), F.lit("://WWW.a.example/x/?utm_source=q&b="), F.col("doc_id"), F.lit("&gclid=1#top"))
    return documents(spark, d).select("doc_id", U.strict_url(raw).alias("url"))


@query("topic_keywords", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{TOK}'), lambda w: length(w) >= 3 AND NOT list_contains([{','.join(chr(39) + w + chr(39) for w in V.STOPWORDS)}], w)), ' ') AS words FROM documents")
def topic_keywords(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(T.topic_keywords(F.col("text")), " ").alias("words"))


@query("escape_html", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html FROM documents")
def escape_html(spark, d):
    return documents(spark, d).select("doc_id", T.escape_html(F.col("text")).alias("html"))


@query("excerpts")
def excerpts(spark, d):
    """The sentences nearest to a title; no SQL, a test holds it against a plain loop."""
    return documents(spark, d).select("doc_id", F.inline(T.excerpt(F.col("text"), F.col("title"))))


# likeness and models
@query("near_duplicates")
def near_duplicates(spark, d):
    """Greedy leaders at likeness 88; no SQL, tests hold it against all pairs of a small table."""
    return K.near_duplicates(documents(spark, d), "doc_id", "text", [])


@query("deduplicate_and_score")
def deduplicate_and_score(spark, d):
    rows = documents(spark, d).withColumn("url", F.concat(F.lit("u"), F.col("doc_id")))
    return Y.deduplicate_and_score(rows, "url", "text", "doc_id").select("doc_id", "duplicate_of", "event_cluster_id", "trust_level")


@query("source_ranker")
def source_ranker(spark, d):
    """Out-of-fold predictions of ridge regression on document statistics; no SQL, tests hold it against numpy."""
    rows = documents(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")
    ready = rows.select("doc_id", "cand", "quality", F.log1p(F.length("text")).alias("log_length"), (F.size(F.split("text", r"\s+")) / (1.0 + F.length("text"))).alias("word_share"), T.contains_any(F.col("text"), ["thst"]).cast("double").alias("marker"))
    return M.ridge(ready, ["log_length", "word_share", "marker"], "quality", "cand", 10.0, True, 0.0, 1.0)[1].select("doc_id", "fold", "prediction", "baseline")


@query("event_clusters_by_likeness")
def event_clusters_by_likeness(spark, d):
    """Clusters of documents at likeness 45 within ten days; no SQL has the edit ratio, tests hold them against the double loop."""
    return Y.event_clusters(documents(spark, d), "doc_id", F.col("text"), "published")
