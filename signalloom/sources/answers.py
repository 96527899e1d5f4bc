"""Answers saved from searches and fetches: Atom feeds, API hits, bytes, citation states, follow-up addresses, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import urls as U
from signalloom.sources import payloads as P

#: Fixed values of the rule.
CHALLENGES = ["verify you are human", "just a moment", "access denied", "enable javascript and cookies"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
BINARY = ["application/pdf", "image/", "application/octet-stream"]


def atom_query(topic: str, window: tuple[str, str] | None = None) -> str:
    """The preprint server's search expression: every word of the topic, within ISO dates if given."""
    words = " AND ".join(f'all:"{w}"' for w in re.findall(r"[\w-]+", topic))
    if window is None:
        return words
    first, last = (d.replace("-", "") for d in window)
    return f"({words}) AND submittedDate:[{first}0000 TO {last}2359]"


def atom(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of saved Atom feeds as hits; the summary is the text, and an entry without an id goes."""
    kind = "entry array<struct<id:string,title:string,summary:string,published:string>>"
    rows = P.items(df, F.from_xml(F.col(payload), kind)["entry"], keep)
    clean = lambda c: F.trim(F.col(f"x.{c}"))
    return P.hits(rows, "arxiv", F.nullif(clean("id"), F.lit("")), clean("title"), clean("summary"), F.try_to_timestamp(clean("published")), F.lit(False), "abstract", keep)


def strip_tags(text: Column) -> Column:
    """A text without its markup, pieces joined by single spaces; one without a tag sign stays as it is."""
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[/!?A-Za-z][^>]*>", " ")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.when(text.contains("<"), F.trim(F.regexp_replace(out, r"\s+", " "))).otherwise(text)


def api_documents(hits: DataFrame, default: str) -> DataFrame:
    """Documents of hits that carry their own text: the host's kind where that is sure (0.6), else the connector's at 0.7."""
    found = U.source_type(F.col("url"), F.lit(default))
    rows = hits.withColumn("text", strip_tags(F.coalesce("snippet", F.lit("")))).withColumn("g", found)
    sure = F.col("g.confidence") >= 0.6
    return rows.select(
        U.document_id(F.col("url")).alias("doc_id"), "url", U.normalize_url(F.col("url")).alias("normalized_url"), U.domain_of(F.col("url")).alias("domain"), "title", "text",
        F.when(sure, F.col("g.type")).otherwise(default).alias("source_type"), F.when(sure, F.col("g.confidence")).otherwise(0.7).alias("confidence"),
        F.sha2(F.coalesce(F.nullif("text", F.lit("")), F.nullif("title", F.lit("")), "url"), 256).alias("content_hash"), "published_at", "date_estimated", "connector", "text_scope",
    )


def decode_bytes(content: bytes | None, kind: str | None) -> str | None:
    """Text of an answer: JSON is UTF-8, else the named character set, else the one the page names, else UTF-8; null if none fits."""
    if content is None:
        return None
    kind = kind or ""
    if "application/json" in kind.lower():
        names = ["utf-8-sig"]
    else:
        named = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", kind, re.I)
        inner = re.search(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", content[:4096], re.I)
        mark = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16"}
        marked = next((c for m, c in mark.items() if content.startswith(m)), None)
        names = [named and named.group(1), marked, inner and inner.group(1).decode("ascii", "replace"), "utf-8", "cp1252"]
    for name in filter(None, names):
        try:
            return content.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


def decoded(content: Column, kind: Column) -> Column:
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([decode_bytes(x, y) for x, y in zip(a, b)], dtype="object")

    return F.pandas_udf(run, "string")(content, kind)


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def uncached(links: DataFrame, cache: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Links (url) to fetch: those without a stored answer (key, status), or with a failed one if asked to."""
    known = cache.where("status = 'retrieved_unverified'") if retry_failed else cache
    return links.withColumn("key", cache_key(F.col("url"))).join(known.select("key"), "key", "left_anti")


def link_status(links: DataFrame, cache: DataFrame) -> DataFrame:
    """Each link with the state of its stored answer."""
    return links.withColumn("key", cache_key(F.col("url"))).join(cache.select("key", "status"), "key")


def citation_status(fetched: Column, kind: Column, text: Column) -> Column:
    """What became of a cited address: the fetch's own failure, a binary file, a challenge page, too little text, or a text."""
    binary = T.contains_any(F.coalesce(kind, F.lit("")), BINARY)
    body = F.coalesce(text, F.lit(""))
    out = F.when(fetched != "ok", fetched).when(binary, "unsupported_content").when(T.contains_any(body, CHALLENGES), "possible_challenge_page")
    return out.when(F.length(F.trim(body)) >= 300, "retrieved_unverified").otherwise("insufficient_text")


def quality_warnings(status: Column, published: Column, estimated: Column, confidence: Column) -> Column:
    """The warnings of a parsed answer, in order; answers that were not parsed have none."""
    parsed = status.isin("retrieved_unverified", "insufficient_text", "possible_challenge_page")
    warnings = F.array(
        F.when(published.isNull(), "publication_date_missing"), F.when(estimated, "publication_date_estimated"),
        F.when(confidence.isNull() | (confidence < 0.6), "source_type_requires_review"), F.when(status == "possible_challenge_page", "content_may_be_antibot_page"),
    )
    return F.when(parsed, F.array_compact(warnings)).otherwise(F.array().cast("array<string>"))


def follow_ups(df: DataFrame, url: str, links: str) -> DataFrame:
    """(url, target, relation): the full text of a preprint, and works that a document cites by identifier, its own aside."""
    rows = df.select(F.col(url).alias("url"), U.work_id(F.col(url)).alias("own"), F.col(links).alias("links"))
    tail = F.regexp_replace(F.element_at(F.split(U.part(F.col("url"), 3), "/"), -1), r"\.pdf$", "")
    full = rows.where("own LIKE 'arxiv:%' AND NOT contains(url, '/html/')").select("url", F.concat(F.lit("https://arxiv.org/html/"), tail).alias("target"), F.lit("same_work_full_text").alias("relation"))
    cited = rows.select("url", "own", F.explode("links").alias("link")).withColumn("work", U.work_id(F.col("link"))).where("work IS NOT NULL AND NOT work <=> own")
    target = F.when(F.col("work").startswith("doi:"), F.concat(F.lit("https://doi.org/"), F.substring("work", 5, 1 << 20))).otherwise(F.concat(F.lit("https://arxiv.org/html/"), F.substring("work", 7, 1 << 20)))
    return full.union(cited.select("url", target.alias("target"), F.lit("cited_work").alias("relation")))


def next_targets(targets: DataFrame, seen: DataFrame, priority: DataFrame, limit: int = 12) -> DataFrame:
    """The addresses to fetch next: unseen ones, those of priority documents first, then by address."""
    fresh = targets.join(seen.select(F.col("url").alias("target")), "target", "left_anti")
    first = priority.select("url", F.lit(0).alias("late")).distinct()
    ranked = fresh.join(first, "url", "left").groupBy("target").agg(F.min(F.coalesce("late", F.lit(1))).alias("late"), F.min_by("relation", "url").alias("relation"))
    return ranked.orderBy("late", "target").limit(limit).select("target", "relation")


def preprint_id(url: Column) -> Column:
    """The id, version included, of a preprint's own page, else null."""
    found = F.regexp_extract(U.part(url, 3), r"^/(?:html|abs)/(\d{4}\.\d{4,5}(?:v\d+)?)$", 1)
    return F.when(F.lower(U.part(url, 2)).isin("arxiv.org", "www.arxiv.org") & (found != ""), found)


def recover_dates(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (url, title, published, estimated, ..); an unknown date is taken from the page (id, citation_title, page_date,
    page_estimated) of the same preprint if the titles' letters agree.  One page per id is expected; of several, the earliest dated."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    dated = pages.where("page_date IS NOT NULL").withColumn("t", plain(F.col("citation_title")))
    dated = dated.groupBy("id", "t").agg(F.min(F.struct("page_date", "page_estimated")).alias("p"))
    keyed = documents.withColumn("id", F.when(F.col("published").isNull(), preprint_id(F.col("url")))).withColumn("t", plain(F.coalesce("title", F.lit(""))))
    both = keyed.join(dated, ["id", "t"], "left")
    return both.withColumn("estimated", F.when(F.col("p").isNotNull(), F.col("p.page_estimated")).otherwise(F.col("estimated"))).withColumn("published", F.coalesce("published", "p.page_date")).drop("id", "t", "p")


def rerank_results(df: DataFrame, topic: str, url: str, text: str, place: str, shape: str, limit: int) -> DataFrame:
    """Search results by shared topic words, then by their own order; one per address, of the given path shape only."""
    shared = F.size(F.array_intersect(T.topic_words(F.col(text)), T.topic_words(F.lit(topic))))
    rows = df.where(U.part(F.col(url), 3).rlike(shape)).withColumn("overlap", shared)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(url).orderBy(F.desc("overlap"), place))).where("n = 1").drop("n")
    return first.orderBy(F.desc("overlap"), place).limit(limit)


def detect_language(text: Column, hint: Column, words: dict[str, list[str]]) -> Column:
    """struct<language, confidence>: a hint's first two letters at 1.0; else by script, else by most of a language's ``words``
    (the first of equals); null for texts under 20 characters or without such words.  Guesses have no confidence."""
    body = F.trim(F.coalesce(text, F.lit("")))
    found = F.filter(F.split(F.lower(F.substring(body, 1, 3000)), r"[^\p{L}]+"), lambda w: w != "")
    scores = [F.struct(F.size(F.filter(found, lambda w: w.isin(ws))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*scores))
    russian = F.length(F.regexp_replace(body, "[^а-яёА-ЯЁ]", "")) * 2 > F.length(F.regexp_replace(body, r"[^\p{L}]", ""))
    guess = F.when(F.length(body) < 20, None).when(russian, "ru").when(best["n"] > 0, best["name"])
    hinted = F.coalesce(hint, F.lit("")) != ""
    return F.struct(F.when(hinted, F.lower(F.substring(hint, 1, 2))).otherwise(guess).alias("language"), F.when(hinted, 1.0).alias("confidence"))


def replay(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Documents of a saved retrieval, one JSON list or object a file."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=True)


def label_rows(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Decided rows of a CSV label sheet; a byte order mark and blank labels go."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.where(F.trim(F.coalesce(label, F.lit(""))) != "")
