"""What readers see: cards of candidates, the lists of a run, and a report page."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import terms
from signalloom.functions import urls as U
from signalloom.functions import vocabulary as V
from signalloom.operators import evidence as E


def matched_claims(claims: DataFrame, sources: DataFrame, by: str, source: str = "source_id") -> DataFrame:
    """Claims (by, source, evidence_id, feature, quote) whose quote stands in their source's text (by, source, text)."""
    both = claims.join(sources.select(by, source, "text"), [by, source])
    return both.where((F.col("quote") != "") & F.col("text").contains(F.col("quote"))).drop("text")


def score_parts(flags: DataFrame, matched: DataFrame, by: str) -> DataFrame:
    """(by, feature, weight, contribution, evidence_ids): what each feature gives to a candidate's score, and its matched claims."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(w).alias("weight"), F.when(F.col(f), w).otherwise(0).alias("contribution")) for f, w in V.AUTOMATIC_WEIGHTS.items()])
    rows = flags.select(by, F.inline(parts))
    ids = matched.groupBy(by, "feature").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return rows.join(ids, [by, "feature"], "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def excerpts(facts: DataFrame, sources: DataFrame, by: str, source: str = "source_id", most: int = 4) -> DataFrame:
    """The first ``most`` facts (by, source, claim_type, place, quote, is_future) of each kind that stand in a source with a safe address."""
    both = facts.join(sources.select(by, source, "text", "url"), [by, source])
    good = both.where((F.col("quote") != "") & F.col("text").contains(F.col("quote")) & U.safe_url(F.col("url")).isNotNull())
    order = Window.partitionBy(by, "claim_type").orderBy("place")
    ranked = good.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return ranked.select(by, source, "claim_type", F.col("n").alias("place"), "quote", "is_future", terms.russian_terms(F.col("quote")).alias("topics"))


def card_title(name: Column, index: Column, topics: dict[str, str], other: str) -> Column:
    """A Cyrillic name as it is, else the first topic that the name mentions (or ``other``) with the candidate's number."""
    low = F.lower(F.coalesce(name, F.lit("")))
    topic = F.lit(other)
    for word, title in reversed(topics.items()):
        topic = F.when(low.contains(word), title).otherwise(topic)
    return F.when(name.rlike("[А-Яа-я]"), name).otherwise(F.concat(topic, F.lit(" · "), index.cast("string")))


def cards(candidates: DataFrame, sources: DataFrame, parts: DataFrame, quotes: DataFrame, by: str) -> DataFrame:
    """One nested row per candidate: its columns, sources, score parts and excerpts.  Meant for the chosen few, as lists grow with a candidate's sources."""
    safe = sources.withColumn("url", U.safe_url(F.col("url"))).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("source_id", "title", "url", "text"))).alias("sources"))
    scored = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("feature", "weight", "contribution", "evidence_ids"))).alias("score_parts"))
    said = quotes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("claim_type", "place", "source_id", "quote"))).alias("excerpts"))
    return candidates.join(safe, by, "left").join(scored, by, "left").join(said, by, "left")


def run_lists(assessed: DataFrame, results: DataFrame, limit: int = 15) -> DataFrame:
    """(candidate_id, place, preliminary): the results in their order, each once, then preliminary ones in the free places.

    ``results`` has (candidate_id, place); candidates that were not assessed are left out.
    """
    first = results.groupBy("candidate_id").agg(F.min("place").alias("at")).join(assessed.select("candidate_id"), "candidate_id", "left_semi")
    top = first.orderBy("at").limit(limit)
    taken = top.count()  # at most ``limit`` rows
    chosen = top.select("candidate_id", F.row_number().over(Window.orderBy("at")).alias("place"), F.lit(False).alias("preliminary"))
    more = E.preliminary(assessed, top, limit - taken).select("candidate_id", "score")
    extra = more.select("candidate_id", (F.row_number().over(Window.orderBy(F.desc("score"), "candidate_id")) + taken).alias("place"), F.lit(True).alias("preliminary"))
    return chosen.union(extra)


def report(shown: DataFrame, query: str, as_of: str, order: str, limit: int = 100) -> str:
    """An HTML page of the first ``limit`` cards (candidate_id, technology_name, score, sources), all texts escaped."""
    esc = lambda x: html.escape(str("unknown" if x is None else x))
    articles = []
    for r in shown.orderBy(order).limit(limit).toLocalIterator():
        links = "".join(f'<li><a href="{esc(s.url or "#")}" rel="noopener noreferrer">{esc(s.title)}</a></li>' for s in r.sources or [])
        texts = "".join(f"<details><summary>{esc(s.title)}</summary><pre>{esc(s.text)}</pre></details>" for s in r.sources or [])
        articles.append(f"<article><h2>{esc(r.technology_name)}</h2><p>Score {esc(r.score)}, <code>{esc(r.candidate_id)}</code></p><ul>{links}</ul>{texts}</article>")
    head = f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Signals</title><h1>Signals</h1><p>{esc(query)}, {esc(as_of)}, {len(articles)} candidates</p>'
    return head + ("".join(articles) or "<p>No documents were selected.</p>") + "</html>"
