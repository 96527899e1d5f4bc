"""Saved answers of public search APIs, read as one table of hits.

Each function takes a DataFrame with a string column of whole answers and returns
(url, title, snippet, published_at, date_estimated, connector, text_scope); with columns to ``keep``, these and
``item``, the hit's place in its answer, as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def items(df: DataFrame, found: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row (keep, item, x) per element of the answers' lists."""
    return df.select(*keep, F.posexplode(found).alias("item", "x"))


def hits(df: DataFrame, connector: str, url: Column, title: Column, snippet: Column, published: Column, estimated: Column, scope: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        url.alias("url"), title.alias("title"), snippet.alias("snippet"), published.cast("timestamp").alias("published_at"), estimated.alias("date_estimated"), F.lit(connector).alias("connector"), F.lit(scope).alias("text_scope"), *((*keep, "item") if keep else ())
    ).where(F.col("url").isNotNull())


def crossref(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Works of a registry of publications; a missing month or day counts as 1 and marks the date as estimated."""
    kind = "message struct<items:array<struct<URL:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>>>>"
    rows = items(df, F.from_json(payload, kind)["message"]["items"], keep).withColumn("d", F.get(F.col("x.issued.date-parts"), F.lit(0)))
    at = lambda i: F.get("d", F.lit(i))
    date = F.try_make_timestamp(at(0), F.coalesce(at(1), F.lit(1)), F.coalesce(at(2), F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    title = F.get(F.col("x.title"), F.lit(0))
    return hits(rows, "crossref", F.col("x.URL"), title, F.col("x.abstract"), date, F.coalesce(F.size("d") < 3, F.lit(False)), "abstract", keep)


def gdelt(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of a news index, dated yyyyMMddHHmmss or yyyyMMdd'T'HHmmss'Z'."""
    rows = items(df, F.from_json(payload, "articles array<struct<url:string,title:string,seendate:string>>")["articles"], keep)
    date = F.try_to_timestamp(F.regexp_replace("x.seendate", "[TZ]", ""), F.lit("yyyyMMddHHmmss"))
    return hits(rows, "gdelt", F.col("x.url"), F.col("x.title"), F.lit(""), date, F.lit(False), "search_snippet", keep)


def hackernews(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = (), item: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Submissions of a forum: no address means the discussion's own, and a submission's date is not a publication's."""
    rows = items(df, F.from_json(payload, "hits array<struct<objectID:string,url:string,title:string,story_text:string>>")["hits"], keep)
    url = F.coalesce(F.nullif(F.col("x.url"), F.lit("")), F.concat(F.lit(item), "x.objectID"))
    return hits(rows, "hackernews", url, F.col("x.title"), F.coalesce("x.story_text", F.lit("")), F.lit(None).cast("timestamp"), F.lit(False), "search_snippet", keep)


def github(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Repositories of a code host, dated by their creation."""
    rows = items(df, F.from_json(payload, "items array<struct<html_url:string,full_name:string,description:string,created_at:string>>")["items"], keep)
    return hits(rows, "github", F.col("x.html_url"), F.col("x.full_name"), F.coalesce("x.description", F.lit("")), F.try_to_timestamp("x.created_at"), F.lit(False), "description", keep)
