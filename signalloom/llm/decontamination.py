"""Benchmark decontamination by a distributed positional inverted index, DataFrame functions only.

The index holds a posting (doc, term, pos) for every occurrence of a test term in the training texts.  Each
task writes the lists of its own documents, sorted by term, so no posting is shuffled to build it; terms that no
test item holds have no list, as nothing asks for them.

A phrase is found by intersecting its terms' lists from the rarest on, each shifted by the term's offset: the
rarest list gives candidate starts, and a start stays if the next lists hold the places it asks for.
Two more lists are read one by one, the rest together, for the starts that are left; if these lie in few documents, only
those documents' postings take part.  Phrases that several items share are looked for once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import documents, store
from signalloom.llm.licenses import word_list

WINDOW = 10
#: Most words, phrases' terms or documents (a long each, or a word) that are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
HEAD = -1


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass
class Index:
    """``heads``: (doc, id, n_words), a row per document.  ``postings``: (doc, term, pos).  ``terms``: (term, word, n), n > 0."""

    heads: DataFrame
    postings: DataFrame
    terms: DataFrame


def build_index(df: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a table's whole texts for the terms of ``words`` (word).

    Every row is a document of its own, whatever its id.  A document's number of words rides along as the place
    of an empty word after the last, so texts are read and cut into words once.
    """
    known = store(words.where("word <> ''").distinct(), "words")
    terms = known.select("word", F.monotonically_increasing_id().alias("term"))
    end = df.sparkSession.createDataFrame([("", HEAD)], "word string, term long")
    terms = store(terms.unionByName(end), "terms")
    rows = df.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), word_list(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    tokens = rows.select("doc", "id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    lists = tokens.join(bounded(terms), "word").select("doc", "term", "pos", F.when(F.col("term") == HEAD, F.col("id")).alias("id"))
    whole = store(lists.sortWithinPartitions("term", "doc", "pos"), "postings")
    heads = whole.where(F.col("term") == HEAD).select("doc", "id", F.col("pos").cast("long").alias("n_words"))
    postings = whole.where(F.col("term") > HEAD).select("doc", "term", "pos")
    return Index(heads, postings, store(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term"), "counts"))


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, w) of the items with words; the id as text, empty for null."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_list(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    return rows.where(F.size("w") > 0)


def windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(phrase, words) of all distinct windows, and (phrase, item); an item of fewer words than ``window`` is one window."""
    each = items.select("item", F.col("w"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    each = store(each.select("item", F.slice("w", F.col("s") + 1, window).alias("words")).distinct(), "windows")
    phrases = store(each.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    return phrases, store(each.join(phrases, "words").select("phrase", "item"), "holders")


def rarest_first(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, by): each phrase's terms as structs (n, offset, term), rarest first; phrases with a term that has no posting are gone."""
    each = phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    held = each.join(index.terms, "word").groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by"))
    return held.where(F.size("by") == F.col("size")).select("phrase", "by")


def _lists(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the terms that rows (term, ..) ask for."""
    return index.postings.join(bounded(store(asked.select("term").distinct(), "asked")), "term", "left_semi")


def find_phrases(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, doc, start, size): every place where a phrase's words stand consecutively."""
    by = store(rarest_first(index, phrases), "by")
    first = bounded(store(by.select("phrase", "by", F.col("by")[0]["term"].alias("term")), "first"))
    found = index.postings.join(first, "term").select("phrase", "by", "doc", (F.col("pos") - F.col("by")[0]["offset"]).alias("start")).where("start >= 0")
    found = store(found, "starts")
    for k in (1, 2):
        more = found.where(F.size("by") > k).withColumn("term", F.col("by")[k]["term"]).withColumn("at", F.col("start") + F.col("by")[k]["offset"])
        lists = _lists(index, by.where(F.size("by") > k).select(F.col("by")[k]["term"].alias("term"))).withColumnsRenamed({"doc": "d", "term": "t", "pos": "p"})
        kept = more.join(lists, (F.col("doc") == F.col("d")) & (F.col("term") == F.col("t")) & (F.col("at") == F.col("p")), "left_semi")
        found = store(kept.select("phrase", "by", "doc", "start").unionByName(found.where(F.size("by") <= k)), "starts")
    whole = found.select("phrase", "doc", "start", F.size("by").alias("size"), F.slice("by", 4, 1 << 30).alias("rest"))
    done, open_ = whole.where("size <= 3").drop("rest"), whole.where("size > 3")
    asked = open_.select("phrase", "doc", "start", "size", F.explode("rest").alias("x")).select("phrase", "doc", "start", "size", F.col("x.term").alias("term"), (F.col("start") + F.col("x.offset")).alias("pos"))
    within = store(open_.select("doc").distinct(), "docs")
    lists = index.postings
    if within.count() <= BROADCAST_ROWS:
        lists = lists.join(F.broadcast(within), "doc", "left_semi")
    met = asked.join(lists.withColumnsRenamed({"doc": "d", "term": "t", "pos": "p"}), (F.col("doc") == F.col("d")) & (F.col("term") == F.col("t")) & (F.col("pos") == F.col("p")))
    met = met.groupBy("phrase", "doc", "start", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("size") - 3)
    return done.unionByName(met.drop("n"))


def find_nearby(index: Index, groups: DataFrame, within: int) -> DataFrame:
    """(phrase, doc, at): places ``at`` of a group's rarest word with all words of the group (phrase, words) inside ``within`` consecutive words that hold it.

    Words are taken once each.  Around a place only the 2 * within - 1 words next to it are gathered.
    """
    by = rarest_first(index, groups.select("phrase", F.array_distinct("words").alias("words")))
    first = bounded(store(by.select("phrase", "by", F.col("by")[0]["term"].alias("term")), "first"))
    found = store(index.postings.join(first, "term").select("phrase", "by", "doc", F.col("pos").alias("at")), "places")
    alone, more = found.where(F.size("by") == 1), found.where(F.size("by") > 1)
    block = F.floor(F.col("at") / within).cast("int")
    asked = more.select("phrase", "doc", "at", F.size("by").alias("size"), F.explode(F.slice("by", 2, 1 << 30)).alias("x"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    asked = asked.select("phrase", "doc", "at", "size", F.col("x.term").alias("term"), "block")
    lists = _lists(index, asked).select(F.col("doc").alias("d"), F.col("term").alias("t"), "pos", F.floor(F.col("pos") / within).cast("int").alias("b"))
    near = asked.join(lists, (F.col("doc") == F.col("d")) & (F.col("term") == F.col("t")) & (F.col("block") == F.col("b"))).where(F.abs(F.col("pos") - F.col("at")) < within)
    held = near.groupBy("phrase", "doc", "at", "size").agg(F.collect_set(F.struct("term", "pos")).alias("near"))
    inside = lambda s: F.size(F.array_distinct(F.transform(F.filter("near", lambda x: (x["pos"] >= s) & (x["pos"] < s + within)), lambda x: x["term"]))) == F.col("size") - 1
    held = held.where(F.exists(F.sequence(F.col("at") - within + 1, F.col("at")), inside))
    return held.select("phrase", "doc", "at").unionByName(alone.select("phrase", "doc", "at"))


def covered(matches: DataFrame) -> DataFrame:
    """(doc, n_hit): how many words of each document the matches (doc, start, size) cover."""
    before = Window.partitionBy("doc").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    new = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    return matches.select("doc", F.greatest(new, F.lit(0)).alias("new")).groupBy("doc").agg(F.sum("new").alias("n_hit"))


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items) for every row of df: words that stand in an item's window, and those items.

    Only A-Z are lower-cased.  A null or empty text has no words, hits or items.  ``items`` holds distinct item ids as text, sorted;
    rows of one item id are one item, and null ids count as one item with an empty id.  Items without words are never found; rows repeated in df
    are rows of their own.  Texts and items are read whole, whatever their length; other columns are not read, so
    they cannot clash.  Without items, or without rows, nothing is hit.
    """
    phrases, holders = windows(item_words(items, item_col, item_text), window)
    index = build_index(df, phrases.select(F.explode("words").alias("word")), id_col, text_col)
    matches = store(find_phrases(index, phrases), "matches")
    held = matches.select("phrase", "doc").join(holders, "phrase").select("doc", "item").distinct()
    held = held.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = covered(matches).join(held, "doc").withColumnRenamed("doc", "d")
    out = index.heads.join(found, F.col("doc") == F.col("d"), "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def near_items(df: DataFrame, items: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_places, first_place): documents in which all words of an item stand inside ``within`` consecutive words.

    A place is one of the item's rarest word (by its occurrences in df, then its offset in the item).  Nulls, empty texts and
    repeated rows as in decontaminate().
    """
    groups = item_words(items, item_col, item_text)
    phrases = store(groups.select(F.col("w").alias("words")).distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "groups")
    index = build_index(df, phrases.select(F.explode("words").alias("word")), id_col, text_col)
    found = find_nearby(index, phrases, within).groupBy("phrase", "doc").agg(F.count(F.lit(1)).alias("n_places"), F.min("at").alias("first_place"))
    holders = groups.join(phrases, F.col("w") == F.col("words")).select("item", F.col("phrase").alias("of")).distinct()
    out = found.join(holders, F.col("phrase") == F.col("of")).join(index.heads, "doc")
    return out.select("id", "item", "n_places", "first_place")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op11_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, unnest(list_transform(range(greatest(len(w) - {WINDOW}, 0) + 1), lambda s: w[s + 1 : s + {WINDOW}])) AS t FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT len(t) AS n FROM p),
each AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS s, unnest(list_transform(range(len(w) - n + 1), lambda s: w[s + 1 : s + n])) AS t FROM d, k WHERE len(w) >= n),
m AS (SELECT r, s, n, item FROM each JOIN p USING (t)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""
}
