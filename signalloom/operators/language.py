"""Language of texts by letter sequences: naive Bayes over three letters, trained on texts of known language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.tables import cut

GRAM, SIZE, LEAST, PRIOR = 3, 3000, 20, 0.5


def letters(text: Column, size: int = SIZE) -> Column:
    """The first ``size`` characters (as the rule has it) in lower case, all between letters as one space."""
    return F.regexp_replace(F.lower(F.substring(text, 1, size)), r"[^\p{L}]+", " ")


def grams(text: Column, n: int = GRAM) -> Column:
    """All n-letter sequences of a text as they stand, repeats included."""
    # One match a character, so the work grows with the text; substr would count from its start at every place.
    return F.regexp_extract_all(letters(text), F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1))


def train(df: DataFrame, key: str, text: str, language: str, n: int = GRAM) -> DataFrame:
    """(gram, language, more, least): how much more likely (natural log) a sequence is than one never seen in the language, and that one's log share.

    From counts over all rows with a language, added up before the shuffle; the counts, not the texts' sequences, are written.
    """
    own = df.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(grams(F.col(text), n)).alias("gram"))
    counts = cut(own.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("c")))
    kinds = counts.agg(F.countDistinct("gram").alias("v"))
    totals = counts.groupBy(F.col("language").alias("l")).agg(F.sum("c").alias("all")).crossJoin(F.broadcast(kinds))
    least = F.log(F.lit(PRIOR) / (F.col("all") + PRIOR * (F.col("v") + 1)))
    return counts.join(totals, F.col("language") == F.col("l")).select("gram", "language", F.log((F.col("c") + PRIOR) / PRIOR).alias("more"), least.alias("least"))


def detect(df: DataFrame, key: str, text: str, model: DataFrame, hint: Column | None = None) -> DataFrame:
    """(key, language, confidence): the hint's first two letters at 1.0, else the likeliest language of a text of LEAST characters or more, confidence null.

    Equally likely languages: the first by name.  Null and shorter texts, and texts without a sequence of letters, have no language.  Keys are unique.
    """
    hinted = F.nullif(F.lower(F.substring(F.trim(hint), 1, 2)), F.lit("")) if hint is not None else F.lit(None).cast("string")
    rows = df.select(key, F.col(text).alias("text"), hinted.alias("hinted"))
    read = rows.where(F.col("hinted").isNull() & (F.length("text") >= LEAST))
    sizes = read.groupBy(key).agg(F.sum(F.greatest(F.length(letters(F.col("text"))) - GRAM + 1, F.lit(0)).cast("long")).alias("size")).where("size > 0")
    languages = model.select("language", "least").distinct()
    # A sequence meets all its languages in one row; where those rows are few enough to broadcast, a text's sums are complete before the shuffle.
    each = cut(model.groupBy("gram").agg(F.collect_list(F.struct("language", "more")).alias("m")))
    met = read.select(key, F.explode(grams(F.col("text"))).alias("gram")).join(each, "gram")
    known = met.select(key, F.inline("m")).groupBy(key, "language").agg(F.sum("more").alias("more"))
    # Every language is scored for every text: their number is that of languages, a few.
    every = sizes.crossJoin(F.broadcast(languages)).join(known, [key, "language"], "left")
    score = F.col("size") * F.col("least") + F.coalesce("more", F.lit(0.0))
    best = every.groupBy(key).agg(F.min_by("language", F.struct(-F.round(score, 6), "language")).alias("best"))
    return rows.select(key, "hinted").join(best, key, "left").select(key, F.coalesce("hinted", "best").alias("language"), F.when(F.col("hinted").isNotNull(), 1.0).alias("confidence"))
