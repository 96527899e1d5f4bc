"""A text classifier on word and word-pair weights, judged out of fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalloom.functions import text as T
from signalloom.operators.models import balanced_folds
from signalloom.operators.tables import cut

WORD = r"(?U)\b\w\w+\b"


def word_pairs(text: Column) -> Column:
    """Words of two signs or more in lower case, then neighbouring pairs; null texts have none."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    rest = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))
    pairs = lambda w: F.concat(w, F.filter(F.zip_with(w, rest(w), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull()))
    return F.transform(F.array(words), pairs)[0]


def term_counts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, n): occurrences, counted before the shuffle."""
    return df.select(doc, F.explode(word_pairs(F.col(text))).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, doc: str, documents: int, most: int = 5000) -> DataFrame:
    """(term, idf) of the ``most`` most frequent terms, the first by code points of equals: ln((1 + documents) / (1 + df)) + 1."""
    terms = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = terms.orderBy(F.desc("total"), "term").limit(most)
    return kept.select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def frequent_terms(df: DataFrame, text: str, documents: int, most: int = 5000, buckets: int = 1 << 18) -> DataFrame:
    """vocabulary() of the rows (text), one a document, without a shuffle of every document's terms.

    Totals of hash buckets come first: no term of a bucket exceeds its bucket's.  The ``most`` commonest single words alone set a
    total that the last term of the vocabulary reaches at least, so terms of smaller buckets are gone before they
    are counted.  The counts of the others are exact.
    """
    # Sorted, equal terms stand together: the first of them counts the document.
    once = T.once(F.array_sort(word_pairs(F.col(text))), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get(w, i - 1) != x), 1).otherwise(0).alias("new"))))
    rows = df.select(F.inline(once)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")))
    words = rows.where(~F.col("term").contains(" ")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    least = words.orderBy(F.desc("total")).limit(most).agg(F.count(F.lit(1)), F.min("total")).first()
    full = sizes.where(F.col("size") >= (least[1] if least[0] == most else 0)).select("bucket")
    kept = rows.join(F.broadcast(full), "bucket").groupBy("term").agg(F.count(F.lit(1)).alias("total"), F.sum("new").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    return kept.select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def known_counts(df: DataFrame, doc: str, text: str, terms: DataFrame) -> DataFrame:
    """term_counts() of the vocabulary's terms only: others are gone before the shuffle.  ``doc`` is unique or its rows count as one document."""
    each = df.select(doc, F.explode(word_pairs(F.col(text))).alias("term")).join(F.broadcast(terms.select("term")), "term", "left_semi")
    return each.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"))


def weighted(counts: DataFrame, terms: DataFrame, doc: str) -> DataFrame:
    """(doc, term, weight): (1 + ln n) idf, each document brought to length 1; documents without a known term have no row.

    ``terms`` holds the vocabulary, at most a few thousand rows by its parameter, and is broadcast.
    """
    raw = counts.join(F.broadcast(terms), "term").withColumn("w", (1.0 + F.log("n")) * F.col("idf"))
    norms = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, doc).select(doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def fit_text(df: DataFrame, doc: str, text: str, label: str, most: int = 5000, c: float = 1.0) -> dict:
    """Vocabulary with idf and weight, and the intercept, of a logistic model with classes weighted to equal sums.

    Rows without a label are left out; a missing class is an error.  What reaches the driver is the model.  A document's
    vector holds its own terms only: it is written as the columns of a sparse vector and read as one.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    rows = df.where(F.col(label).isNotNull()).select(doc, text, F.col(label).cast("double").alias("_y"))
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(F.col("_y").cast("int"))).first()
    if not ones or ones == n:
        raise ValueError("both classes are needed")
    counts = term_counts(rows, doc, text)
    terms = sorted((r.term, r.idf) for r in vocabulary(counts, doc, n, most).collect())
    table = df.sparkSession.createDataFrame([(t, i, k) for k, (t, i) in enumerate(terms)], "term string, idf double, place int")
    placed = weighted(counts, table.select("term", "idf"), doc).join(F.broadcast(table.select("term", "place")), "term")
    own = placed.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("m"))
    none = F.array().cast("array<struct<place:int,weight:double>>")
    weight = F.when(F.col("_y") == 1, n / (2.0 * ones)).otherwise(n / (2.0 * (n - ones)))
    listed = rows.select(doc, "_y").join(own, doc, "left").withColumn("m", F.coalesce("m", none))
    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(terms)).alias("size"), F.transform("m", lambda x: x["place"]).alias("indices"), F.transform("m", lambda x: x["weight"]).alias("values"))
    ready = cut(listed.select("_y", weight.alias("_w"), parts.alias("_x")), StructType().add("_y", "double").add("_w", "double").add("_x", VectorUDT()))
    fitted = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-9).fit(ready)
    return {"intercept": float(fitted.intercept), "terms": {t: (i, float(w)) for (t, i), w in zip(terms, fitted.coefficients)}}


def apply_text(df: DataFrame, model: dict, doc: str, text: str) -> DataFrame:
    """(doc, probability) of class 1; a text without a known term has the intercept's."""
    terms = df.sparkSession.createDataFrame([(t, i, w) for t, (i, w) in model["terms"].items()], "term string, idf double, beta double")
    found = weighted(term_counts(df, doc, text), terms.select("term", "idf"), doc).join(F.broadcast(terms.select("term", "beta")), "term")
    sums = found.groupBy(doc).agg(F.sum(F.col("weight") * F.col("beta")).alias("z"))
    margin = F.coalesce("z", F.lit(0.0)) + F.lit(model["intercept"])
    return df.select(doc).join(sums, doc, "left").select(doc, (1.0 / (1.0 + F.exp(-margin))).alias("probability"))


def judge_text(df: DataFrame, doc: str, text: str, label: str, group: str, folds: int = 3, most: int = 5000) -> DataFrame:
    """(doc, fold, label, probability, predicted, majority): whole groups held out in balanced folds, the vocabulary fitted inside the other folds."""
    rows = df.where(F.col(label).isNotNull() & F.col(group).isNotNull())
    rows = cut(rows.join(balanced_folds(rows, group, label, folds), group))
    out = None
    for k in range(folds):
        rest, own = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if own.isEmpty():
            continue
        share = rest.agg(F.avg(F.col(label).cast("double"))).first()[0]
        found = apply_text(own, fit_text(rest, doc, text, label, most), doc, text)
        part = own.select(doc, "fold", F.col(label).alias("label")).join(found, doc)
        part = part.select("*", (F.col("probability") > 0.5).cast("int").alias("predicted"), F.lit(int(share > 0.5)).alias("majority"))
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no labelled rows")
    return out
