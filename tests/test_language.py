"""The language model against held-out texts and odd rows; its query is held against SQL."""

import os

import pytest
from pyspark.sql import functions as F

from signalloom.operators import language as N

DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text")
    held = F.col("doc_id") % 5 == 0
    found = N.detect(rows.where(held & (F.length("text") >= 100)), "doc_id", "text", N.train(rows.where(~held), "doc_id", "text", "lang"))
    got = found.join(rows.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("language")).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).first()
    assert got["n"] > 100 and got["share"] > 0.95, got


def test_odd_rows(spark):
    known = spark.createDataFrame([(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und der vogel", "de"), (3, None, "fr"), (4, "x y", None)], "k int, t string, lang string")
    model = N.train(known, "k", "t", "lang")
    rows = [(1, "the dog and the cat and the dog", None), (2, "und der hund und die katze", None), (3, "the", None), (4, None, None), (5, "1234567890123456789012345", None), (6, "the", " RUS"), (7, "日本語日本語日本語日本語日本語日本語日本語", None)]
    got = {r["k"]: (r["language"], r["confidence"]) for r in N.detect(spark.createDataFrame(rows, "k int, t string, h string"), "k", "t", model, F.col("h")).collect()}
    assert got[1] == ("en", None) and got[2] == ("de", None) and got[3] == got[4] == got[5] == (None, None) and got[6] == ("ru", 1.0) and got[7][0] in ("de", "en")
    assert N.detect(known.limit(0), "k", "t", model).count() == 0


def test_sequences_are_found_in_one_pass(spark):
    texts = ["Ab1cd\U0001d400\U0001d401é", "a", "", None, "xx\nyy"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", N.grams(F.col("t")).alias("g"), N.letters(F.col("t")).alias("l")).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["g"] == (None if t is None else [r["l"][i : i + 3] for i in range(len(r["l"]) - 2)])
