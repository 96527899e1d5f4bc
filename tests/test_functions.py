"""Text and URL functions and the rule engines on small rows."""

import pytest
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import urls as U
from signalloom.operators import documents as D
from signalloom.operators import evidence as E
from signalloom.operators import overlap as O


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTPS://WWW.Example.com/Article/?utm_source=tw&id=5", "https://example.com/Article?id=5"),
        ("https://example.com/Article?id=5#top", "https://example.com/Article?id=5"),
        ("http://example.com", "http://example.com/"),
        ("https://a.org/x?b=2&a=1&ref=z", "https://a.org/x?a=1&b=2"),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, url, U.normalize_url) == expected
    assert one(spark, expected, U.normalize_url) == expected


@pytest.mark.parametrize("host,kind", [("notarxiv.org", "general_media"), ("arxiv.org.other.example", "general_media"), ("www.arxiv.org", "academic"), ("github.com", "code_repository"), ("a.github.com", "general_media"), ("x.uspto.gov", "primary_official")])
def test_source_type(spark, host, kind):
    assert one(spark, f"https://{host}/a", U.source_type)["type"] == kind


@pytest.mark.parametrize("value,expected", [("10.1234/AbC.", "doi:10.1234/abc"), ("https://doi.org/10.1234/x", "doi:10.1234/x"), ("https://arxiv.org/abs/2401.00001v2", "arxiv:2401.00001"), ("https://example.org/10.1234/x", None)])
def test_work_id(spark, value, expected):
    assert one(spark, value, U.work_id) == expected


def test_partial_dates(spark):
    assert [one(spark, x, T.complete_date) for x in ("2026", "2026-06", "June 2026")] == [None] * 3
    assert str(one(spark, "2026-06-03T10:00", T.complete_date)) == "2026-06-03"


def test_sentences_and_future(spark):
    text = "The first prototype was shown. It will launch next year! ok. Tiny."
    assert one(spark, text, T.sentences) == ["The first prototype was shown.", "It will launch next year! ok."]
    assert one(spark, "It will launch", T.future_looking) and not one(spark, "willow trees", T.future_looking)


def test_sentences_keep_digits_and_lose_spaces(spark):
    text = "\xa0  0997 is where the text begins.\n1 comes second. 1 Out of 31 pieces is 1.  The last sentence ends in 2\u3000 "
    assert one(spark, text, T.sentences) == ["0997 is where the text begins.\n1 comes second. 1 Out of 31 pieces is 1.", "The last sentence ends in 2"]
    assert one(spark, "This one is whole.\x0bNo cut at that sign. \n", T.sentences) == ["This one is whole.\x0bNo cut at that sign. \n"]
    assert one(spark, None, T.sentences) is None


def test_query_variants(spark):
    assert one(spark, " swarm ", T.query_variants) == ["swarm", "swarm prototype", "swarm pilot", "swarm preprint"]
    assert one(spark, "рой", T.query_variants)[1] == "рой прототип"
    assert one(spark, " ", T.query_variants) == []


def flags(spark, **on):
    names = ["early_stage", "limited_adoption", "mass_adoption", "industry_standard", "relevance"]
    return E.automatic_decision(spark.createDataFrame([tuple(on.get(n, False) for n in names)], ", ".join(f"{n} boolean" for n in names))).first()


def test_automatic_decision(spark):
    assert flags(spark, early_stage=True, limited_adoption=True, relevance=True)["decision"] == "likely_weak"
    assert flags(spark, mass_adoption=True, relevance=True)["decision"] == "likely_mature"
    got = flags(spark, mass_adoption=True, relevance=True, early_stage=True)
    assert (got["decision"], got["reason"], got["score"]) == ("needs_review", "conflicting_stage_claims", 60)


def test_confirmations(spark):
    rows = [("c", 1, "e1", "a", "academic"), ("c", 2, "e1", "b", "general_media"), ("c", 3, "e2", "d", "personal_blog")]
    df = spark.createDataFrame(rows, "cand string, doc_id int, cluster string, domain string, source_type string").withColumn("duplicate_of", F.lit(None))
    assert tuple(D.confirmations(df, "cand").first()) == ("c", 1, 2)


def test_merge_documents(spark):
    state = spark.createDataFrame([("u", "old", "c1", "c1"), ("v", "same", "c1", "c1")], "k string, p string, first_seen string, last_seen string")
    new, versions = D.merge_documents(state, spark.createDataFrame([("u", "new"), ("w", "first")], "k string, p string"), "k", "p", "c2")
    assert sorted(map(tuple, new.collect())) == [("u", "new", "c1", "c2"), ("v", "same", "c1", "c1"), ("w", "first", "c2", "c2")]
    assert [tuple(r) for r in versions.collect()] == [("u", "old", "c2")]


def test_components_are_transitive(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (3, 4)], "a long, b long")
    assert dict(map(tuple, O.components(edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}


def test_overlap_needs_eight_tokens(spark):
    text = "one two three four five six seven eight nine"
    df = spark.createDataFrame([(1, text), (2, text), (3, "one two three")], "doc_id int, text string")
    rows = O.shingles(df, "doc_id", "text")
    assert [tuple(r) for r in O.containment_pairs(rows, rows, same=True).collect()] == [(1, 2, 1.0)]


def test_topic_match_in_two_languages(spark):
    from signalloom.operators import documents as D

    rows = spark.createDataFrame([(1, "квантовыми сенсорами"), (2, "quantum sensors at work"), (3, "other words"), (4, None)], "i int, t string")
    hit = lambda **k: {r[0] for r in rows.where(D.topic_match(rows.t, ["квантовые", "сенсоры"], **k)).collect()}
    assert hit(bilingual=True) == {1, 2} and hit() == set()


def test_containment_pairs_are_all_found(spark):
    import random

    from signalloom.operators import overlap as O

    r = random.Random(5)
    base = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b[: r.randint(20, 60)] + [f"x{r.randrange(9)}" for _ in range(r.randint(0, 12))]) + " same tail for every text here" for b in base for _ in range(6)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in enumerate(texts)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * min(len(sets[a]), len(sets[b]))}
    rows = O.shingles(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t")
    assert {(x.a, x.b) for x in O.containment_pairs(rows, rows, same=True).collect()} == want and want
    cross = O.containment_pairs(rows.where("doc < 18"), rows.where("doc >= 18"))
    assert {(x.a, x.b) for x in cross.collect()} == {p for p in want if p[0] < 18 <= p[1]}


def test_unknown_dates_pass(spark):
    from signalloom.operators import documents as D

    docs = spark.sql("SELECT * FROM VALUES (1, date'2026-01-01'), (2, date'2026-01-08'), (3, date'2026-03-01'), (4, null) AS t(doc, at)")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    assert {(x.a, x.b) for x in D.within_days(pairs, docs, "doc", "at", 10).collect()} == {(1, 2), (1, 4)}


def test_complete_date(spark):
    rows = [("2026-01-02", True), ("2026-01-02T03:04", True), ("2026-01-02 03:04", True), ("2026-01-02garbage", False), ("2026-01", False), ("2026-13-40", False), (None, False), ("", False)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("ok", T.complete_date(F.col("t")).alias("d")).collect()
    assert all((r["d"] is not None) == r["ok"] and (not r["ok"] or str(r["d"]) == "2026-01-02") for r in got)


def test_token_features_of_a_long_text(spark):
    """20,000 words: the words are found once, not once a word."""
    import time

    from signalloom.operators.evaluation import token_features

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)), None)], "t string, d string")
    df.select(F.size(token_features(F.col("d"), F.col("d")))).collect()
    began = time.time()
    assert df.select(F.size(token_features(F.col("t"), F.col("d"))).alias("n")).first()["n"] == 20_001 and time.time() - began < 30
