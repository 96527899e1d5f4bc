"""Bilingual terms, claims of raw texts, leader clusters, payloads and sinks on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.functions import terms
from signalloom.operators import gates as G
from signalloom.sources import payloads as P
from signalloom.sources import sinks


def test_terms(spark):
    df = spark.createDataFrame([("квантовые сенсоры для AI",), ("квантовые хомяки",), ("plain words",), (None,)], "q string")
    got = [r.e for r in df.select(terms.search_equivalent(F.col("q")).alias("e")).collect()]
    assert got == ["quantum sensor ai", "квантовые хомяки", "plain words", None]
    row = df.select(terms.expand(F.array(F.lit("датчики"), F.lit("сенсоры"), F.lit("robot"))).alias("e")).first()
    assert row.e == ["sensor", "robot"]
    names = spark.createDataFrame([("we met Acme Deep Robotics and Foo Inc. today", "Beta Raises $5M"), (None, None)], "a string, b string").select(terms.companies(F.col("a"), F.col("b")).alias("n")).collect()
    assert names[0].n == ["Acme Deep Robotics", "Beta", "Foo Inc"] and names[1].n == []
    assert df.limit(1).select(terms.subject_terms(F.lit("The Prototype of 2024 quantum Sensors, quantum")).alias("t")).first().t == ["2024", "quantum", "sensors"][1:]


def sources(spark, rows):
    base = {"source_type": "research", "trust_level": "high", "trust_reason": "x", "is_generated": False, "is_translated": False, "text_scope": None, "published_at": "2026-05-01"}
    kind = "id string, title string, text string, source_type string, trust_level string, trust_reason string, is_generated boolean, is_translated boolean, text_scope string, published_at string"
    names = [c.split()[0] for c in kind.split(", ")]
    return spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], kind)


def claims(spark, text, **more):
    df = sources(spark, [{"id": "s", "title": "Quantum sensors", "text": text} | more])
    out = G.automatic_claims(df, "id", F.array(F.lit("quantum"), F.lit("sensor")), "2026-06-30")
    return {(r.feature, r.reason): (r.start, r.quote) for r in out.collect()}


def test_claims(spark):
    text = "Intro to it.  We demonstrate a quantum sensor prototype. It is limited to a laboratory in our work."
    got = claims(spark, text)
    assert set(got) == {("relevance", None), ("early_stage", None), ("limited_adoption", None)}
    assert all(text[a : a + len(q)] == q for a, q in got.values())
    assert ("early_stage", "negated_claim") in claims(spark, "We have no quantum sensor prototype here.")
    assert ("early_stage", "future_or_modal_claim") in claims(spark, "We will build a quantum sensor prototype.")
    assert ("early_stage", "stale_positive_evidence") in claims(spark, "We have a quantum sensor prototype.", published_at="2020-01-01")
    assert ("limited_adoption", "negated_limitation") in claims(spark, "Our quantum sensor is not limited to a laboratory.")
    assert claims(spark, "Unlike the quantum sensor prototype of old, we differ.") == {}
    split = claims(spark, "We have a quantum sensor prototype, but future devices will be in mass production.")
    assert ("early_stage", None) in split
    for more in ({"trust_level": "low"}, {"text_scope": "search_snippet"}, {"published_at": "2027-01-01"}, {"published_at": None}, {"title": "Cats"}):
        assert claims(spark, text, **more) == {}
    assert claims(spark, None) == {} and claims(spark, "") == {}
    adjacent = claims(spark, "A quantum sensor is one kind of tool. Research in this field has relied on simulations.")
    assert ("early_stage", None) in adjacent


def test_leaders(spark):
    r = random.Random(3)
    pairs = {(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(90)) if a < b}
    expected = {}
    for b in range(40):
        first = min((a for a in range(b) if (a, b) in pairs and a not in expected), default=None)
        if first is not None:
            expected[b] = first
    got = G.leaders(spark.createDataFrame(sorted(pairs), "a int, b int"))
    assert {x.node: x.leader for x in got.collect()} == expected
    assert G.leaders(spark.createDataFrame([], "a int, b int")).count() == 0


def test_payloads(spark):
    df = lambda s: spark.createDataFrame([(s,), (None,), ("{broken",)], "payload string")
    (hit,) = P.hackernews(df('{"hits":[{"objectID":"7","url":"","title":"t"}]}')).collect()
    assert hit.url.endswith("id=7") and hit.published_at is None and hit.text_scope == "search_snippet"
    hits = P.gdelt(df('{"articles":[{"url":"u","title":"t","seendate":"20260102T030405Z"},{"url":"v","title":"t","seendate":"soon"}]}')).collect()
    assert [str(h.published_at) for h in hits] == ["2026-01-02 03:04:05", "None"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "k int, v string")
    where = f"{tmp_path}/snap"
    assert sinks.persist_snapshot(df, where) and not sinks.persist_snapshot(df.orderBy(F.desc("k")), where)
    with pytest.raises(ValueError):
        sinks.persist_snapshot(df.distinct(), where)
    sinks.export_lines(df, f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect())[0] == '{"k":1,"v":null}'
    sinks.write_run({"t": df}, f"{tmp_path}/run")
    assert sinks.manifest(spark, f"{tmp_path}/run").count() >= 1
    with pytest.raises(Exception, match="exist"):
        sinks.write_run({"t": df}, f"{tmp_path}/run")
