"""Candidates and saved answers against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from signalloom.functions import vocabulary as V
from signalloom.operators import candidates as C
from signalloom.operators import likeness as K
from signalloom.sources import answers as W
from signalloom.sources import sinks as S


def test_cluster_candidates(spark):
    """The rule as a loop over all documents and all clusters before them."""
    r = random.Random(3)
    names = ["".join(r.choice("abcdefghijkl") for _ in range(r.randrange(4, 10))) for _ in range(60)]
    rows = []
    for i in range(70):
        words = rows[r.randrange(i)][1].split() if i and r.random() < 0.5 else r.sample(names, 8)
        if r.random() < 0.6:
            words[r.randrange(8)] = r.choice(names)
        ids = [f"doi:{r.randrange(12)}"] if r.random() < 0.2 else []
        rows.append((i, " ".join(words), ids))
    rows.append((70, None, None))
    clusters, expected = [], {}
    for i, key, ids in rows:
        key, ids = key or "", set(ids or [])
        at = next((k for k, c in enumerate(clusters) if ids & c["ids"]), None)
        if at is None:
            scores = [K.token_sort_score(key, c["key"]) for c in clusters]
            at = scores.index(max(scores)) if scores and max(scores) >= 85 else None
        if at is None:
            clusters.append({"key": key, "ids": set(), "first": i})
            at = len(clusters) - 1
        clusters[at]["ids"] |= ids
        expected[i] = clusters[at]["first"]
    df = spark.createDataFrame(rows, "doc_id long, key string, ids array<string>")
    got = {x.doc_id: x.leader for x in C.cluster_candidates(df, "doc_id", "key", "ids").collect()}
    assert got == expected and 10 < len(set(got.values())) < 71
    assert C.cluster_candidates(df.limit(0), "doc_id", "key", "ids").count() == 0


def test_companies(spark):
    texts = ["Today Blue Sky Robotics met Älgen Labs.", None, "Nothing here", "Q Systems; R Systems; S Systems; T Systems; U Systems; V Systems; W Systems"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "cand long, text string")
    keyed = df.select("cand", C.terms.companies(F.col("text"), F.lit("Acme Raises money")).alias("found"))
    got = {x.cand: x.companies for x in C.distinct_companies(keyed, "cand", "found").collect()}
    word = r"[A-ZА-Я][\w&.\-]*"
    for cand in (0, 1):
        names = {"Acme"}
        for t in texts[2 * cand : 2 * cand + 2]:
            found = {m for s in V.ORGANISATION_SUFFIXES for m in re.findall(rf"\b({word}(?:\s+{word}){{0,3}}\s+{re.escape(s)})\b", (t or "") + " Acme Raises money")}
            names |= set(sorted(found | {"Acme"})[:6])
        assert got[cand] == sorted(names)[:6]
    assert C.distinct_companies(keyed.limit(0), "cand", "found").count() == 0


def test_build_empty_texts(spark):
    kind = "cand string, doc_id long, title string, text string, domain string, source_type string, cluster long, duplicate_of long"
    rows = [("a", 1, None, None, None, "forum", None, None), ("a", 2, "", "", "x", "forum", 1, 1), ("b", 3, " T ", "The text", "y", "academic", 2, None)]
    out = {x.cand: x for x in C.build_candidates(spark.createDataFrame(rows, kind), "cand", "doc_id", {"k": ["the"]}, "topic").collect()}
    assert out["a"].technology_name == "topic" and out["a"].lowest_trust_only and out["a"].companies == [] and out["a"].documents == 2
    assert out["b"].technology_name == "T" and out["b"].category == "k" and not out["b"].lowest_trust_only
    assert out["a"].candidate_id.startswith("cand_") and len(out["a"].candidate_id) == 29


def test_atom(spark):
    assert W.atom_query("glass fibre", ("2025-01-02", "2025-03-04")) == '(all:"glass" AND all:"fibre") AND submittedDate:[202501020000 TO 202503042359]'
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
    <entry><id>http://arxiv.org/abs/2401.00001v1</id><title>One</title><summary> Text &amp; more </summary><published>2024-01-02T03:04:05Z</published></entry>
    <entry><id></id><title>no id</title></entry><entry><id>http://arxiv.org/abs/2401.00002</id><title>Two</title><published>bad</published></entry></feed>"""
    one = feed.split("<entry>")[0] + "<entry>" + feed.split("<entry>")[1] + "</feed>"
    out = W.atom(spark.createDataFrame([(feed,), (one,)], "payload string")).orderBy("url").collect()
    assert [(x.url[-7:], x.title, x.snippet) for x in out] == [("00001v1", "One", "Text & more")] * 2 + [("1.00002", "Two", None)]
    assert str(out[0].published_at) == "2024-01-02 03:04:05" and out[2].published_at is None


@pytest.mark.parametrize(
    ("content", "kind", "text"),
    [
        (b"\xef\xbb\xbf{}", "application/json", "{}"), ("прив".encode("cp1251"), "text/html; charset=windows-1251", "прив"), ('<meta charset="koi8-r">ж'.encode("koi8-r"), "text/html", '<meta charset="koi8-r">ж'),
        ("é".encode(), "text/plain; charset=nonsense", "é"), (b"\xe9", "text/plain", "é"), (b"\xff", "application/json", None), (None, None, None), (b"", None, ""),
    ],
)
def test_decode(content, kind, text):
    assert W.decode_bytes(content, kind) == text


def test_decoded_column(spark):
    df = spark.createDataFrame([(1, bytearray("ж".encode("cp1251")), "text/html; charset=cp1251"), (2, None, None)], "id long, c binary, k string")
    assert [x.t for x in df.select("id", W.decoded(F.col("c"), F.col("k")).alias("t")).orderBy("id").collect()] == ["ж", None]


def test_small_rules(spark):
    row = spark.createDataFrame([("<p>a<!-- x --> b</p>&amp;c", "1 < 2", "plain  text", None)], "a string, b string, c string, d string")
    assert list(row.select(*[W.strip_tags(F.col(c)) for c in "abcd"]).first()) == ["a b &c", "1 < 2", "plain  text", None]
    words = {"en": ["the"], "de": ["die"]}
    texts = [("the die and so on, the end", None, "en"), ("short", None, None), ("это русский текст без слов", None, "ru"), ("x", "DE-at", "de"), (None, None, None), ("zzzz " * 9, "", None)]
    df = spark.createDataFrame([(i, t, h) for i, (t, h, _) in enumerate(texts)], "i long, t string, h string").orderBy("i")
    assert [x.l for x in df.select(W.detect_language(F.col("t"), F.col("h"), words)["language"].alias("l")).collect()] == [x for *_, x in texts]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1}, {"a": None}], indent=1))
    assert sorted(str(x.a) for x in W.replay(spark, str(tmp_path / "r.json")).collect()) == ["1", "None"]
    (tmp_path / "l.csv").write_text("﻿id,label\n1,yes\n2,\n3,  \n4,no\n", encoding="utf-8")
    assert [(x.id, x.label) for x in W.label_rows(spark, str(tmp_path / "l.csv"), "label").orderBy("id").collect()] == [("1", "yes"), ("4", "no")]
    df = spark.range(3)
    S.review_pack({"pending": df}, str(tmp_path / "pack"))
    S.review_pack({"pending": spark.range(9)}, str(tmp_path / "pack"))
    assert spark.read.csv(str(tmp_path / "pack" / "pending"), header=True).count() == 3
    S.export_csv(df, str(tmp_path / "csv"))
    with pytest.raises(Exception, match="(?i)already exists"):
        S.export_csv(df, str(tmp_path / "csv"))
