"""Likeness, excerpts, adapters, resampling and models against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import urls as U
from signalloom.functions import vocabulary as V
from signalloom.operators import adapter as A
from signalloom.operators import evaluation as X
from signalloom.operators import events as Y
from signalloom.operators import likeness as K
from signalloom.operators import models as M


def test_scores():
    assert K.token_sort_score("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert K.token_set_score("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert K.token_set_score("", "a") == 0 and K.token_set_score(None, "a") is None and K.token_sort_score("", "") == 100
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(70))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert K.common_length(a, b) == table[-1][-1]


def texts():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(150)]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(5, 40))) for _ in range(40)]
    for i in range(25):
        near = out[i].split()
        near[r.randrange(len(near))] = r.choice(words)
        out.append(" ".join(r.sample(near, len(near)) + [r.choice(words)] * (i % 2)))
    return [*out, out[3], out[50], out[3], None, "", "  "]


def test_near_duplicates(spark):
    rows = list(enumerate(texts()))
    follows = {}
    live = [(i, t) for i, t in rows if t and t.strip()]
    for i, t in live:
        first = next((j for j, u in live if j < i and j not in follows and K.token_set_score(u, t) >= 88), None)
        if first is not None:
            follows[i] = first
    df = spark.createDataFrame(rows, "k int, t string")
    assert {x.k: x.duplicate_of for x in K.near_duplicates(df, "k", "t", []).collect()} == follows and len(follows) > 20
    assert K.near_duplicates(df.limit(0), "k", "t", []).count() == 0
    more = df.select(F.concat(F.lit("u"), "k").alias("url"), "k", "t", F.lit("ok").alias("status"), F.lit(0.5).alias("confidence"), F.lit(None).cast("date").alias("published"), F.when(F.col("k") == 42, "primary_official").otherwise("forum").alias("source_type"))
    got = {x.k: (x.duplicate_of, x.trust_level) for x in Y.deduplicate_and_score(more, "url", "t", "k").collect()}
    assert len(got) == len(rows) and got[42] == (None, "high") and got[2] == (42, "unverified") and got[len(rows) - 2][1] == "low"


def plain_excerpt(text, title, words, limit):
    topic, found = words[title], []
    for m in re.finditer(r"[^\n.!?]+[.!?]?", text):
        quote = m.group().strip()
        shared = len(words.get(quote, set()) & topic)
        if 40 <= len(quote) <= limit and not re.search(V.EXCERPT_NOISE, quote, re.I) and shared >= min(2, max(1, len(topic))):
            found.append((-shared, m.start() + len(m.group()) - len(m.group().lstrip()), quote))
    chosen = []
    for _, start, quote in sorted(found):
        if len(chosen) < 2 and sum(len(q) for _, _, q in chosen) + len(quote) <= limit:
            chosen.append((start, start + len(quote), quote))
    return sorted(chosen)


def test_excerpt(spark):
    r = random.Random(2)
    vocabulary = ["quantum", "sensor", "laboratory", "cookie", "measured", "signal", "of", "the", "apple"]
    text = "".join(" ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 14))) + r.choice([". ", "!\n", "?  ", "\n"]) for _ in range(60))
    pieces = {m.group().strip() for m in re.finditer(r"[^\n.!?]+[.!?]?", text)}
    titles = ["Quantum sensor signal", "apple", "laboratory apple"]
    words = {x.p: set(x.w) for x in spark.createDataFrame([(p,) for p in [*pieces, *titles]], "p string").select("p", T.topic_words(F.col("p")).alias("w")).collect()}
    df = spark.createDataFrame([(text, t) for t in titles] + [(None, "apple"), ("", "apple")], "x string, t string")
    for limit in (1500, 120):
        got = df.select("x", "t", T.excerpt(F.col("x"), F.col("t"), limit).alias("e")).collect()
        for g in got[:3]:
            assert [tuple(e) for e in g.e] == plain_excerpt(text, g.t, words, limit) != []
            assert all(text[e.start : e.end] == e.quote for e in g.e)
        assert not got[3].e and not got[4].e


def test_addresses(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/2401.00001v2", "10.1000/AB.", "no"), (None, None, "https://a.example/x")], "a string, b string, c string")
    got = df.select(U.identity(F.col("a"), F.col("b")).alias("i"), U.safe_url(F.col("c")).alias("s"), U.source_links(F.lit("[a](https://Www.x.example/1) [b](ftp://q)")).alias("l")).collect()
    assert got[0].i == ["arxiv:2401.00001", "doi:10.1000/ab"] and got[0].s is None and got[1].i == [] and got[1].s == "https://a.example/x"
    assert [tuple(x) for x in got[0].l] == [("a", "https://Www.x.example/1", "x.example")]


def test_reviews(spark):
    documents = spark.createDataFrame([("d1", "one quote here", "t", "patent", "2026-01-02", False, False), ("d2", " ", "t", "forum", None, None, False)], "doc_id string, text string, title string, source_type string, published_at string, published_at_is_estimated boolean, is_generated_summary boolean")
    candidates = spark.createDataFrame([("c", ["d1", "d2", "d1", "d9"])], "candidate_id string, source_doc_ids array<string>")
    sources = A.adapt_sources(candidates, documents)
    assert [(x.source_id, x.place, x.source_type, x.published_at, x.warning) for x in sources.orderBy("place").collect()] == [("d1", 0, "patent", "2026-01-02", None), ("d2", 1, None, None, "Empty document: d2"), ("d9", 2, None, None, "Missing document: d9")]
    evidence = spark.createDataFrame([("c", "e1", "d1", "quote", False, False), ("c", "e2", "d2", "quote", False, False), ("c", "e3", "d1", "quote", True, False)], "candidate_id string, evidence_id string, doc_id string, quote string, is_future_looking boolean, is_generated_summary boolean")
    kind = "candidate_id string, evidence_id string, feature string, reviewer string, rationale string, event_status string"
    check = lambda *rows: A.review_errors(spark.createDataFrame([r for r in rows], kind), evidence, documents, sources)
    good = ("c", "e1", "relevance", "r", "why", "observed")
    (done,) = A.import_reviews(check(good)).collect()
    assert done.evidence_id == "e1:relevance" and done.source_id == "d1"
    bad = {("x", *good[1:]): "unknown_candidate", ("c", "e2", *good[2:]): "missing_evidence_or_source", ("c", "e9", *good[2:]): "missing_evidence_or_source", ("c", "e3", *good[2:]): "future_claim_as_observed", ("c", "e1", "other", *good[3:]): "unknown_feature", ("c", "e1", "relevance", " ", "why", None): "reviewer_and_rationale_required"}
    for row, error in bad.items():
        assert [x.error for x in check(row).collect()] == [error]
    with pytest.raises(ValueError, match="repeated_review"):
        A.import_reviews(check(good, good))
    notes = spark.createDataFrame([(1, "better")], "k int, v string")
    assert sorted(map(tuple, A.with_notes(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), notes, "k", ["v"]).collect())) == [(1, "better"), (2, "b")]


def test_evaluation(spark):
    one = spark.createDataFrame([(1, "likely_weak"), (2, "needs_review")], "k int, d string")
    two = spark.createDataFrame([(1, 1), (2, 0)], "k int, t int")
    assert X.one_to_one(one, two, "k").count() == 2
    for broken in (two.limit(1), two.union(two), two.union(spark.createDataFrame([(None, 1)], "k int, t int"))):
        with pytest.raises(ValueError):
            X.one_to_one(one, broken, "k")
    ranked = spark.createDataFrame([("a", "g", "weak", 3), ("b", "g", "weak", 5), ("c", None, "weak", 4), ("d", "g", "reject", 9)], "candidate_id string, technology_group_id string, decision string, score int")
    best, rest, summary = X.rank_report(ranked)
    assert [x.candidate_id for x in best.collect()] == ["b", "c"] and [x.candidate_id for x in rest.collect()] == ["a"]
    assert summary == {"requested_limit": 15, "insufficient_results": True, "counts": {"weak": 3, "reject": 1, "needs_review": 0}}
    for fault in (lambda: X.rank_report(ranked, 0), lambda: X.rank_report(ranked.union(ranked))):
        with pytest.raises(ValueError):
            fault()
    assert X.bootstrap_error(two.limit(0), "t", "k", "k").first().low is None


def test_ridge(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y, g = x @ [1.0, -0.3, 2.0] + r.normal(size=120) * 0.1, r.integers(0, 17, 120)
    df = spark.createDataFrame([(i, int(g[i]), *map(float, x[i]), float(y[i]), 7.0) for i in range(120)], "i int, g int, a double, b double, c double, y double, k double")

    def plain(rows, scaled, alpha):
        m, s = x[rows].mean(0), x[rows].std(0) if scaled else np.ones(3)
        z = (x[rows] - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[rows] - y[rows].mean())) / s
        return y[rows].mean() - w @ m, w

    for scaled, alpha in ((True, 10.0), (False, 1.0)):
        model, judged, report = M.ridge(df, ["a", "b", "c", "k"], "y", "g", alpha, scaled, -100, 100)
        intercept, weights = plain(np.arange(120), scaled, alpha)
        assert np.allclose([model["intercept"], *model["weights"].values()], [intercept, *weights, 0.0]) and model["deploy"] and report["rows"] == 120
        got = {q.i: q for q in judged.collect()}
        fold = np.array([got[i].fold for i in range(120)])
        assert all(len({fold[i] for i in np.flatnonzero(g == k)}) == 1 for k in set(g))
        for f in set(fold):
            b, w = plain(np.flatnonzero(fold != f), scaled, alpha)
            for i in np.flatnonzero(fold == f):
                assert abs(got[i].prediction - (b + w @ x[i])) < 1e-8 and abs(got[i].baseline - np.median(y[fold != f])) < 1e-9
    with pytest.raises(ValueError):
        M.ridge(df.limit(0), ["a"], "y", "g", 1.0, True, 0, 1)


def test_logistic(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 2))
    t = (x @ [1.5, -1.0] + r.normal(size=150) > 0.8).astype(int)
    got = M.balanced_logistic(spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, t)], "a double, b double, t int"), ["a", "b"], "t")
    z, s = np.c_[x, np.ones(150)], np.where(t == 1, 150 / (2 * t.sum()), 150 / (2 * (150 - t.sum())))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (s * p * (1 - p))) @ z + np.diag([1, 1, 0]), z.T @ (s * (p - t)) + [w[0], w[1], 0])
    assert np.allclose([*got["weights"].values(), got["intercept"]], w, atol=1e-4)


def test_balanced_folds(spark):
    """Whole groups; rows and ones within one group of even; the same folds whatever the partitions."""
    r = random.Random(8)
    rows = [(f"g{g}", int(r.random() < 0.2 + 0.5 * (g % 3 == 0))) for g in range(90) for _ in range(r.choice([1, 1, 2, 3, 8, 20]))] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, y int")
    found = {x.g: x.fold for x in M.balanced_folds(df, "g", "y", 4).collect()}
    assert found == {x.g: x.fold for x in M.balanced_folds(df.repartition(7), "g", "y", 4).collect()} and len(found) == 90
    sizes = [[sum(found[g] == k and y == want for g, y in rows if g) for k in range(4)] for want in (0, 1)]
    most = [max(sum(h == g and y == want for h, y in rows) for g in found) for want in (0, 1)]
    assert all(max(s) - min(s) <= m for s, m in zip(sizes, most, strict=True))
    assert M.balanced_folds(df.limit(0), "g").count() == 0


def test_judge_logistic(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 2))
    t = (x @ [2.0, -1.0] + 0.3 * r.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, i % 40, *map(float, x[i]), int(t[i])) for i in range(200)], "i int, g int, a double, b double, t int")
    judged, report = M.judge_logistic(df, ["a", "b"], "t", "g")
    rows = {q.i: q for q in judged.collect()}
    assert len(rows) == 200 and report["accuracy"] > 0.85 and set(report["rows"]) == {0, 1, 2}
    k = rows[0].fold
    model = M.balanced_logistic(df.where(~F.col("g").isin([q.g for q in rows.values() if q.fold == k])), ["a", "b"], "t")
    z = model["intercept"] + model["weights"]["a"] * x[0, 0] + model["weights"]["b"] * x[0, 1]
    assert abs(rows[0].probability - 1 / (1 + np.exp(-z))) < 1e-6
    with pytest.raises(ValueError):
        M.balanced_logistic(df.where("t = 1"), ["a"], "t")
