"""Phrase and proximity search by the positional index against plain versions."""

import os
import random
from collections import Counter

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from signalloom.llm import decontamination

DIR = "/root/testdata/sf0.001"
KEYS = ["id", "n_words", "n_hit", "n_items"]


def made(seed, n_docs, n_items):
    """Texts of few words, so that windows overlap, repeat and share their terms; with pieces of the items inside."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "of", "a", "7", "é", "Éa", "x", "rare%d" % r.randint(0, 40)])
    items = [(r.randint(0, n_items) or None, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 9, 10, 11, 25])))) for _ in range(n_items)]
    items += [(99, None), (98, ""), (97, " - !"), (96, "the " * 12), items[0], (95, items[1][1])]
    docs = []
    for k in range(n_docs):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 5))
            text += " .\n" + ", ".join(w[a : a + r.choice([3, 9, 10, 11, 30])])
        docs.append((k % 50 or None, text))
    return [*docs, (1, None), (2, ""), docs[3], docs[3], (4, "THE " * 40), (5, "a " * 3000)], items


def run(spark, docs, items, **more):
    clash = {c: F.lit(1) for c in ("id", "doc", "pos", "term", "word", "w", "item")}
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    return decontamination.decontaminate(a, b, **more).collect()


@pytest.mark.parametrize("few", [0, 500_000])
def test_odd_rows(spark, few):
    """With broadcasts and, beyond their bound, with shuffled joins alone."""
    docs, items = made(few, 120, 40)
    before, decontamination.BROADCAST_ROWS = decontamination.BROADCAST_ROWS, few
    try:
        got = run(spark, docs, items)
    finally:
        decontamination.BROADCAST_ROWS = before
    found = Counter((x["id"], x["n_words"], x["n_hit"], len(x["items"]), brute.sha(",".join(x["items"]))) for x in got)
    want = brute.decontaminated(docs, items)
    assert found == Counter(want) and sum(x[2] > 0 for x in want) > 20


def test_few_rows(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert [(x["n_words"], x["n_hit"], x["items"]) for x in run(spark, [(1, "a b")], [])] == [(2, 0, [])]
    assert [(x["n_hit"], x["items"]) for x in run(spark, [(1, "x A-B c")], [(None, "a b"), (2, "b c d")])] == [(2, [""])]


def test_long_text(spark):
    """A megabyte of one word, in which every start matches."""
    got = run(spark, [(1, "the " * 300_000), (2, "the of")], [(1, "the " * 15), (2, "the of")])
    assert {x["id"]: (x["n_hit"], x["items"]) for x in got} == {1: (300_000, ["1"]), 2: (2, ["2"])}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_query(spark):
    got = sorted(map(tuple, decontamination.op11_decontamination(spark, DIR).collect()))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert got == sorted(c.sql(decontamination.ORACLES["op11_decontamination"]).fetchall())
    docs, items = (c.sql(f"SELECT * FROM (SELECT {i}, text FROM {t})").fetchall() for i, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert [x[:5] for x in got] == sorted(brute.decontaminated(docs, items)) and any(x[5] for x in got)


@pytest.mark.parametrize("within", [1, 3, 8])
def test_nearby(spark, within):
    docs, items = made(within, 60, 25)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    items = [(k, t) for k, (_, t) in enumerate(items)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.near_items(a, b, within).collect()
    assert len(got) == len({(x["id"], x["item"]) for x in got}) and all(x["n_places"] > 0 <= x["first_place"] for x in got)
    assert {(x["id"], int(x["item"])) for x in got} == brute.nearby(docs, items, within)
