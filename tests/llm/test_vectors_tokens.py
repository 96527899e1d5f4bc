"""Whitening and alignment of tokenizers against plain versions."""

import os
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from signalloom.llm import alignment, whitening

DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
KEYS = ["id", "n_a", "n_b", "n_groups", "links", "best", "counts", "groups_sha256"]


@tables
def test_whitening(spark):
    got = whitening.op13_whitening(spark, DIR).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, w, share = brute.whitened(np.stack(rows["embedding"]))
    mine = got["whitened"].to_numpy().reshape(-1, 8)
    sign = np.sign((mine * w).sum(0))
    assert np.abs(mine * sign - w).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:8] - share).max() < 1e-12
    exact = [sum((len(x) * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(0), strict=True)) for r in x]
    assert got["deviation"].to_numpy()[::8].tolist() == exact and got["deviation_exact"].iloc[0] == exact[0]
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9 and set(got["n"]) == {len(x)}


def test_whitening_odd_rows(spark):
    r = random.Random(1)
    own = [(i % 7 or None, [r.gauss(0, 1), r.gauss(0, 3), r.gauss(1, 0.1)]) for i in range(40)]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [1.0, float("inf"), 2.0]), (6, [1.0, 2.0])]
    clash = {c: F.lit(1) for c in ("id", "x", "v", "n", "whitened")}
    df = spark.createDataFrame([*own, own[0], *bad], "vec_id long, embedding array<float>").withColumns(clash)
    out = whitening.whiten(df, k=2).collect()
    assert Counter(x["id"] for x in out) == Counter(i for i, _ in [*own, own[0]])
    _, w, _ = brute.whitened(np.array([v for _, v in [*own, own[0]]], np.float32), 2)
    mine = np.array([x["whitened"] for x in out])
    assert np.abs(np.sort(np.abs(mine), 0) - np.sort(np.abs(w), 0)).max() < 1e-6
    assert out[0]["identity_error"] < 1e-9
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        flat = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
        assert {tuple(x["whitened"]) for x in flat} == {(0.0, 0.0)} and flat[0]["deviation"] == 0 and flat[0]["identity_error"] == 1
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_of_wide_numbers(spark):
    rows = [(i, [1e30 if i % 2 else -1e30, float(i)]) for i in range(4)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[(1 if i % 2 else -1) * (1 << 30) + 100_000, i * 1024 + 100_000] for i in range(4)]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {o["id"]: int(o["deviation"]) for o in out} == {i: sum((4 * c - t) ** 2 for c, t in zip(r, s, strict=True)) for i, r in enumerate(x)}


@tables
def test_alignment(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, alignment.op12_alignment(spark, DIR).collect())) == sorted(brute.alignment(docs, A, B))


def test_alignment_odd_rows(spark):
    """Marks, special tokens, characters that B changes, long white space, unbroken text; many small blocks."""
    r = random.Random(3)
    parts = ["ab", "  ", "\n", "é", "don't", "12", "<|endoftext|>", "\x01", " ", "!?", "İ", "́", "<s>", "<0x41>", "　", "​", "the ", "日本"]
    rows = [(i, "".join(r.choice([*parts, "z" * r.randint(1, 30), f" w{r.randint(0, 9)} "]) for _ in range(r.randint(0, 80)))) for i in range(200)]
    rows += [(None, None), (1, ""), (1, " " * 6000 + "a"), (2, "z" * 30_000), (2, "z" * 30_000), (5, "  \n\t "), (6, "a ▁ b"), (7, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "block", "grp", "a", "times")})
    before, alignment.BLOCK_BYTES = alignment.BLOCK_BYTES, 500
    try:
        found = alignment.align(df.repartition(3), keep_groups=True)
        got = found.documents().collect()
    finally:
        alignment.BLOCK_BYTES = before
    assert Counter(tuple(x[k] for k in KEYS) for x in got) == Counter(brute.alignment(rows, A, B))
    assert all(brute.sha(x["groups"]) == x["groups_sha256"] for x in got if x["n_groups"])
    groups = found.groups.collect()
    assert sum(g["times"] for g in groups) == sum(x["n_groups"] for x in got) and all(1 <= g["docs"] <= g["times"] for g in groups)
    assert found.pairs("docs").where("best").groupBy("b").count().count() == found.pairs().select("b").distinct().count()
    assert alignment.align(df.limit(0)).documents().count() == 0


def test_alignment_by_blocks_or_library():
    """Small blocks, and the library in place of merges by rank, give the same groups."""
    assert alignment.ranks_hold(A)
    texts = ["the cat sat " * 50, "", "don't <|endoftext|>", "zzzz" * 9 + "  \n x"]
    fast, slow = (alignment.Block(alignment.Codec(A, B, by_rank), texts) for by_rank in (True, False))
    assert fast.names == slow.names and fast.numbers.tolist() == slow.numbers.tolist() and fast.times.tolist() == slow.times.tolist()
    assert fast.docs.max() <= 3 and fast.n_a.tolist() == slow.n_a.tolist()


def test_colliding_hashes():
    """Numbering stays exact when different keys share a hash."""
    mix, alignment.B.mix = alignment.B.mix, lambda x: x * np.uint64(0)
    try:
        ka, kb = np.array([5, 7, 5, 5, 7, 5], np.uint64), np.array([1, 1, 1, 2, 1, 1], np.uint64)
        number, place, times = alignment._numbered(ka, kb)
    finally:
        alignment.B.mix = mix
    assert number.tolist() == [0, 1, 0, 2, 1, 0] and times.tolist() == [3, 2, 1] and [(ka[p], kb[p]) for p in place] == [(5, 1), (7, 1), (5, 2)]
