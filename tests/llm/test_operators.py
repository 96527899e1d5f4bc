"""The corpus operators against plain versions, on the driver's smallest table and on awkward rows."""

import os
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm import bpe, common, fingerprints, licenses, lm, mixing, near_dedup, quality_classifier, quality_rules, stats, substring_dedup, token_counts

DIR = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "  \n\t ", None, "a"),
    (4, "one", "en", "b"),
    (5, f"start {PASSAGE} end", "en", "b"),
    (6, f"other {PASSAGE} close", "de", "c"),
    (6, f"other {PASSAGE} close", "de", "c"),
    (None, f"x {PASSAGE}", "de", "c"),
    (8, "ab cd " * 300, "fr", "c"),
    (9, "Released under the MIT License. mit license", "en", "a"),
    (10, "überé   <|endoftext|> İ é 's x" * 3, "fr", "a"),
    (11, "z" * 5000, "fr", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DIR):
        pytest.skip("needs the driver's tables")
    return common.documents(spark, DIR).select("doc_id", "text", "lang", "source").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS).withColumns({"original": F.lit(1), "row": F.lit("x"), "kept_text": F.lit(2), "key": F.lit(0)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def substrings(df):
    out = substring_dedup.dedup_substrings(df).select("original.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    return sorted(map(tuple, out.collect()), key=str)


def test_substring_dedup(docs, odd, none):
    assert {r[0]: r[1:] for r in substrings(docs)} == brute.substring_dedup(texts(docs))
    rows = list(enumerate(t for _, t in texts(odd)))
    expected = brute.substring_dedup(rows)
    assert substrings(odd) == sorted(((odd_id, *expected[k]) for k, (odd_id, _) in enumerate(texts(odd))), key=str)
    assert substrings(none) == []


def test_bpe(docs, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (docs, odd):
        got = bpe.encode_digests(df.select("doc_id", "text")).select("original.doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
        plain = brute.bpe(list(enumerate(t for _, t in texts(df))), path)
        assert Counter(map(tuple, got)) == Counter((i, *plain[k]) for k, (i, _) in enumerate(texts(df)))
    whole = bpe.encode_documents(odd).where("original.doc_id = 9").first()
    assert whole["decoded"].startswith("released</w>") and len(whole["ids"]) > 5
    assert bpe.encode_documents(none).count() == 0


def test_bpe_reuses_chunks():
    c = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"w{i}x{i * i % 97}" for i in range(4000))
    for s in B.slices(pa.array([f"abc {text}", f"something else first {text}"])):
        ids, at, _ = bpe.encode_slice(c, s)
    assert c.reused_chunks > 5
    assert at[2] - at[1] == len(c.tokenizer.encode(f"something else first {text}", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_joins(name):
    """Joins in words, runs of white space, marks and unbroken text, for a tokenizer that drops white space and one that keeps it."""
    r = random.Random(2)
    parts = ["ab", "  ", "\n", "é", "don't", "12", "<|endoftext|>", "\x01", " ", "!?", "İ", "\u0301"]
    texts = ["".join(r.choice([*parts, "z" * r.randint(1, 900), f" w{r.randint(0, 9)} "]) for _ in range(r.randint(1, 400))) for _ in range(40)]
    texts += ["z" * 30_000, " " * 30_000, "", "\x01 \x01 a", "word " * 5_000]
    c = bpe.Codec(public_tokenizers.path(name))
    assert c.by_words == (name == "word_bpe_49k.json")
    for s in B.slices(pa.array(texts), bpe.SLICE_BYTES):
        ids, at, decoded = bpe.encode_slice(c, s)
        for i in range(s.rows):
            want = c.tokenizer.encode(texts[s.first + i], add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want
            assert decoded[i].decode() == c.tokenizer.decode(want, skip_special_tokens=False)


def test_quality_classifier(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality_classifier.classify(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got if r["held_out"]) >= 0.85 * sum(r["held_out"] for r in got)
    assert all(r["held_out"] == brute.fold(r["id"], 5) for r in got)
    scored = quality_classifier.classify(odd, labels).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_near_duplicates(spark, docs, odd, none):
    found = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    rows = texts(docs)
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if abs(len(a) - len(b)) < 0.3 * len(a) and a[:20] == b[:20]:
                assert (found[i] == found[j]) == (brute.jaccard(a, b) >= 0.8)
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(odd).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[6] == got[None] == 5 and got[8] == 8
    base = [f"t{i}" for i in range(200)]
    edits = [base[:i] + ["new"] + base[i + 1 :] for i in range(0, 200, 20)]
    group = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, *edits])] + [(99, " ".join(reversed(base)))], "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.near_duplicates(group).collect()} == {0, 99}
    assert sorted(r[0] for r in near_dedup.drop_near_duplicates(group).select("doc_id").collect()) == [0, 99]
    assert near_dedup.near_duplicates(none).count() == 0


def test_alignment():
    r = random.Random(3)
    a = np.array(r.sample(range(10**6), 300), np.uint64)
    assert near_dedup.alignment_similarity(a, a) == 1.0 and near_dedup.alignment_similarity(a, a[:0]) == 0.0
    assert near_dedup.alignment_similarity(a, np.concatenate((a[:270], a[:0]))) == pytest.approx(0.9)
    moved = np.concatenate((a[5:], a[:5]))
    assert near_dedup.alignment_similarity(a, moved) == pytest.approx(295 / 305)
    assert near_dedup.alignment_similarity(a, a[::-1].copy()) == 0.0
    for _ in range(50):
        x = r.sample(range(40), 40)
        best = [1] * 40
        for i in range(40):
            best[i] = 1 + max((best[j] for j in range(i) if x[j] < x[i]), default=0)
        assert near_dedup.increasing(np.array(x)) == max(best)


def test_links_of_a_whole_table(spark):
    """Every pair of 5-word sets at 0.8 or more, found through an index of all sequences, is in one class, and no class has an unlinked part."""
    rows = texts(common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"))
    found = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(common.documents(spark, "/root/testdata/sf0.01")).collect()}
    links = brute.links(rows)
    assert len(links) > 50 and all(found[a] == found[b] for a, b in links)
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert found == {i: find(i) for i in top}


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_weak_hashes_confuse(spark):
    one, two = thue_morse(2048), thue_morse(2048, True)
    tail = " ".join(f"t{i}" for i in range(34))
    rows = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}")], "doc_id long, text string")
    assert {r[2] for r in substrings(rows)} == {0}
    words = [" ".join("xy"[c == "a"] for c in t) for t in (one, two)]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r[0]: r[1:] for r in substrings(rows)} == brute.substring_dedup(list(enumerate(words)))
    short = spark.createDataFrame([(1, f"alpha {one}"), (2, f"alpha {two}")], "doc_id long, text string")
    assert len({r["class_id"] for r in near_dedup.near_duplicates(short).collect()}) == 2
    prints = [r["fingerprint"] for r in fingerprints.edit_likeness(short).collect()]
    assert prints[0] != prints[1]
    assert {r["n_known"] for r in lm.score_texts(short.union(spark.createDataFrame([(i, "alpha beta") for i in range(10, 30)], "doc_id long, text string"))).where("id < 3").collect()} <= {2, 3}
    h = B.word_hashes(*(lambda s: (s, B.words(s)))(next(B.slices(pa.array([f"{one} {two} {one}"])))))
    assert h[0] == h[2] != h[1]


LONG = ["  " * 500_000 + "x", "z" * 1_000_000, "word " * 200_000, " ".join(f"w{i % 5000}" for i in range(150_000)), None, "", "one two"]


@pytest.fixture(scope="module")
def long_rows(spark):
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(LONG)]
    return spark.createDataFrame(rows + rows[-1:] * 3, COLUMNS)


def test_long_texts(spark, long_rows):
    plain = {i: t for i, t in enumerate(LONG)}
    rows = texts(long_rows)
    counts = brute.substring_dedup(list(enumerate(t for _, t in rows)))
    assert substrings(long_rows) == sorted(((i, *counts[k]) for k, (i, _) in enumerate(rows)), key=str)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.encode_digests(long_rows.select("doc_id", "text")).select("original.doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute.bpe(plain.items(), path) and len(got) == len(rows)
    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lengths = {r["length"]: r["n_docs"] for r in token_counts.token_counts(long_rows).collect()}
    assert sum(lengths.values()) == len(rows) and lengths[1_000_000] == 1 and lengths[0] == 2 and lengths[len(e.encode_ordinary("one two"))] == 4
    assert len(quality_rules.judge(long_rows).collect()) == len(rows)
    classes = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(long_rows).collect()}
    assert classes == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}
    assert len(fingerprints.edit_likeness(long_rows).collect()) == len(rows) and len(licenses.scan_licenses(long_rows).collect()) == len(rows)
    assert len(lm.score_texts(long_rows).collect()) == len(rows) and len(mixing.mix(long_rows).collect()) == len(rows)
    labels = spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, quality int")
    assert len(quality_classifier.classify(long_rows, labels).collect()) == len(rows)


def test_repetition_counts(spark):
    """A sequence's second occurrence is no copy of its first: a text and its double are two classes, nearly as many repetitions are one."""
    rows = spark.createDataFrame([(n, "ab cd " * n) for n in (40_000, 36_000, 24_000)], "doc_id long, text string")
    one, two, three = (np.frombuffer(r["kmers"], np.uint64) for r in near_dedup.kmers(rows.withColumnRenamed("doc_id", "node")).collect())
    assert len(set(one.tolist())) == len(one) == 79_996
    assert near_dedup.alignment_similarity(one, two) == pytest.approx(71_996 / 79_996) and near_dedup.alignment_similarity(one, three) == 0.0
    base = " ".join(f"t{i}" for i in range(200))
    more = [(1, base), (2, f"{base} {base}"), (3, " ".join([base] * 50)), (4, base.replace("t7 ", "x ")), (5, " ".join([base] * 49)), (6, "ab cd ef gh ij kl mn " * 3), (7, "ab cd ef gh ij kl mn " * 3000)]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(rows.union(spark.createDataFrame(more, "doc_id long, text string"))).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 3, 6: 6, 7: 7, 40_000: 36_000, 36_000: 36_000, 24_000: 24_000}
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(more, "doc_id long, text string")).collect()) == [1, 2, 3, 6, 7]


def test_equal_rows_share_their_marks(spark):
    rows = spark.createDataFrame([(7, PASSAGE + " " + PASSAGE)] * 50, "doc_id long, text string")
    marks = substring_dedup.repeated_windows(rows, "doc_id", "text").collect()
    assert len(marks) == 1 and len(marks[0]["marks"]) <= 120
    assert {r[1:3] for r in substrings(rows)} == {(120, 120)}


def test_length_pieces_match_the_library(monkeypatch):
    import re

    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(token_counts, "PIECE", 5)
    monkeypatch.setattr(token_counts, "LONG_GAP", 8)
    monkeypatch.setattr(token_counts, "_long_gap", re.compile("[%s]{8,}" % token_counts.WHITE))
    r = random.Random(4)
    for _ in range(1500):
        t = "".join(r.choice(["a", " ", "\n", "\t ", "é", "1", "!", "'s", "word", " " * r.randint(1, 20), "\u3000", "\xa0", "\x1c", "\x85", "\u200b"]) for _ in range(r.randint(1, 40)))
        assert token_counts.encoded_length(e, t) == len(e.encode_ordinary(t))


def test_license_words(spark):
    """Words by the classes' members are those that the negated classes give, at code points of every kind."""
    negated = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    chars = [chr(c) for c in (*range(1024), 0x2028, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF)]
    rows = spark.createDataFrame([(f"a{c}b{c}{c}C{c}",) for c in chars], "text string")
    assert rows.where(F.regexp_count("text", F.lit(negated)) != F.regexp_count("text", F.lit(licenses.ANY_WORD))).count() == 0
    lower = negated.replace("\\x40\\x5B-", "")
    assert rows.where(~licenses.word_list(F.col("text")).eqNullSafe(F.regexp_extract_all(F.translate("text", licenses.UPPER, licenses.LOWER), F.lit(lower), F.lit(0)))).count() == 0
    # A negated class tries all of its ranges for every letter of a word.
    assert "[^" not in licenses.ANY_WORD + licenses.WORD


def test_licenses(docs, odd, none):
    for df in (docs, odd):
        got = licenses.scan_licenses(df).select("id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
        plain = brute.licenses(list(enumerate(t for _, t in texts(df))))
        assert Counter(map(tuple, got)) == Counter((i, *plain[k]) for k, (i, _) in enumerate(texts(df)))
    row = licenses.scan_licenses(odd).where("id = 9").first()
    assert (row["labels"], row["n_base"], row["score"]) == ("mit", 2, 1.0)
    assert licenses.scan_licenses(none).count() == 0


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software)"
    bsd = "# Redistributions of source code must\n# retain the above copyright\n\n# notice, this list of\n# conditions and the following disclaimer."
    rows = spark.createDataFrame(
        [(1, f"int main\n{mit}\nmore"), (2, bsd), (3, "the software is free\nof charge"), (4, None), (5, "All rights\n\n\n\nreserved"), (6, "All rights we had were reserved for all; cc by nc was not it; by cc nc")], "doc_id long, text string"
    )
    got = {r["id"]: (r["labels"], r["base_labels"]) for r in licenses.scan_licenses(rows).collect()}
    assert got == {1: ("mit", ""), 2: ("bsd", ""), 3: ("", ""), 4: ("", ""), 5: ("all-rights-reserved", ""), 6: ("cc-by,cc-by-nc", "cc-by")}
    low = licenses.template_labels(rows.select(F.col("doc_id").alias("key"), "text"), [("x", "free charge copy notice")], 0.5).collect()
    assert {r["key"] for r in low} == {1, 3}


def test_template_join_is_exact(spark, docs):
    """Every window of twice a template's words, over the smallest table and over notices broken, mixed and thinned at random."""
    import re

    r = random.Random(6)
    made = []
    for k in range(150):
        w = []
        for _ in range(r.randint(1, 3)):
            own = r.choice(licenses.TEMPLATES)[1].split()
            w += [x for x in own if r.random() > r.choice([0, 0.05, 0.15])] + ["the", "filler", "of"][: r.randint(0, 3)] * r.randint(0, 9)
            if r.random() < 0.3:
                r.shuffle(w)
        made.append((-1 - k, "".join(x.upper() if r.random() < 0.1 else x for x in (y + r.choice([" ", " ", " ", "\n", "\n# ", ", "]) for y in w))))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {x["key"]: (sorted(x["found"]), x["score"]) for x in licenses.template_labels(both.select(F.col("doc_id").alias("key"), "text"), licenses.TEMPLATES, 0.9).collect()}
    word, hits = re.compile(licenses.WORD), 0
    for i, text in texts(both):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        best = {}
        for label, t in licenses.TEMPLATES:
            need, n = set(t.split()), 2 * len(t.split())
            if len(need & set(w)) >= 0.9 * len(need):
                share = max(len(need & set(w[a : a + n])) for a in range(len(w))) / len(need)
                if share >= 0.9 - 1e-9:
                    best[label] = max(best.get(label, 0), share)
        found, score = got.get(i, ([], 0.0))
        assert found == sorted(best) and (not best or abs(score - max(best.values())) < 1e-9)
        hits += bool(best)
    assert hits > 60


def test_lm(docs, odd, none):
    import math
    import re

    got = lm.score_texts(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    tokens = {i: [*brute.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts(docs)}
    c = Counter(w for i in tokens if not brute.fold(i, 10) for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for r in got:
        w = tokens[r["id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    assert len(lm.score_texts(odd).collect()) == len(ROWS)
    assert lm.score_texts(none).count() == 0


def test_lm_does_not_depend_on_tasks(docs):
    """One task or 16: the same model but for the order of sums; no held-out text falls far below its base score."""
    one, many = ({r["id"]: r for r in lm.score_texts(docs.repartition(n)).collect()} for n in (1, 16))
    for i, r in one.items():
        assert abs(r["score"] - many[i]["score"]) < 0.01 * r["n_tokens"] and r["base_score"] == pytest.approx(many[i]["base_score"])
        assert not r["held_out"] or r["score"] > r["base_score"] - 0.05 * r["n_tokens"] - 2


def test_lm_gradients_stay_in_proportion_to_tokens():
    """Four bytes a parameter from every task and step: at most two for a token, but for one task a step, at any size of the model."""
    for total, parameters in ((10**6, 10**5), (10**8, 9 * 10**5), (6 * 10**9, 7 * 10**6), (10**11, 3 * 10**7)):
        tasks = lm.learners(total, parameters)
        assert tasks == 1 or 4 * parameters * (tasks - 1) * lm.ROUNDS <= 2 * total, (total, parameters, tasks)
    assert lm.learners(10**8, 9 * 10**5) > 1


def test_lm_gradients_of_few_tasks_are_not_shuffled(spark, monkeypatch):
    """At the size of check_l (two tasks) nothing of a gradient goes to disk; both ways give the same sums."""
    rows = [(k, i, [float(k + i * j) for j in range(lm.WIDTH)]) for k in range(3) for i in range(5 + k)]
    parts = spark.createDataFrame(rows, "k int, i long, x array<float>").repartition(3, "k").select("i", "x")
    want = np.zeros((7, lm.WIDTH))
    for _, i, x in rows:
        want[i] += x
    taken, real = [], type(parts).toArrow
    monkeypatch.setattr(type(parts), "toArrow", lambda self: taken.append(self) or real(self))
    for direct in (3, 0):
        assert np.array_equal(lm.summed(parts, 3, direct), want)
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in taken]
    above, *below = plans[1].split("Initial Plan")[-1].split("Exchange hashpartitioning(i")
    assert "Aggregate" not in plans[0] and "Aggregate" in above and len(below) == 1 and "Aggregate" not in below[0]
    assert lm.summed(parts.limit(0), 1) is None
    assert lm.learners(10**8, 9 * 10**5) <= lm.DIRECT


def test_lm_words_follow_their_context(spark):
    r = random.Random(9)
    starts = [r.randrange(300) for _ in range(200)]
    rows = [(i, " ".join(f"w{(a + 7 * k) % 300}" for k in range(150)), "en", "a") for i, a in enumerate(starts)]
    got = lm.score_texts(spark.createDataFrame(rows, COLUMNS)).collect()
    held = [x for x in got if x["held_out"]]
    assert held and sum(x["score"] for x in held) > 0.4 * sum(x["base_score"] for x in held)


def test_lm_is_normalised():
    import numpy as np

    table = lm.LogBilinear(20, 5).train(np.array([3, 50, 1999]), np.array([5, 2, 9]), steps=20).log10_table()
    assert np.allclose((10**table).sum(-1), 1)


def test_lm_repeated_events(monkeypatch):
    """A block's gradient is the sum of its events' gradients, and what depends on a context alone is worked out once for all events of it; so for scores."""
    r = np.random.default_rng(3)
    model = lm.LogBilinear(300, 40, r.integers(1, 1000, 300).astype(float))
    before, anchor, y = (r.integers(0, n, 60) for n in (300, 40, 300))
    before[30:], anchor[30:] = before[:30], anchor[:30]
    draws, many = model.draws(r), r.integers(0, 60, 3000)
    one = [model.gradient(before[i : i + 1], anchor[i : i + 1], y[i : i + 1], draws) for i in range(60)]
    seen, real = [], lm._logistic
    monkeypatch.setattr(lm, "_logistic", lambda scores: seen.append(scores.size) or real(scores))
    got = model.gradient(before[many], anchor[many], y[many], draws)
    assert sum(seen) < 60 * (len(model.share) + lm.NOISE + 3)
    for k, v in got.items():
        want = sum(one[i][k].astype(float) for i in many)
        assert np.allclose(v, want, rtol=1e-3, atol=1e-3 * np.abs(want).max()), k
    assert np.allclose(model.log10(before[many], anchor[many], y[many]), model.log10(before, anchor, y)[many], atol=1e-5)


def test_lm_distinct():
    """Packed with their places or, where these do not fit, not: the same distinct numbers."""
    r = np.random.default_rng(4)
    for most in (5, 1 << 40, (1 << 62) + 5):
        code = r.integers(0, most, 40)[r.integers(0, 40, 1000)]
        kinds, of, n = lm._distinct(code)
        assert (kinds == np.unique(code)).all() and (kinds[of] == code).all() and (n == np.bincount(of)).all()


def test_token_counts(docs, none):
    import tiktoken  # noqa: F401

    e = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lengths = [len(e.encode_ordinary(t)) for _, t in texts(docs)]
    counts = token_counts.token_counts(docs, block=64).cache()
    for r in counts.collect():
        x = r["length"]
        assert r["n_docs"] == lengths.count(x) and r["docs_longer"] == sum(n > x for n in lengths)
        assert r["truncated_tokens"] == sum(min(n, x) for n in lengths) and r["tokens_total"] == sum(lengths)
    for limit in (0, 1, 100, 777, 10**6):
        assert token_counts.truncated_total(counts, limit) == sum(min(n, limit) for n in lengths)
    assert token_counts.length_quantile(counts, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.token_counts(none).count() == 0


def test_fingerprints(docs, odd, none):
    got = {r["id"]: r for r in fingerprints.edit_likeness(docs).collect()}
    text = dict(texts(docs))
    errors = []
    for i, (n, edit, _) in brute.edits(texts(docs)).items():
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, brute.sha(edit))
        errors.append(abs(got[i]["near_edited"] - brute.jaccard(text[i], edit)))
    assert sum(errors) / len(errors) < 0.03
    rows = fingerprints.edit_likeness(odd).collect()
    assert len(rows) == len(ROWS) and {r["fingerprint"] for r in rows if r["id"] in (1, 2, 3)} == {""}
    assert fingerprints.edit_likeness(none).count() == 0


def test_quality_rules(docs, odd, none):
    for df in (docs, odd):
        got = quality_rules.judge(df).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert Counter(map(tuple, got)) == Counter((i, *brute.stats(t)) for i, t in texts(df))
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.filter_quality(odd).columns == odd.columns


def prose(r, loud=0.0, stops=0.12, n=150):
    """n invented words; a share of them ends in a stop, a share in an exclamation mark."""
    ends = (("!", loud), (",", stops))
    return " ".join("".join(r.choices("abcdefghinorstu", k=r.randint(2, 9))) + "".join(c for c, share in ends if r.random() < share) for _ in range(n)).capitalize()


def test_quality_distances(spark, docs, monkeypatch):
    """Distances and verdicts against a plain version of the same steps, broadcast and salted."""
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    measured = [stats.vectors(stats.text_stats(s)) for s in B.slices(pa.array([r["text"] for r in rows]))]
    q = quality_rules
    want = brute.robust_distances([(r["lang"], r["source"]) for r in rows], np.concatenate(measured), q.FLOOR, q.COVERED, q.STEPS, q.PULL, q.chi2_quantile, q.chi2_cdf)
    for groups in (q.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(q, "BROADCAST_GROUPS", groups)
        got = {r["id"]: r for r in q.judge(docs).collect()}
        for k, r in enumerate(rows):
            assert got[r["doc_id"]]["distance"] == pytest.approx(want[k], rel=1e-6)
            assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and want[k] <= q.CUTOFF)


def test_fingerprints_of_equal_ids(spark):
    rows = [(5, f"text number {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)] + [(i, f"own {i}") for i in range(6, 20)]
    got = fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    edits = {r["edited_sha256"] for r in got}
    followers = [t for _, t in rows]
    assert all(any(brute.sha(t[: len(t) - len(t) // 2] + f[: len(t) // 2]) in edits for f in followers) for _, t in rows)


def test_quality_cutoff(spark):
    r = random.Random(7)
    rows = [(i, prose(r), "en", "a") for i in range(500)]
    planted = [(1000 + i, prose(r, loud=0.14), "en", "a") for i in range(20)]
    got = quality_rules.judge(spark.createDataFrame(rows + planted, COLUMNS)).collect()
    assert not any(x["base_failed"] for x in got)
    assert {x["id"] for x in got if not x["kept"]} == {i for i, *_ in planted}


def test_quality_of_small_groups(spark):
    r = random.Random(8)
    rows = [(i, prose(r, stops=0.5 * (i % 2)), ("de", "en")[i % 2], "a") for i in range(600)]
    planted = [(1000 + i, prose(r, stops=0.5), "de", "a") for i in range(5)]
    alone = [(2000, prose(r, stops=0.0), "de", "b"), (2001, prose(r, stops=0.5), "en", "c")]
    got = {x["id"]: x["kept"] for x in quality_rules.judge(spark.createDataFrame(rows + planted + alone, COLUMNS)).collect()}
    assert {i for i, kept in got.items() if not kept} == {i for i, *_ in planted}


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        out = mixing.mix(df).select("original.source", "size", "source_size", "target", "taken").collect()
        size, taken = Counter(), Counter()
        for r in out:
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 3 * r["size"]
        targets = brute.targets(dict(size))
        for r in out:
            assert r["target"] == pytest.approx(targets[r["source"]]) and abs(taken[r["source"]] - r["target"]) <= 1
    mixed = mixing.mix(docs)
    assert mixing.repeated(mixed).select(F.sum(F.regexp_count("kept_text", F.lit(common.WORD)))).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert mixing.mix(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DIR).select("doc_id", "text", "n_tokens", "decoded").collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows if r["text"])
    plain = brute.bpe(list(enumerate(r["text"] for r in rows)), public_tokenizers.path("word_bpe_49k.json"))
    assert all((r["n_tokens"], brute.sha(r["decoded"])) == (plain[k][0], plain[k][2]) for k, r in enumerate(rows))


def test_pipeline_stages(spark):
    import corpus_pipeline

    r = random.Random(10)
    plain = {i: prose(r) for i in range(120)}
    shared = prose(r, n=40)
    plain |= {i: f"{plain[i]} {shared} {prose(r, n=20)}" for i in (3, 50)}
    copies = {200 + i: " ".join([*plain[i].split()[:70], "changed", *plain[i].split()[71:]]) for i in range(10, 16)}
    loud = {300 + i: prose(r, loud=0.3) for i in range(5)}
    rows = {**plain, **copies, **loud}
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in rows.items()], COLUMNS + ", n_chars long")
    (_, quality), (_, near), (_, substring), (_, mixing_stage), (_, encode) = corpus_pipeline.STAGES
    kept = common.store(quality(spark, docs, DIR), "test")
    assert dict(texts(kept)) == {**plain, **copies} and kept.count() == len(plain) + len(copies)
    single = common.store(near(spark, kept, DIR), "test")
    pairs = {b for a in rows for b in rows if a < b < 300 and brute.jaccard(rows[a], rows[b]) >= 0.8}
    assert pairs == set(copies) and sorted(texts(single)) == sorted(plain.items())
    cut = common.store(substring(spark, single, DIR), "test")
    want = brute.substring_dedup(plain.items())
    assert {i for i, w in want.items() if w[1]} == {3, 50}
    assert all(brute.sha(t) == want[i][2] if want[i][1] else t == plain[i] for i, t in texts(cut)) and cut.count() == len(plain)
    mixed = common.store(mixing_stage(spark, cut, DIR), "test")
    size, taken, left = Counter(), Counter(), dict(texts(cut))
    for i, t in left.items():
        size["ab"[i % 2]] += len(t.split())
    for i, t in texts(mixed):
        taken["ab"[i % 2]] += len(t.split())
        assert left[i].split()[: len(t.split())] == t.split()
    assert all(abs(taken[x] - n) <= 1 for x, n in brute.targets(dict(size)).items())
    assert sorted(texts(encode(spark, mixed, DIR))) == sorted(texts(mixed))


def test_pipeline_odd_rows(spark):
    """Nulls in every column, empty, repeated and clashing rows go through each stage; so does an empty table."""
    import corpus_pipeline

    kind = COLUMNS + ", n_chars long"
    r = random.Random(12)
    long_text = prose(r)
    rows = [(1, None, None, None, None), (None, long_text, None, None, None), (2, "", "en", "a", 0), (3, long_text, "en", "a", 1), (3, long_text, "en", "a", 1), (4, " \n ", "en", None, 3), (5, "word " * 2000, "en", "b", 10_000)]
    odd = spark.createDataFrame(rows, kind).withColumns({c: F.lit(1) for c in ("original", "kept_text", "key", "ids", "node")})
    for name, stage in corpus_pipeline.STAGES:
        out = common.store(stage(spark, odd, DIR), "test")
        assert name == "bpe" or out.columns == list(corpus_pipeline.COLUMNS)
        assert out.count() == {"quality rules": 3, "near dedup": 3, "substring dedup": 7, "bpe": 7}.get(name, out.count()), name
        assert stage(spark, odd.limit(0), DIR).count() == 0
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, DIR), "test")
    assert {x["text"] for x in docs.select("text").collect()} <= {long_text}
