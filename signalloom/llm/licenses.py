"""License scans, DataFrame functions only.

Base labels come from places where a phrase's words stand consecutively; short phrases (``MORE_PHRASES``) add labels the same way.
Further labels come from an exact set-similarity join of text blocks with license templates.  A block is a window of
consecutive words, ``SPREAD`` times as many as the template has, wherever lines, comment marks or punctuation cut them: every
window whose word set holds at least ``CONTAINMENT`` of a template's is found.  The templates' words
are ordered by their frequency in the whole corpus, rarest first; a block can only reach the
threshold for a template T of n words if it holds one of T's n - need + 1 rarest (prefix
filter).  Around each place of such a word, as the block's first common word, enough of the template's words that are not rarer
must stand near (length and positional filter); then the windows that hold the place are counted.  Only the
templates' words near a place are kept, so a long text costs a bounded amount a place.  Templates are a
fixed table, so their side of the join has a proven bound and is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import documents, row_key

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases too short for a set join, where words in another order would match: found in order only.
MORE_PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}
#: The licenses' own words (fixed values): headers, and notices whole and by sentence.
TEMPLATES = [
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
CONTAINMENT, SPREAD = 0.9, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What GAP leaves, said by its members, the commonest first: a negated class tries every range for every letter, which takes ten times as long.
ANY_WORD = "[a-zA-Z0-9\\x80-\U0010FFFF]+"
WORD = "[a-z0-9\\x80-\U0010FFFF]+"


def word_list(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _words_in(part):
    """Words of a piece of the form ' a  b '."""
    return F.when(part == "", 0).otherwise(F.size(F.split(part, "  ")))


def phrase_labels(rows: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(key, n_base, first_word, last_word, base) of the rows (key, text) that hold a phrase."""
    look = "(?i)(" + "|".join(GAP.join(p.split()) for p in phrases) + ")"
    hits = rows.where(F.col("text").rlike(look)).withColumn("w", word_list(F.col("text")))
    hits = hits.select("key", F.size("w").alias("n"), F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")).alias("c"))
    hits = hits.withColumn("r", F.reverse("c"))
    n, first, last, labels = [], [], [], []
    for phrase, label in phrases.items():
        p = " " + "  ".join(phrase.split()) + " "
        there = F.instr("c", p)
        n.append(((F.length("c") - F.length(F.replace("c", F.lit(p), F.lit("")))) / len(p)).cast("long"))
        first.append(F.when(there > 0, _words_in(F.expr(f"left(c, instr(c, '{p}') - 1)"))))
        last.append(F.when(there > 0, F.col("n") - len(phrase.split()) - _words_in(F.expr(f"left(r, instr(r, '{p[::-1]}') - 1)"))))
        labels.append(F.when(there > 0, label))
    out = hits.select("key", sum(n[1:], n[0]).alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))
    return out.where("n_base > 0").dropDuplicates(["key"])


def template_labels(rows: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(key, found, score): the templates' labels that windows of the rows (key, text) reach, and the best containment."""
    spark = rows.sparkSession
    sets = [(label, sorted(set(text.split())), SPREAD * len(text.split())) for label, text in templates]
    vocabulary = sorted({w for _, t, _ in sets for w in t})
    one = F.explode(F.split(F.lower("text"), GAP)).alias("word")
    counted = dict(rows.select(one).where(F.col("word").isin(vocabulary)).groupBy("word").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    prefixes, rare, widest = [], set(), max(width for _, _, width in sets)
    for label, t, width in sets:
        ranks, need = sorted(rank[w] for w in t), math.ceil(containment * len(t) - 1e-9)
        for r in ranks[: len(ranks) - need + 1]:
            prefixes.append((r, label, need, width, ranks))
            rare.add(next(w for w in t if rank[w] == r))
    side = F.broadcast(spark.createDataFrame(prefixes, "rank int, label string, need int, width int, t array<int>"))
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    first_ranks = sorted({p[0] for p in prefixes})
    look = f"(?i)(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])({'|'.join(sorted(rare))})(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"
    placed = F.transform(word_list(F.col("text")), lambda w, i: F.struct(i.alias("pos"), w.alias("w")))
    known = F.transform(F.filter(placed, lambda x: x["w"].isin(vocabulary)), lambda x: F.struct(x["pos"].alias("pos"), ranks[x["w"]].alias("rank")))
    held = rows.where(F.col("text").rlike(look)).select("key", known.alias("v"))
    # Positions rise by 1 at least, so what lies within ``widest`` words lies within as many entries.
    around = F.transform("v", lambda x, k: F.struct(x["pos"].alias("pos"), x["rank"].alias("rank"), F.slice("v", F.greatest(k + 1 - widest, F.lit(1)), 2 * widest + 1).alias("near")))
    places = held.select("key", F.explode(F.filter(around, lambda x: x["rank"].isin(first_ranks))).alias("p")).select("key", "p.pos", "p.rank", "p.near")
    met = places.join(side, "rank")
    close = lambda x: (F.abs(x["pos"] - F.col("pos")) < F.col("width")) & (x["rank"] >= F.col("rank")) & F.array_contains("t", x["rank"])
    met = met.select("key", "pos", "label", "need", "width", F.size("t").alias("size"), F.filter("near", close).alias("near"))
    met = met.where(F.size(F.array_distinct(F.transform("near", lambda x: x["rank"]))) >= F.col("need"))
    count = lambda s: F.size(F.array_distinct(F.transform(F.filter("near", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + F.col("width"))), lambda x: x["rank"])))
    best = F.array_max(F.transform(F.filter("near", lambda x: x["pos"] <= F.col("pos")), count))
    met = met.withColumn("common", best).where(F.col("common") >= F.col("need"))
    return met.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("score"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Null texts count as empty: no words, no labels, score 0.  Only A-Z are lower-cased.  Rows equal
    in id and text get equal results.  Texts are read whole, whatever their length; other columns
    are not read.  The score is 1 where a phrase stands, else the best
    containment of a template that a block reaches, else 0.  An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    base, more = phrase_labels(rows.select("key", "text")), template_labels(rows.select("key", "text"), templates or TEMPLATES, containment)
    short = phrase_labels(rows.select("key", "text"), MORE_PHRASES).select("key", F.col("base").alias("phrases"))
    found = base.join(more, "key", "full").join(short, "key", "full")
    counted = rows.select("id", "key", F.coalesce(F.regexp_count("text", F.lit(ANY_WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    own = F.coalesce("base", none)
    return counted.join(found, "key", "left").select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.array_union(own, F.coalesce("found", none)), F.coalesce("phrases", none))), ",").alias("labels"),
        F.when((F.col("n_base") > 0) | F.col("phrases").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
