"""Summaries and linear scores of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trust_summary(df: DataFrame, by: str, level: str = "trust_level") -> DataFrame:
    """(by, summary): "level: n" joined by "; ", levels in order."""
    counts = df.groupBy(by, level).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(level, F.lit(": "), "n"))), "; ").alias("summary"))


def status_counts(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n) of every known status, zero where there is none, and of all others found."""
    base = df.sparkSession.createDataFrame([(s,) for s in known], f"{status} string")
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, status, "full").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def linear_score(df: DataFrame, key: str, features: str, weights: dict[str, float], intercept: float, low: float, high: float) -> DataFrame:
    """(key, score, contributions): a clamped sparse dot product; contributions by size, then name.

    ``features`` is a map column; names without a weight do not count, and a null map scores the intercept.
    """
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    pairs = F.filter(F.map_entries(F.coalesce(F.col(features), F.create_map().cast("map<string,double>"))), lambda e: F.array_contains(F.map_keys(table), e["key"]))
    parts = F.transform(pairs, lambda e: F.struct((-F.abs(e["value"] * table[e["key"]])).alias("size"), e["key"].alias("name"), (e["value"] * table[e["key"]]).alias("value")))
    total = F.aggregate("parts", F.lit(float(intercept)), lambda a, x: a + x["value"])
    rows = df.select(key, F.array_sort(parts).alias("parts"))
    return rows.select(key, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), total)).alias("score"), F.transform("parts", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias("contributions"))
