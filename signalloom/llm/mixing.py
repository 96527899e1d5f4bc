"""Mixing sources to target weights by capped water-filling, DataFrame functions only.

A source's target is the lesser of its cap (``max_epochs`` times its size) and its weight times
a common level; the level is where the targets sum to the whole.  That is what clamping sources
at their caps and sharing the excess by weight arrives at.  With sources ordered by cap over
weight, one running sum finds the level.

A source's repetitions r = target / size are taken as floor(r) whole copies of every document,
and the rest as a seeded sample: documents in the order of a hash of seed, id and text, until
the words that are missing are reached; the last one gives only its first words.  The order is
found in two levels, totals of ``BUCKETS`` hash ranges first, then only the one range in which
the sample ends, so no source is sorted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import WORD, documents, store

MAX_EPOCHS, WEIGHTS, SEED, LOG_BUCKETS = 3, (1, 2, 3), 20, 12


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeat over the sources by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[place % len(weights)])


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size, weight)."""
    caps = sources.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, weights = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = caps.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    shared = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return capped.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * left / shared)).drop("cap", "ratio", "level", "capped")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(original, size, source_size, target, whole, part, taken) for every row.

    ``original`` is the input row as a struct; size counts words, 0 for null and empty texts; the
    row is taken ``whole`` times and then its first ``part`` words once, ``taken`` words in all.  Null is a
    source of its own.  Sources without words have target 0.  The same rows give the same result;
    rows equal in id and text share a place in the order, and which comes first makes no difference.
    An empty table gives no rows.
    """
    rows = df.select(
        F.struct("*").alias("original"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, text_col).alias("place"),
    ).withColumn("bucket", F.shiftrightunsigned("place", 64 - LOG_BUCKETS).cast("int"))
    sums = store(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = water_fill(weighted(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    sources = sources.withColumn("whole", epochs).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).withColumnRenamed("source", "s").withColumnRenamed("bucket", "k")
    plan = plan.join(sources, F.col("s").eqNullSafe(F.col("source"))).select("s", "k", "source_size", "target", "whole", (F.col("rest") - F.col("before")).alias("room"), ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest"))).alias("edge"))
    both = rows.join(store(plan, "plan"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    inner = both.where(~F.col("edge")).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("s", "k").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = both.where("edge").withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - F.col("ahead")))).drop("ahead")
    out = inner.unionByName(last)
    return out.select("original", "size", "source_size", "target", "whole", F.col("part").cast("long").alias("part"), (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: the original rows as often as mix() takes them; a part keeps the text's first words."""
    some = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    whole = F.col("whole") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    times = mixed.withColumn("copies", (whole + F.when(some, 1).otherwise(0)).cast("int")).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    cut = some & (F.col("copy") == F.col("copies"))
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("original")[text_col], F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    return times.select("original", F.when(cut, words).otherwise(F.col("original")[text_col]).alias("kept_text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("original.doc_id", "size", "source_size", "target", "taken")
