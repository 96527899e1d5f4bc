"""Search cycles: topics by rotation and from the best candidates, each searched over saved answers and merged into the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.sources import connectors as C
from signalloom.streaming.loop import _complete, run_cycle

#: Fixed value of the rule: what a follow-up asks about a candidate.
FOLLOW_UP = "{name} развитие внедрение применение"
ROTATION = "label string, last_cycle int, times long"
SEEDS = "candidate_id string, label string, topic string, cycle int"
REPORT = "cycle int, status string, topics array<string>, connectors_used array<string>, connectors_skipped array<string>, hits long, errors array<struct<connector:string,query:string,message:string>>, message string"


def _table(spark: SparkSession, folder: str, name: str, schema: str, cycle: int) -> DataFrame:
    """What all complete cycles before this one have written."""
    done = [f"{folder}/{name}/batch={n}" for n in _complete(spark, folder, name) if n < cycle]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def least_recent(spark: SparkSession, labels: list[str], rotation: DataFrame, limit: int) -> list[str]:
    """The labels never asked, then those asked longest ago, the less often asked first; else as listed."""
    every = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")
    seen = rotation.groupBy("label").agg(F.max("last_cycle").alias("last"), F.sum("times").alias("times"))
    rows = every.join(seen, "label", "left").orderBy(F.col("last").asc_nulls_first(), F.coalesce("times", F.lit(0)), "place").limit(limit)
    return [r["label"] for r in rows.collect()]


def adaptive(candidates: DataFrame, seeds: DataFrame, limit: int, cycle: int) -> DataFrame:
    """(candidate_id, label, topic, cycle): follow-ups of the best included candidates (candidate_id, technology_name, score, included) that have had none.

    The best ``limit`` are taken before nameless ones go, as the rule does.
    """
    new = candidates.where("included").join(seeds.select("candidate_id").distinct(), "candidate_id", "left_anti")
    best = new.orderBy(F.desc("score"), "candidate_id").limit(limit).withColumn("name", F.trim(F.coalesce("technology_name", F.lit("")))).where("name <> ''")
    before, after = FOLLOW_UP.split("{name}")
    return best.select("candidate_id", F.substring(F.concat(F.lit("Адаптивно: "), "name"), 1, 120).alias("label"), F.concat(F.lit(before), "name", F.lit(after)).alias("topic"), F.lit(cycle).alias("cycle"))


def search_cycle(
    spark: SparkSession,
    cycle: int,
    folder: str,
    answers: str,
    topics: dict[str, str],
    queries: Callable[[str], list[str]],
    candidates: DataFrame | None = None,
    most_topics: int = 4,
    most_adaptive: int = 3,
    connectors: tuple[C.Connector, ...] = C.DEFAULT,
    keys: dict[str, str] | None = None,
    **more,
) -> dict:
    """One bounded cycle; it never raises for a failing connector or topic, and always writes its report.

    Hits go through ``run_cycle``: merged by address into ``folder``/state.  Which topics were asked, and which candidates
    have had their follow-up, is appended a cycle at a time; a cycle that is run again writes the same folders again.
    """
    rotation = _table(spark, folder, "rotation", ROTATION, cycle)
    chosen = {label: topics[label] for label in least_recent(spark, list(topics), rotation, most_topics)}
    used, skipped, errors, status, message, n = set(), set(), [], "ok", None, 0
    try:
        if candidates is not None and most_adaptive > 0:
            seeds = adaptive(candidates, _table(spark, folder, "seeds", SEEDS, cycle), most_adaptive, cycle)
            seeds.coalesce(1).write.mode("overwrite").parquet(f"{folder}/seeds/batch={cycle}")
            chosen |= {r["label"]: r["topic"] for r in spark.read.schema(SEEDS).parquet(f"{folder}/seeds/batch={cycle}").collect()}
        found = None
        for k, (label, topic) in enumerate(chosen.items()):
            run = C.search(spark, answers, topic, queries(topic), connectors, keys, **more)
            used |= set(run.used)
            skipped |= set(run.skipped)
            errors += [tuple(r) for r in run.errors.select("connector", "query", "message").collect()]
            hits = run.hits.select("url", "title", "snippet", "connector", F.lit(label).alias("seed_label"), F.lit(topic).alias("seed_query"), F.lit(k).alias("k"))
            found = hits if found is None else found.unionByName(hits)
        if found is not None:
            first = found.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("k"))).where("r = 1")
            batch = first.select("url", F.to_json(F.struct("title", "snippet", "connector", "seed_label", "seed_query")).alias("payload"))
            n = batch.count()
            run_cycle(batch, cycle, folder)
    except Exception as e:  # the report says so; the next cycle goes on
        status, message = "error", str(e)[:500]
    asked = [(x, cycle, 1) for x in chosen if x in topics]
    spark.createDataFrame(asked, ROTATION).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rotation/batch={cycle}")
    row = (cycle, status, list(chosen), sorted(used), sorted(skipped), n, sorted(set(errors)), message)
    report = spark.createDataFrame([row], REPORT)
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/reports/batch={cycle}")
    return report.first().asDict()
