"""Connectors over folders of saved answers, as a Python data source for batches and streams, and the search plan.

An answer is a whole file ``connector=NAME/day=YYYY-MM-DD/QUERY.json`` or ``.xml`` (QUERY percent-encoded).  Options name the
connectors and days to list, and filters on these columns can be pushed into the listing, so other files are never opened; a file that
cannot be read is a row with an error, not a failed query.  Folders may be on any file system that pyarrow reads by URI.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as S
from pyspark.sql import functions as F

from signalloom.functions import text as T
from signalloom.functions import vocabulary as V
from signalloom.sources import answers as A
from signalloom.sources import payloads as P

SCHEMA = "connector string, day date, query string, file string, payload string, error string"
PLACE = re.compile(r"connector=([^/]+)/day=(\d{4}-\d{2}-\d{2})/([^/]+)\.(?:json|xml)$")
FILES = 64


@dataclass(frozen=True)
class Answer:
    connector: str
    day: datetime.date
    query: str
    path: str
    at: int

    @property
    def order(self) -> tuple[int, str]:
        return self.at, self.path


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> list[Answer]:
    """The answers of a folder by time of writing; files elsewhere are no answers."""
    from pyarrow import fs

    system, folder = _files(uri)
    out = []
    for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        found = PLACE.search(info.path)
        if found and info.is_file:
            out.append(Answer(found[1], datetime.date.fromisoformat(found[2]), unquote(found[3]), info.path, info.mtime_ns or 0))
    return sorted(out, key=lambda a: a.order)


def read_answer(uri: str, a: Answer) -> tuple:
    """One row; an answer that cannot be read or decoded has its error."""
    try:
        with _files(uri)[0].open_input_stream(a.path) as f:
            return a.connector, a.day, a.query, a.path, f.read().decode(), None
    except (OSError, UnicodeDecodeError) as e:
        return a.connector, a.day, a.query, a.path, None, f"{type(e).__name__}: {e}"[:500]


def wanted(filters: list[S.Filter]) -> Callable[[Answer], bool]:
    """What the filters on connector and day say of a file; others say nothing."""
    tests = []
    for f in filters:
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in ("connector", "day"):
            continue
        if isinstance(f, S.In):
            tests.append(lambda a, c=column[0], v=tuple(f.value): getattr(a, c) in v)
        else:
            compare = {S.EqualTo: "__eq__", S.GreaterThan: "__gt__", S.GreaterThanOrEqual: "__ge__", S.LessThan: "__lt__", S.LessThanOrEqual: "__le__"}.get(type(f))
            if compare is not None and f.value is not None:
                tests.append(lambda a, c=column[0], v=f.value, m=compare: getattr(getattr(a, c), m)(v))
    return lambda a: all(t(a) for t in tests)


def _asked(options: dict, a: Answer) -> bool:
    names, first, last = options.get("connectors"), options.get("from"), options.get("to")
    return (names is None or a.connector in names.split(",")) and (not first or a.day.isoformat() >= first) and (not last or a.day.isoformat() <= last)


class Files(S.InputPartition):
    def __init__(self, answers: list[Answer]):
        super().__init__(answers)


def _dealt(answers: list[Answer], size: int) -> list[Files]:
    return [Files(answers[i : i + size]) for i in range(0, len(answers), size)]


class Reader(S.DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.size, self.options = options["path"], int(options.get("files", FILES)), options
        self.test: Callable[[Answer], bool] = lambda a: True

    def pushFilters(self, filters: list[S.Filter]) -> list[S.Filter]:
        """Prune the listing; all filters go back to Spark as well, which applies them again."""
        if self.options.get("pushdown") == "true":
            self.test = wanted(filters)
        return filters

    def partitions(self) -> list[Files]:
        own = [a for a in listed(self.uri) if _asked(self.options, a) and self.test(a)]
        return _dealt(own, self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return (read_answer(self.uri, a) for a in partition.value)


class StreamReader(S.DataSourceStreamReader):
    """Answers in the order in which they were written; an offset is the last one's time and path.

    Files appear whole (written elsewhere and renamed), with the time of their writing.
    """

    def __init__(self, options: dict):
        self.uri, self.size = options["path"], int(options.get("files", FILES))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max((a.order for a in listed(self.uri)), default=(-1, ""))
        return {"at": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return _dealt([a for a in listed(self.uri) if low < a.order <= high], self.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return (read_answer(self.uri, a) for a in partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to release: answers stay where they are."""


class SavedAnswers(S.DataSource):
    """Format ``saved_answers``.  Options: ``path``; ``connectors`` (comma-joined), ``from``, ``to`` (days) to list; ``files`` a partition.

    With ``pushdown`` = true, filters on connector and day prune the listing too.  Spark 4.1 keeps the first pruned listing of a loaded
    table for all its uses, so such a DataFrame must be used with one set of these filters; load it anew for another.
    """

    @classmethod
    def name(cls) -> str:
        return "saved_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedAnswers)


def answers(spark: SparkSession, folder: str, stream: bool = False, **options: str) -> DataFrame:
    register(spark)
    return (spark.readStream if stream else spark.read).format("saved_answers").option("path", folder).options(**options).load()


@dataclass(frozen=True)
class Connector:
    """``parse`` reads (payload) rows into hits; ``windowed`` if its source filters by publication date; ``key`` names a needed key."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    source_type: str
    windowed: bool = False
    key: str | None = None
    seconds: float = 1.0
    is_json: bool = True

    def is_available(self, keys: dict[str, str]) -> bool:
        return self.key is None or bool(keys.get(self.key))


DEFAULT = (
    Connector("arxiv", A.atom, "academic", windowed=True, is_json=False),
    Connector("crossref", P.crossref, "academic", windowed=True),
    Connector("gdelt", P.gdelt, "general_media", windowed=True, seconds=5.0),
    Connector("hackernews", P.hackernews, "forum"),
    Connector("github", P.github, "code_repository"),
)


def plan(spark: SparkSession, queries: list[str], connectors: list[Connector], budget: float | None = None) -> DataFrame:
    """(query_ord, connector_ord, connector, query, spent, run): every source gets the first query before any gets the second.

    A step runs while the steps before it have not spent the budget (seconds by connector).
    """
    rows = [(i, j, c.name, q, float(c.seconds)) for i, q in enumerate(queries) for j, c in enumerate(connectors)]
    steps = spark.createDataFrame(rows, "query_ord int, connector_ord int, connector string, query string, seconds double")
    before = Window.orderBy("query_ord", "connector_ord").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("seconds").over(before), F.lit(0.0))
    return steps.withColumn("spent", spent).withColumn("run", F.lit(True) if budget is None else F.col("spent") < budget)


@dataclass
class Run:
    """``hits``: one row per address, in the order of the plan.  ``errors``: (connector, query, message).  ``off_topic``: hits without a word of the topic."""

    plan: DataFrame
    hits: DataFrame
    off_topic: DataFrame
    errors: DataFrame
    used: list[str]
    skipped: list[str]
    budget_exhausted: bool


def search(spark: SparkSession, folder: str, topic: str, queries: list[str], connectors: tuple[Connector, ...] = DEFAULT, keys: dict[str, str] | None = None, window: tuple[str, str] | None = None, budget: float | None = None, most: int = 10) -> Run:
    """Run a search over saved answers; a connector that fails leaves an error row and the others' hits.

    ``window`` (first and last day of publication) is applied to the hits of connectors that know publication dates; a hit without one stays.
    At most ``most`` hits an answer, as the search asks for; an address counts once, where the plan finds it first.
    """
    ready = [c for c in connectors if c.is_available(keys or {})]
    steps = plan(spark, queries, ready, budget)
    names = [c.name for c in ready]
    run = steps.where("run")
    found = answers(spark, folder, connectors=",".join(names)).join(F.broadcast(run.select("connector", "query", "query_ord", "connector_ord")), ["connector", "query"])
    parts, errors = [], [found.where("error IS NOT NULL").select("connector", "query", F.col("error").alias("message"))]
    for c in ready:
        own = found.where((F.col("connector") == c.name) & F.col("error").isNull())
        tagged = own.select("payload", F.struct("query", "query_ord", "connector_ord", "file").alias("step"))
        hits = _with_step(c, tagged, most)
        if window and c.windowed:
            day = F.to_date("published_at")
            hits = hits.where(day.isNull() | day.between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
        parts.append(hits.withColumn("source_type", F.lit(c.source_type)))
        if c.is_json:
            errors.append(own.where(F.try_parse_json("payload").isNull()).select("connector", "query", F.lit("answer is no JSON").alias("message")))
    missing = run.join(found.select("connector", "query").distinct(), ["connector", "query"], "left_anti").select("connector", "query", F.lit("no saved answer").alias("message"))
    everything = parts[0] if parts else None
    for p in parts[1:]:
        everything = everything.unionByName(p)
    problems = missing
    for e in errors:
        problems = problems.unionByName(e)
    if everything is None:
        everything = spark.createDataFrame([], "url string, title string, snippet string, published_at timestamp, date_estimated boolean, connector string, text_scope string, query string, query_ord int, connector_ord int, file string, place int, source_type string")
    others = [c for c in everything.columns if c != "url"]
    first = everything.groupBy("url").agg(F.min_by(F.struct(*others), F.struct("query_ord", "connector_ord", "file", "place")).alias("h")).select("url", "h.*")
    words = [w for w in re.findall(r"\w+", topic.lower()) if len(w) >= 3 and w not in V.STOPWORDS]
    on = T.contains_any(F.concat_ws(" ", "title", "snippet"), words) if words else F.lit(True)
    rows = first.withColumn("on", F.coalesce(on, F.lit(False)))
    exhausted = not steps.where("NOT run").isEmpty()
    used = [r[0] for r in run.select("connector").distinct().orderBy("connector").collect()]
    return Run(steps, rows.where("on").drop("on"), rows.where("NOT on").drop("on"), problems.distinct(), used, sorted(c.name for c in connectors if c not in ready), exhausted)


def _with_step(c: Connector, rows: DataFrame, most: int) -> DataFrame:
    """c's first ``most`` hits of each answer of rows (payload, step), with the step and the hit's place."""
    parsed = c.parse(rows, keep=("step",))
    placed = parsed.withColumn("place", F.row_number().over(Window.partitionBy("step.file").orderBy("item"))).where(F.col("place") <= most)
    return placed.select(*[x for x in parsed.columns if x not in ("step", "item")], "step.query", "step.query_ord", "step.connector_ord", "step.file", "place")
