"""Saved answers as a data source, the search plan, stream state and search cycles."""

import datetime
import json
import os
from urllib.parse import quote

from pyspark.sql import datasource as S
from pyspark.sql import functions as F

from signalloom.sources import connectors as C
from signalloom.streaming import cycles, state


def put(folder, connector, day, query, body, kind="json"):
    where = f"{folder}/connector={connector}/day={day}"
    os.makedirs(where, exist_ok=True)
    with open(f"{where}/{quote(query, safe='')}.{kind}", "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())


def github(*names):
    return json.dumps({"items": [{"html_url": f"https://x.org/{n}", "full_name": n, "description": "a quantum battery", "created_at": "2026-01-02T03:04:05Z"} for n in names]})


def crossref(*rows):
    return json.dumps({"message": {"items": [{"URL": u, "title": ["battery"], "issued": {"date-parts": [date]}} for u, date in rows]}})


def test_source(spark, tmp_path):
    """Rows are whole files; filters on connector and day prune the listing; a file that is no text is an error row."""
    root = f"{tmp_path}/saved"
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        put(root, "github", day, "a/b c", github(day))
    put(root, "gdelt", "2026-01-02", "q", b"\xff\xfe\xfa")
    os.makedirs(f"{root}/connector=github/day=soon")
    rows = {(r["connector"], str(r["day"])): r for r in C.answers(spark, root).collect()}
    assert len(rows) == 4 and rows["github", "2026-01-01"]["query"] == "a/b c" and json.loads(rows["github", "2026-01-03"]["payload"])["items"]
    assert rows["gdelt", "2026-01-02"]["payload"] is None and rows["gdelt", "2026-01-02"]["error"].startswith("UnicodeDecodeError")
    day = datetime.date(2026, 1, 2)
    reader = C.Reader({"path": root, "files": "1", "pushdown": "true"})
    assert len(reader.partitions()) == 4
    left = reader.pushFilters([S.GreaterThanOrEqual(("day",), day), S.EqualTo(("connector",), "github"), S.IsNotNull(("day",)), S.StringContains(("payload",), "x")])
    assert len(left) == 4
    assert sorted(a.day.day for p in reader.partitions() for a in p.value) == [2, 3]
    pruned = C.answers(spark, root, pushdown="true").where((F.col("day") == F.lit(day)) & F.col("connector").isin("github", "x"))
    assert [str(r["day"]) for r in pruned.collect()] == ["2026-01-02"]
    whole, part = (C.answers(spark, root, files="1", pushdown="true").where(c).rdd.getNumPartitions() for c in ("true", "day = date'2026-01-03'"))
    assert (whole, part) == (4, 1)
    several = C.answers(spark, root)
    assert several.where("day = date'2026-01-03'").union(several.where("connector = 'gdelt'")).count() == 2
    assert C.answers(spark, root, connectors="github,x", **{"from": "2026-01-02", "to": "2026-01-02"}).count() == 1
    assert C.answers(spark, f"{tmp_path}/none").count() == 0


def test_search(spark, tmp_path):
    """Query-major plan, budget, window, one row an address; broken, missing and unreadable answers are errors beside the others' hits."""
    root = f"{tmp_path}/saved"
    put(root, "github", "2026-01-01", "battery", github("one", "two", "three"))
    put(root, "github", "2026-01-01", "battery pilot", github("two", "four"))
    put(root, "crossref", "2026-01-01", "battery", crossref(("https://d.org/1", [2026, 1, 2]), ("https://d.org/2", [2019]), ("https://x.org/one", [2026, 1, 3]), ("https://d.org/3", [None])))
    put(root, "gdelt", "2026-01-01", "battery", "{broken")
    put(root, "hackernews", "2026-01-01", "battery", json.dumps({"hits": [{"objectID": "7", "url": "", "title": "cooking"}]}))
    put(root, "arxiv", "2026-01-01", "battery", "<feed><entry><id>https://a.org/abs/1</id><title>Battery</title><summary>s</summary><published>2026-01-05T00:00:00Z</published></entry></feed>", "xml")
    keyed = C.Connector("paid", C.P.github, "unknown", key="PAID")
    run = C.search(spark, root, "The battery", ["battery", "battery pilot"], (*C.DEFAULT, keyed), window=("2026-01-01", "2026-12-31"))
    hits = {r["url"]: r for r in run.hits.collect()}
    assert set(hits) == {"https://x.org/one", "https://x.org/two", "https://x.org/three", "https://x.org/four", "https://d.org/1", "https://d.org/3", "https://a.org/abs/1"}
    assert hits["https://x.org/one"]["connector"] == "crossref" and hits["https://x.org/two"]["query"] == "battery"
    assert [r["url"] for r in run.off_topic.collect()] == ["https://news.ycombinator.com/item?id=7"]
    errors = {(r["connector"], r["query"], r["message"]) for r in run.errors.collect()}
    assert ("gdelt", "battery", "answer is no JSON") in errors and ("crossref", "battery pilot", "no saved answer") in errors and not any(c == "github" for c, _, _ in errors)
    assert run.skipped == ["paid"] and run.used == ["arxiv", "crossref", "gdelt", "github", "hackernews"] and not run.budget_exhausted
    steps = run.plan.orderBy("query_ord", "connector_ord").collect()
    assert [r["query"] for r in steps] == ["battery"] * 5 + ["battery pilot"] * 5
    short = C.search(spark, root, "battery", ["battery", "battery pilot"], budget=3.0, most=1)
    assert short.budget_exhausted and short.used == ["arxiv", "crossref", "gdelt"] and {r["url"] for r in short.hits.collect()} == {"https://d.org/1", "https://a.org/abs/1"}
    assert C.search(spark, root, "battery", ["battery"], (keyed,), {"PAID": "k"}).errors.first()["message"] == "no saved answer"
    assert C.search(spark, root, "battery", ["battery"], (keyed,)).hits.count() == 0


def test_state(spark, tmp_path):
    """A batch puts out its own addresses alone; a restart goes on; a late sighting counts but replaces nothing; a heartbeat tells of it."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    beat = state.Heartbeat(spark, str(tmp_path))
    spark.streams.addListener(beat)
    batches = [
        [("https://www.a.b/x/", "one", 10), ("https://a.b/x", "longer", 10), (None, "n", 10), ("https://c.d/y", "y", 11)],
        [("https://a.b/x?utm_source=q", "new", 20)],
        [("https://a.b/x", "old", 5), ("https://c.d/y", "y", 30), ("https://e.f/", None, 30)],
    ]
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame([(u, p, datetime.datetime.fromtimestamp(t, datetime.UTC)) for u, p, t in rows], "url string, payload string, seen_at timestamp").coalesce(1).write.mode("append").json(src)
            stream = spark.readStream.schema("url string, payload string, seen_at timestamp").json(src)
            state.follow(stream, out, None).awaitTermination()
            changes = spark.read.parquet(f"{out}/changes/batch={n}").collect()
            assert len(changes) == (2, 2, 2)[n]
    finally:
        spark.streams.removeListener(beat)
    got = {r["normalized_url"]: (r["payload"], int(r["first_seen"].timestamp()), int(r["last_seen"].timestamp()), r["times_seen"]) for r in state.current(spark, out).collect()}
    assert got == {"https://a.b/x": ("new", 5, 20, 4), "https://c.d/y": ("y", 11, 30, 2)}
    old = spark.read.parquet(f"{out}/changes").where("change = 'archived'").collect()
    assert [(r["payload"], r["times_seen"]) for r in old] == [("longer", 2)]
    with open(f"{tmp_path}/heartbeat.json") as f:
        assert json.load(f)["status"] in ("running", "idle", "stopped", "started")


def test_stream_of_answers(spark, tmp_path):
    """The source as a stream: each answer once, over restarts."""
    root, seen = f"{tmp_path}/saved", []
    for k in range(2):
        put(root, "github", f"2026-01-0{2 - k}", "q", github(str(k)))
        stream = C.answers(spark, root, stream=True).writeStream.foreachBatch(lambda b, n: seen.extend(str(r["day"]) for r in b.select("day").collect()))
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert seen == ["2026-01-02", "2026-01-01"]


def test_cycles(spark, tmp_path):
    """Topics rotate, a follow-up is asked once, a failing connector and a failing cycle leave a report."""
    root, out = f"{tmp_path}/saved", f"{tmp_path}/out"
    put(root, "github", "2026-01-01", "alpha", github("alpha battery"))
    put(root, "github", "2026-01-01", "Cell развитие внедрение применение", github("Cell развитие"))
    put(root, "gdelt", "2026-01-01", "alpha", "broken")
    cands = spark.createDataFrame([("c1", " Cell ", 0.9, True), ("c2", "Other", 0.5, True), ("c3", "Noise", 0.99, False)], "candidate_id string, technology_name string, score double, included boolean")
    topics = {"A": "alpha", "B": "beta", "D": "delta"}
    go = lambda n, **k: cycles.search_cycle(spark, n, out, root, topics, lambda t: [t], cands, most_topics=1, most_adaptive=1, connectors=(C.DEFAULT[2], C.DEFAULT[4]), **k)
    one, two, three = go(0), go(1), go(2)
    assert [one["topics"], two["topics"], three["topics"]] == [["A", "Адаптивно: Cell"], ["B", "Адаптивно: Other"], ["D"]]
    assert one["hits"] == 2 and one["connectors_used"] == ["gdelt", "github"] and ("gdelt", "alpha", "answer is no JSON") in [tuple(e) for e in one["errors"]]
    assert spark.read.parquet(f"{out}/state/batch=1").count() == 2
    bad = go(3, window="nonsense")
    assert bad["status"] == "error" and bad["message"] and go(4)["topics"] == ["B"]
    assert spark.read.json(f"{out}/reports").count() == 5
