"""Page parsing, linear scores and the collection loop."""

from pyspark.sql import functions as F

from signalloom.operators import profile as R
from signalloom.sources.pages import page, parse_pages
from signalloom.streaming import loop
from signalloom.streaming.loop import collect


def test_page():
    p = page('<html><head><title>A &amp; b</title><meta name="date" content="2026-01"><meta property="DC.date" content="2026-01-02"></head><body><nav>menu</nav><article><h1>Head</h1><p>one <b>two</b><br>three</p><article>in</article></article><footer>x</footer><article>next</article></body></html>')
    assert p["title"] == "A & b" and p["text"] == "Head\none\ntwo\nthree\nin\nnext" and str(p["published_at"])[:10] == "2026-01-02"
    assert page('<div>ab<div>longer text</div></div><section>xyz</section><script>var t="</p>";</script>')["text"] == "ab\nlonger text"
    assert page('<time datetime="2026-03-04T01:00:00+02:00">t</time><main>mm</main>')["published_at"].hour == 23
    assert page('<article>no</article><div itemprop="articleBody">yes</div>')["text"] == "yes"
    assert page(None) == {"title": None, "published_at": None, "text": "", "meta": []} and page("<p>a</p>bc</div>")["text"] == "bc"


def test_parse_pages(spark):
    rows = {r.page_id: r for r in parse_pages(spark.createDataFrame([(1, "<main>Hello there</main>"), (2, None)], "page_id long, html string")).collect()}
    assert rows[1].text == "Hello there" and rows[2].text == "" and len(rows[2].content_hash) == 64


def test_linear_score(spark):
    df = spark.createDataFrame([(1, {"a": -2.0, "b": 1.0}), (2, None)], "k int, f map<string,double>")
    rows = {r.k: r for r in R.linear_score(df, "k", "f", {"a": 1.0, "b": 0.5}, 5, 3, 7).collect()}
    assert rows[1].score == 3.5 and [c.name for c in rows[1].contributions] == ["a", "b"] and rows[2].score == 5


def test_loop(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, rows in enumerate([[("https://www.a.b/x/", "one"), ("https://a.b/x", "longer"), (None, "n")], [("https://a.b/x?utm_source=q", "new"), ("https://c.d/y", "other")]]):
        spark.createDataFrame(rows, "url string, payload string").coalesce(1).write.mode("append").json(src)
        collect(spark.readStream.schema("url string, payload string").json(src), out, None).awaitTermination()
    state = {r.normalized_url: (r.payload, r.first_seen[-1], r.last_seen[-1]) for r in spark.read.parquet(f"{out}/state/batch=1").collect()}
    assert state == {"https://a.b/x": ("new", "0", "1"), "https://c.d/y": ("other", "1", "1")}
    assert [r.payload for r in spark.read.parquet(f"{out}/versions/batch=1").collect()] == ["longer"]
    assert {(r.cycle, r.status) for r in spark.read.json(f"{out}/ledger").collect()} == {("cycle-00000000", "ok"), ("cycle-00000001", "ok")}


def test_failed_cycle(spark, tmp_path, monkeypatch):
    src, out, merge = f"{tmp_path}/in", f"{tmp_path}/out", loop.merge_documents

    def broken(*a):
        raise RuntimeError("no merge")

    for i, rows in enumerate([[("https://a.b/x", "one")], [("https://a.b/x", "two"), ("https://c.d/y", "lost?")], [("https://e.f/z", "three")]]):
        monkeypatch.setattr(loop, "merge_documents", broken if i == 1 else merge)
        spark.createDataFrame(rows, "url string, payload string").coalesce(1).write.mode("append").json(src)
        collect(spark.readStream.schema("url string, payload string").json(src), out, None).awaitTermination()
    state = {r.normalized_url: (r.payload, r.first_seen[-1]) for r in spark.read.parquet(f"{out}/state/batch=2").collect()}
    assert state == {"https://a.b/x": ("two", "0"), "https://c.d/y": ("lost?", "2"), "https://e.f/z": ("three", "2")}
    assert [r.status for r in spark.read.json(f"{out}/ledger").orderBy("cycle").collect()] == ["ok", "error", "ok"]
