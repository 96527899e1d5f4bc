"""Raw web pages: title, date, main text and meta data, read by a standard-library parser in Arrow batches."""

from __future__ import annotations

from datetime import UTC, datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Results depend on these being exactly so.
DATE_NAMES = [
    "article:published_time", "og:article:published_time", "publish-date", "publishdate", "date", "dc.date", "dc.date.issued",
    "parsely-pub-date", "sailthru.date", "citation_publication_date", "citation_date", "dcterms.date", "dcterms.issued", "citation_online_date",
]
SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}
BODY_CLASS = "news-article--content--body--inner"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MOST_META = 30


class _Page(HTMLParser):
    """Text pieces in order; every container is a range of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.pieces, self.title, self.time = {}, [], None, None
        self.open, self.skipping, self.ranges = [], 0, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            if key and a.get("content"):
                self.meta[key] = a["content"]
        if tag == "time" and self.time is None:
            self.time = a.get("datetime") or ""
        if tag in VOID:
            return
        kinds = [tag] if tag in ("article", "main", "div", "section") else []
        if BODY_CLASS in a.get("class", "").split() or a.get("itemprop") == "articleBody":
            kinds.append("chosen")
        found = [] if self.skipping else [[k, len(self.pieces), None] for k in kinds]
        self.ranges += found
        self.open.append((tag, found))
        self.skipping += tag in SKIPPED

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            t, found = self.open.pop()
            self.skipping -= t in SKIPPED
            for r in found:
                r[2] = len(self.pieces)
            if t == tag:
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title" and self.title is None:
            self.title = " ".join(data.split())
        if not self.skipping and (x := data.strip()):
            self.pieces.append(x)

    def main_text(self) -> str:
        ranges = [(k, a, len(self.pieces) if b is None else b) for k, a, b in self.ranges]
        of = lambda *kinds: [r[1:] for r in ranges if r[0] in kinds]
        parts, end = [], -1
        for a, b in of("chosen")[:1] or of("article") or of("main"):
            if a >= end:  # not inside the one before
                parts.append((a, b))
                end = b
        if not parts:
            best = max(of("div", "section"), key=lambda r: sum(map(len, self.pieces[r[0] : r[1]])), default=None)
            parts = [best if best and best[1] > best[0] else (0, len(self.pieces))]
        lines = "\n".join("\n".join(self.pieces[a:b]) for a, b in parts).splitlines()
        return "\n".join(x.strip() for x in lines if len(x.strip()) > 1)


def _moment(text: str) -> datetime | None:
    """A full ISO date or time in UTC; without a zone it counts as UTC; partial dates are none."""
    try:
        d = datetime.fromisoformat(text.strip()) if len(text.strip()) >= 10 else None
    except ValueError:
        return None
    return d and (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC)


def page(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    dates = [p.meta[n] for n in DATE_NAMES if n in p.meta] + [p.time or ""]
    found = next((d for d in map(_moment, dates) if d), None)
    meta = list(p.meta.items())[:MOST_META]
    return {"title": p.meta.get("og:title") or p.title, "published_at": found, "text": p.main_text(), "meta": meta}


RESULT = pa.schema([("title", pa.string()), ("published_at", pa.timestamp("us", "UTC")), ("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))])


def parse_pages(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, published_at, text, meta, content_hash); a null page gives empty text and no title."""
    rows = df.select(F.col(key), F.col(html).alias("html"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = pa.Table.from_pylist([page(x) for x in part.column(1).to_pylist()], RESULT).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([part.column(0), *out.columns], names=[key, *RESULT.names])

    parsed = rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, title string, published_at timestamp, text string, meta map<string,string>")
    return parsed.withColumn("content_hash", F.sha2(F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("title", F.lit(""))), 256))
