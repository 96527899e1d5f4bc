"""The text model, workbooks and cards against plain versions."""

import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import presentation as P
from signalloom.operators import textmodel as M
from signalloom.sources import workbook as B


def test_tfidf_and_text_model(spark):
    """Weights against plain loops, fitted weights against gradient zero of the same loss."""
    r = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(r.choice(words[: 4 if i % 2 else 6]) for _ in range(r.randrange(0, 12))) for i in range(40)]
    rows = [(i, t, int(i % 3 == 0), i // 2) for i, t in enumerate(texts)] + [(40, None, 1, 99), (41, "x y", 0, 99), (42, "alpha", None, 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, grp long")
    known = [x for x in rows if x[2] is not None]
    grams = []
    for x in known:
        w = re.findall(r"\b\w\w+\b", (x[1] or "").lower())
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    total = sum(grams, Counter())
    kept = sorted(total, key=lambda t: (-total[t], t))[:20]
    idf = {t: math.log((1 + len(known)) / (1 + sum(t in g for g in grams))) + 1 for t in kept}
    x = np.zeros((len(known), len(kept)))
    for i, g in enumerate(grams):
        for j, t in enumerate(kept):
            x[i, j] = (1 + math.log(g[t])) * idf[t] if g[t] else 0
        x[i] /= np.linalg.norm(x[i]) or 1
    model = M.fit_text(df, "doc_id", "text", "label", most=20)
    assert set(model["terms"]) == set(kept)
    assert all(abs(model["terms"][t][0] - idf[t]) < 1e-9 for t in kept)
    y = np.array([k[2] for k in known])
    w = np.array([model["terms"][t][1] for t in kept])
    cw = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    p = 1 / (1 + np.exp(-(x @ w + model["intercept"])))
    assert np.abs(x.T @ (cw * (p - y)) + w).max() < 1e-3 and abs((cw * (p - y)).sum()) < 1e-3
    got = {z.doc_id: z.probability for z in M.apply_text(df, model, "doc_id", "text").collect()}
    assert len(got) == 43 and max(abs(got[k[0]] - v) for k, v in zip(known, p)) < 1e-9
    judged = M.judge_text(df, "doc_id", "text", "label", "grp", most=20).toPandas()
    assert sorted(judged.doc_id) == [k[0] for k in known] and judged.merge(df.toPandas(), on="doc_id").groupby("grp").fold.nunique().max() == 1
    with pytest.raises(ValueError, match="both classes"):
        M.fit_text(df.where("label = 1"), "doc_id", "text", "label")


def workbook(path, cells):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><r><t>Gl</t></r><r><t>ass</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    head = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>Year</t></is></c></row>'
    body = '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3"><v>2024</v></c><c r="AA3"><v>9</v></c></row><row r="4"><c r="B4"/></row><row r="5"><c r="C5"><v>1</v></c></row>'
    workbook(tmp_path / "a.xlsx", head + body)
    out = B.read_workbook(spark, str(tmp_path / "a.xlsx"), "S", ["Name", "Year"], ["name", "year"]).orderBy("excel_row").collect()
    assert [(x.excel_row, x.name, x.year) for x in out] == [(3, "Glass", "2024"), (5, None, "1")]
    content = (tmp_path / "a.xlsx").read_bytes()
    for sheet, headers, match in (("T", ["Name", "Year"], "no sheet"), ("S", ["Name", "Month"], "unexpected headers")):
        with pytest.raises(ValueError, match=match):
            B.sheet_rows(content, sheet, headers, 2, 2)
    workbook(tmp_path / "b.xlsx", head + '<row r="3"><c r="B3"><f>1+1</f><v>2</v></c></row>')
    with pytest.raises(ValueError, match="formula in row 3"):
        B.sheet_rows((tmp_path / "b.xlsx").read_bytes(), "S", ["Name", "Year"], 2, 2)


def test_presentation(spark):
    sources = spark.createDataFrame([("a", "s1", "T<1>", "https://x.example/1", "glass sensor here. plan it"), ("a", "s2", "U", "ftp://x", "glass sensor here")], "candidate_id string, source_id string, title string, url string, text string")
    claims = spark.createDataFrame([("a", "s1", "e1", "relevance", "glass"), ("a", "s2", "e2", "early_stage", "not there"), ("a", "s1", "e3", "relevance", "")], "candidate_id string, source_id string, evidence_id string, feature string, quote string")
    matched = P.matched_claims(claims, sources, "candidate_id")
    assert [x.evidence_id for x in matched.collect()] == ["e1"]
    flags = spark.createDataFrame([("a", True, False, True)], "candidate_id string, early_stage boolean, limited_adoption boolean, relevance boolean")
    parts = P.score_parts(flags, matched, "candidate_id")
    assert {x.feature: (x.contribution, x.evidence_ids) for x in parts.collect()} == {"early_stage": (30, []), "limited_adoption": (0, []), "relevance": (30, ["e1"])}
    facts = spark.createDataFrame([("a", "s1", "case", i, "sensor", False) for i in range(6)] + [("a", "s2", "case", 9, "glass", False)], "candidate_id string, source_id string, claim_type string, place int, quote string, is_future boolean")
    quotes = P.excerpts(facts, sources, "candidate_id")
    assert [x.topics for x in quotes.collect()] == [["сенсоры"]] * 4
    named = spark.createDataFrame([("a", "Glass", 60)], "candidate_id string, technology_name string, score int")
    page = P.report(P.cards(named, sources, parts, quotes, "candidate_id"), "q & a", "2026-01-01", "candidate_id")
    assert "T&lt;1&gt;" in page and "q &amp; a" in page and "ftp:" not in page and page.count("<article>") == 1
    titles = named.select(*[P.card_title(F.lit(n), F.lit(3), {"sensor": "Sensors", "glass": "Glass"}, "Research") for n in ("Стекло", "Glass sensor", "x", None)]).first()
    assert list(titles) == ["Стекло", "Sensors · 3", "Research · 3", "Research · 3"]
    kinds = "candidate_id string, score int, decision string, reason string, early_stage boolean, relevance boolean, mass_adoption boolean, industry_standard boolean"
    rated = spark.createDataFrame([(c, i, "needs_review", "insufficient_explicit_evidence", True, True, False, False) for i, c in enumerate("abcdef")], kinds)
    results = spark.createDataFrame([("c", 1), ("zz", 2), ("a", 3), ("c", 4)], "candidate_id string, place int")
    out = P.run_lists(rated, results, 4).orderBy("place").collect()
    assert [(x.candidate_id, x.place, x.preliminary) for x in out] == [("c", 1, False), ("a", 2, False), ("f", 3, True), ("e", 4, True)]
