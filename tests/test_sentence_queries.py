"""Queries that show sentences, against their SQL on texts with figures and odd spaces at both ends of sentences."""

import duckdb
import pytest

from signalloom.plans import candidates  # noqa: F401
from signalloom.plans.registry import ORACLES, QUERIES

TEXTS = [
    "0997 rehan was shown here. 1 inthe second place. Of all 2 that rehan had with 2",
    "\xa0 Erwh came with 0 or more at 10　",
    "A sentence with nothing but that. \x0b Thst was asked inthe year 1. 11 of them with 1\n",
    None,
    "short. 1",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("figures")
    c = duckdb.connect()
    c.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO d VALUES (?, ?, 'en', 'src', 0)", [(i, t) for i, t in enumerate(TEXTS)])
    c.execute(f"COPY d TO '{where}/documents.parquet' (FORMAT parquet)")
    return str(where)


@pytest.mark.parametrize("name", ["sentences", "evidence_extract", "stable_evidence", "candidate_facts"])
def test_figures_stay(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.execute(ORACLES[name]).fetchall()))


def test_odd_characters(spark, tmp_path):
    """Texts with U+0001, by which the SQL marks its cuts, at edges, alone, twice and after a stop, and with a dotted capital I."""
    texts = ["\x01The rehan was shown here\x01and inthe second place. \x01 Of all that came with", "thst was asked.\x01\x01 And the erwh was shown with it\x01", "\x01", "nothing\x02 but inthe one.\x01The other with that one", "Also \u0130nthe third place we were", "Here \u0130that rehan stood"]
    c = duckdb.connect()
    c.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO d VALUES (?, ?, 'en', 'src', 0)", list(enumerate(texts)))
    c.execute(f"COPY d TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("sentences", "evidence_extract", "stable_evidence", "candidate_facts"):
        want = c.sql(ORACLES[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.execute(ORACLES[name]).fetchall())), name
