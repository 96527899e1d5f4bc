"""The llm operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = ("substring_dedup", "bpe", "quality_classifier", "near_dedup", "licenses", "lm", "token_counts", "fingerprints", "quality_rules", "mixing", "decontamination", "alignment", "whitening")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    _module = importlib.import_module(f"signalloom.llm.{_m}")
    QUERIES.update({k: v for k, v in vars(_module).items() if k.startswith("op") and k[2:3].isdigit()})
    ORACLES.update(getattr(_module, "ORACLES", {}))

import corpus_pipeline  # noqa: E402

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
