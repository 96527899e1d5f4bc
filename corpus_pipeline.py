"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet to the shared folder and read again for the next.  The last stage adds ids and
decoded text to the columns of documents.

All stages read the five columns of documents and drop others, so extra columns cannot clash.  A null or empty text is
rejected by the quality rules (it has under ten words); a later stage that is given one keeps it, as the last one does with
no ids.  Repeated rows are one class for near_dedup, which keeps one; a null id, source or language is a value of its own.
Texts of any length are worked on whole, and an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.bpe import encode_documents
from signalloom.llm.common import documents, store
from signalloom.llm.mixing import mix, repeated
from signalloom.llm.near_dedup import drop_near_duplicates
from signalloom.llm.quality_rules import filter_quality
from signalloom.llm.substring_dedup import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(rows: DataFrame) -> DataFrame:
    """Columns of documents of rows (original, kept_text); n_chars follows the text."""
    return rows.select("original.doc_id", F.col("kept_text").alias("text"), "original.lang", "original.source", F.length("kept_text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep: by base rule and by distance within language and source; null and empty texts go, ties and repeated rows are judged alike."""
    return filter_quality(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the least id, null last; texts without words are one class."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a text without any keeps its white space.  All rows stay, a text may end up empty."""
    out = dedup_substrings(docs.select(*COLUMNS))
    return with_text(out.select("original", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("original.text")).alias("kept_text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; the one row a source that is cut keeps its first words.  Texts without words are not taken."""
    return with_text(repeated(mix(docs.select(*COLUMNS))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_tokens, ids and the decoded text; a null text has no ids."""
    return encode_documents(docs.select(*COLUMNS)).select("original.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mixing), ("bpe", encode)]
#: SQL cannot express the robust estimates, the alignment or the tokenizer; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, "stage")
    return docs
