"""Token counts from an exact histogram of encoded lengths.

Documents are encoded and counted by length, with partial counts before the shuffle.  Suffix
sums over the lengths then answer, for every context limit L that is some document's length:
how many documents and tokens there are in all, up to L and above L, which quantile L is, and
how many tokens are left when every text is cut at L.  Limits in between follow from the next
smaller length's row (``truncated_total``).  Suffix sums run inside blocks of lengths; only
one row per block meets in a single task.

The library's pattern engine fails on very long white space, so a long text is encoded in pieces.  The
pattern never matches across a place where white space follows anything else, so texts are cut there;
a run of white space over ``LONG_GAP`` characters, whose pre-tokens are known without the pattern, goes
to the merge step alone.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import documents, small_batches, store

VOCABULARY, BLOCK = "byte_bpe_50k.tiktoken", 1024
PIECE, LONG_GAP = 1 << 16, 1 << 12
#: White space as the pattern engine has it (Unicode's White_Space).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_long_gap = re.compile("[%s]{%d,}" % (WHITE, LONG_GAP))
_edge = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def pieces(text: str) -> list[str]:
    """The text cut before white space that follows something else, about every PIECE characters."""
    out, at = [], 0
    for place in _edge.finditer(text):
        if place.start() - at >= PIECE:
            out.append(text[at : place.start()])
            at = place.start()
    return [*out, text[at:]]


def encoded_length(e, text: str) -> int:
    """Tokens of a whole text of any length, as the library counts them."""
    if len(text) <= LONG_GAP:
        return len(e.encode_ordinary(text))
    n, at = 0, 0
    for gap in _long_gap.finditer(text):
        # All but the last of the white space before a word is one pre-token, all of it at the end of the text.
        end = gap.end() if gap.end() == len(text) else gap.end() - 1
        n += sum(len(e.encode_ordinary(x)) for x in pieces(text[at : gap.start()])) + len(e._encode_single_piece(text[gap.start() : end]))
        at = end
    return n + sum(len(e.encode_ordinary(x)) for x in pieces(text[at:]))


def _lengths(path: str):
    def run(batches):
        e = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encoded_length(e, x.as_py()) if x.is_valid else 0 for x in b.column(0)], pa.int64())], names=["length"])

    return run


def length_histogram(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many texts have each encoded length.  Null counts as empty: length 0."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    lengths = small_batches(df).select(F.col(text_col).alias("text")).mapInArrow(_lengths(path), "length long")
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def token_counts(df: DataFrame, text_col: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per encoded length, taken as a context limit.

    Columns: length, n_docs, n_tokens (of that length), docs_longer, tokens_longer (suffix sums
    above the limit), docs_total, tokens_total, docs_within, quantile (share of documents of at
    most that length), truncated_tokens (tokens left when each text is cut at the limit).
    An empty table gives no rows; ties and repeated rows share a row.  Texts are encoded once, whole,
    whatever their length.  Only text_col is read, so other columns cannot clash.
    """
    rows = store(length_histogram(df, text_col, path), "lengths").select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.expr(f"length div {block}").alias("block"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    sums = sums.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in "dt"), F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inner = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.coalesce(F.sum("n_docs").over(inner), F.lit(0)) + F.col("d_after")).alias("docs_longer"),
        (F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)) + F.col("t_after")).alias("tokens_longer"),
        "docs_total",
        "tokens_total",
    )
    return out.withColumns(
        {
            "docs_within": F.col("docs_total") - F.col("docs_longer"),
            "quantile": (F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total"),
            "truncated_tokens": F.col("tokens_total") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"),
        }
    )


def truncated_total(counts: DataFrame, limit: int) -> int:
    """Tokens left when every text is cut at ``limit``, whether or not some text has that length."""
    row = counts.agg(
        F.max_by("tokens_longer", F.when(F.col("length") <= limit, F.col("length"))).alias("longer"),
        F.max_by("docs_longer", F.when(F.col("length") <= limit, F.col("length"))).alias("docs"),
        F.max("tokens_total").alias("tokens"),
        F.max("docs_total").alias("all"),
        F.min("length").alias("least"),
    ).first()
    if row["tokens"] is None:
        return 0
    longer, docs = (row["tokens"], row["all"]) if row["least"] > limit else (row["longer"], row["docs"])
    return row["tokens"] - longer + limit * docs


def length_quantile(counts: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents do not exceed."""
    return counts.where(F.col("docs_within") >= share * F.col("docs_total")).agg(F.min("length")).first()[0]


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
