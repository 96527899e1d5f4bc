"""Document fingerprints by one-permutation MinHash with optimal densification.

Each shingle of ``SHINGLE`` words is hashed once: the high bits choose one of ``BINS`` bins,
and a bin keeps its least value.  An empty bin takes the value of a bin that a fixed hash of
(bin, attempt) chooses, attempt by attempt until a filled one is met, the same way for every
document.  The lowest ``BITS`` bits of each bin are packed.  Two fingerprints' share of equal
bins e estimates the resemblance, corrected for chance agreement c = 2**-BITS: (e-c)/(1-c).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, partitions

#: BITS is 8: one byte for a bin.
SHINGLE, BINS, BITS = 5, 256, 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def donors(bins: int = BINS) -> np.ndarray:
    """donors[attempt][bin]: where an empty bin looks."""
    at = np.arange(8 * bins, dtype=B.U64)[:, None] * B.U64(bins) + np.arange(bins, dtype=B.U64)[None, :]
    return (B.mix((at + B.U64(1)) * B.U64(0x9E3779B97F4A7C15)) % B.U64(bins)).astype(np.int64)


_donors = donors()


def shingles(s: B.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all k-word shingles; a text of one to k-1 words is one shingle."""
    w = B.words(s)
    h = B.word_hashes(s, w)
    ok = np.flatnonzero(B.inside(w, k))
    row = w.row
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    whole = B.span_hashes(h, w.at[short], w.at[short + 1])
    return np.concatenate((B.gram_hashes(h, k)[ok], whole)), np.concatenate((row[ok], short))


def packed(s: B.Slice, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One row of BINS bytes per text, and which texts have words at all; of its shingles, or of the hashes and rows given."""
    h, row = found or shingles(s)
    least = np.full(s.rows * BINS, EMPTY)
    np.minimum.at(least, row * BINS + (h >> B.U64(64 - BINS.bit_length() + 1)).astype(np.int64), B.mix(h) >> B.U64(1))
    least = least.reshape(s.rows, BINS)
    filled = least != EMPTY
    some = filled.any(1)
    dense = least.copy()
    r, c = np.nonzero(~filled & some[:, None])
    for choice in _donors:
        if not len(r):
            break
        hit = filled[r, choice[c]]
        dense[r[hit], c[hit]] = least[r[hit], choice[c[hit]]]
        r, c = r[~hit], c[~hit]
    for i, j in zip(r.tolist(), c.tolist(), strict=True):
        dense[i, j] = least[i][filled[i]][0]
    return (dense & B.U64((1 << BITS) - 1)).astype(np.uint8), some


def fingerprints(s: B.Slice) -> list[str | None]:
    """Packed fingerprints in hexadecimal, None for a text without words."""
    rows, some = packed(s)
    return [rows[i].tobytes().hex() if some[i] else None for i in range(s.rows)]


def likeness(a: str | None, b: str | None) -> float:
    """Estimated resemblance; two texts without words are alike, one of them is like no other."""
    if a is None or b is None:
        return float(a is b)
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint8) for v in (a, b))
    equal = int((x == y).sum())
    chance = 2.0**-BITS
    return float(max(0.0, (equal / BINS - chance) / (1 - chance)))


def fingerprint_texts(texts: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for s in B.slices(pa.array(texts, pa.large_string())):
        out += fingerprints(s)
    return out


def fingerprint_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(original, fingerprint): ``original`` is the input row as a struct; null for a text without words."""
    rows = df.select(F.struct("*").alias("original"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), pa.array(fingerprints(s), pa.string())], names=["original", "fingerprint"])

    return rows.mapInArrow(run, f"original {rows.schema['original'].dataType.simpleString()}, fingerprint string")


def edited(text: str, after: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
GROUP = 1024


def _compare(batches):
    """Rows (part, tail, id, text) sorted by part and order: each document with the one after it.

    A part ends with a tail row, the first document of the next part.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    held: list[tuple] = []
    for b in batches:
        parts, tails, ids, texts = (c.to_pylist() for c in b.columns)
        for a in range(0, len(parts), GROUP):
            own_texts = [x or "" for x in texts[a : a + GROUP]]
            rows = held + list(zip(parts[a : a + GROUP], tails[a : a + GROUP], ids[a : a + GROUP], own_texts, fingerprint_texts(own_texts), strict=True))
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            held = rows[-1:]
            if not pairs:
                continue
            edits = [edited(x[3], y[3]) for x, y in pairs]
            edit = fingerprint_texts(edits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                    pa.array([x[4] or "" for x, _ in pairs], pa.string()),
                    pa.array([e or "" for e in edit], pa.string()),
                    pa.array([likeness(x[4], e) for (x, _), e in zip(pairs, edit, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                ],
                names=names,
            )


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by descending id.

    Equal ids are ordered by their text's hash, null ids come last, and after the last document
    comes the first (a single one follows itself).  Null texts count as empty; texts of any length are
    taken whole; only id_col and text_col are read.  Documents are dealt
    into ranges of ids; a range's last document gets a copy of the next range's first, so no range
    needs another's rows.
    """
    spark = df.sparkSession
    order = ["no_id", "down", "hash"]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumns({"no_id": F.col("id").isNull(), "down": F.expr("coalesce(-id, 0L)"), "hash": F.xxhash64("text")})
    n = 4 * partitions(spark)
    known = F.when(~F.col("no_id"), F.col("down"))
    edges, size, none = rows.agg(F.percentile_approx(known, [i / n for i in range(1, n)], 20 * n), F.count(F.lit(1)), F.count_if("no_id")).first()
    # An id that fills several ranges has them dealt by hash, and so have the rows without id.
    edges = sorted(edges or [])
    below = F.array(*[F.lit(x) for x in edges]) if edges else F.array().cast("array<bigint>")
    ahead, equal = F.size(F.filter(below, lambda x: x < F.col("down"))), F.size(F.filter(below, lambda x: x == F.col("down")))
    place = (F.col("hash") / 2.0**64 + 0.5).cast("double")
    last = len(edges) + 1
    part = F.when(F.col("no_id"), last + F.least(F.floor(place * (1 + none * n // max(size, 1))), F.lit(none * n // max(size, 1)))).otherwise(ahead + F.least(F.floor(place * F.greatest(equal, F.lit(1))), F.greatest(equal - 1, F.lit(0))))
    rows = rows.withColumn("part", part.cast("int"))
    heads = sorted(rows.groupBy("part").agg(F.min(F.struct(*order)).alias("head")).select("part", "head.*").collect())
    if not heads:
        return spark.createDataFrame([], RESULT)
    before = [(heads[i - 1][0], *heads[i][1:]) for i in range(len(heads))]
    tails = F.broadcast(spark.createDataFrame(before, "into int, no_id boolean, down long, hash long"))
    twice = rows.join(tails, order, "left").select(
        "id", "text", *order, F.explode(F.expr("if(into is null, array(named_struct('part', part, 'tail', false)), array(named_struct('part', part, 'tail', false), named_struct('part', into, 'tail', true)))")).alias("place")
    )
    dealt = twice.select("place.*", "id", "text", *order).repartition(partitions(spark), "part").sortWithinPartitions("part", "tail", *order)
    return dealt.select("part", "tail", "id", "text").mapInArrow(_compare, RESULT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
