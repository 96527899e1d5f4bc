"""Near-duplicate classes by Order MinHash, candidates verified by banded alignment.

Texts with the same words are one node.  A node's ``KMER``-word sequences are labelled with
their occurrence number; each of ``SKETCHES`` orderings picks the ``SAMPLED`` least of them, and
the sketch is these in text order, so it agrees for texts that are close in edit distance.  Two
texts of similarity s agree in a given sketch with a chance of about s**SAMPLED; at 0.8, 20
sketches of 3 all miss once in a million pairs.

Nodes that share a sketch form a bucket.  Each is compared with the bucket's centre, the member
with the most company over all its buckets (in a group of copies of one text, most likely that
text).  Verified links give components.  Where a bucket still holds several, every member outside
its largest component is compared with all others, in blocks of bounded size; a pair is looked at
in the first sketch it shares only, and goes on only if the sets of its k-mers' 16-bit hashes may
belong to a link.  So no pair within a bucket is left out, and a large group whose members link to its
centre costs one comparison each.

Verification aligns the two texts' labelled k-mers, the first occurrence of a sequence with the first, the second
with the second, within the band that the threshold leaves: similarity is aligned / (all - aligned), which is the
likeness of the two multisets of sequences where their order agrees; a text and its double have 0.5.  As no labelled k-mer
stands twice, the best alignment is a longest increasing run of places; it takes memory in proportion to the texts.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, row_key, small_batches, store
from signalloom.llm.components import components
from signalloom.llm.fingerprints import BINS, packed, shingles

KMER, SAMPLED, SKETCHES, SIMILARITY = 5, 3, 20, 0.8
#: How far a fingerprint's likeness may fall short of the threshold: about five standard errors.
SLACK = 0.13
#: How far the likeness of sets of 16-bit hashes may fall short: what collisions take from a union.
HASH_SLACK = 0.03
LEFT_BLOCK, RIGHT_BLOCK = 256, 2048
ORDERS = B.mix(np.arange(1, SKETCHES + 1, dtype=B.U64) * B.U64(0xD1342543DE82EF95)) | B.U64(1)


def labelled(s: B.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and labels of all k-mers in text order, row after row; a label is the hash joined with how often it stood before in its row."""
    h, row = shingles(s, KMER)
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    order = np.lexsort((h, row))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    at = np.arange(len(h))
    n = np.empty(len(h), np.int64)
    n[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return h, row, B.mix(h + n.astype(B.U64) * B.U64(0x9E3779B97F4A7C15))


def order_sketches(rows: int, h: np.ndarray, row: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """rows x SKETCHES, zeros for a text without words, of labelled k-mers."""
    out = np.zeros((rows, SKETCHES), B.U64)
    if not len(h):
        return out
    cut = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(np.append(cut, len(row)))
    for k, by in enumerate(ORDERS):
        v = labels * by
        at = np.full((len(cut), SAMPLED), len(h))
        for j in range(SAMPLED):
            least = np.minimum.reduceat(v, cut)
            hit = np.flatnonzero((v == np.repeat(least, sizes)) & (v != B.U64(0xFFFFFFFFFFFFFFFF)))
            which = np.searchsorted(cut, hit, "right") - 1
            at[which, j] = hit
            v[hit] = B.U64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        padded = np.append(h, B.U64(0))
        key = np.full(len(cut), B.U64(k + 1))
        for j in range(SAMPLED):
            key = B.mix(key * B.U64(0xD1342543DE82EF95) + padded[at[:, j]])
        out[row[cut], k] = key
    return out


SKETCHED = "key binary, id long, n1 long, n2 long, n_kmers long, sketch array<long>, print binary"


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = small_batches(df).select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(2)):
                w = B.words(s)
                h = B.word_hashes(s, w)
                n1, n2 = (pa.array(B.span_hashes(x, w.at[:-1], w.at[1:], seed).view(np.int64)) for seed, x in enumerate((h, B.word_hashes(s, w, seed=1))))
                found, row, labels = labelled(s)
                values = order_sketches(s.rows, found, row, labels)
                kmers_of = np.where(w.counts < KMER, 0, w.counts - KMER + 1)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(s.rows + 1, dtype=np.int32) * SKETCHES), pa.array(values.view(np.int64).ravel()))
                prints, _ = packed(s, (labels, row))
                off = np.arange(s.rows + 1, dtype=np.int32) * BINS
                binary = pa.BinaryArray.from_buffers(pa.binary(), s.rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(prints.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, s.rows), b.column(1).slice(s.first, s.rows), n1, n2, pa.array(kmers_of), sketch, binary], names=["key", "id", "n1", "n2", "n_kmers", "sketch", "print"]
                )
        B.give_back()

    return rows.mapInArrow(run, SKETCHED)


def increasing(places: np.ndarray) -> int:
    """Length of a longest increasing subsequence of different numbers."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for x in places.tolist():
        if not ends or x > ends[-1]:
            ends.append(x)
        else:
            ends[bisect_left(ends, x)] = x
    return len(ends)


def alignment_similarity(x: np.ndarray, y: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Aligned k-mers over all, of two texts' labelled k-mers in text order; 0 below the threshold.

    The band is as wide as k-mers can stand unmatched if the threshold is met; matches outside it
    belong to no alignment that does.
    """
    all_of = len(x) + len(y)
    need = threshold * all_of / (1 + threshold) - 1e-9
    if not all_of or min(len(x), len(y)) < need:
        return 0.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    band = all_of - 2 * need
    inside = np.abs(i - j) <= band
    if inside.sum() < need:
        return 0.0
    i, j = i[inside], j[inside]
    n = increasing(j[np.argsort(i)])
    return n / (all_of - n) if n >= need else 0.0


def kmers(texts: DataFrame, short: bool = False) -> DataFrame:
    """(node, kmers): the labels of all k-mers of rows (node, text) in text order; if ``short``, their distinct leading 16 bits."""

    def run(batches):
        for b in batches:
            out = []
            for s in B.slices(b.column(1)):
                _, row, labels = labelled(s)
                cut = np.searchsorted(row, np.arange(s.rows + 1))
                for i, j in zip(cut, cut[1:], strict=False):
                    own = labels[i:j]
                    out.append((np.unique(own >> B.U64(48)).astype("<u2") if short else own).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "kmers"])
        B.give_back()

    return texts.select("node", "text").mapInArrow(run, "node long, kmers binary")


def verify(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, kmers) are linked."""
    one = texts.select(F.col("node").alias("a"), F.col("kmers").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("kmers").alias("y"))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            pick = lambda c, i: np.frombuffer(c[i].as_buffer(), B.U64)
            mask = pa.array([alignment_similarity(pick(xs, i), pick(ys, i), threshold) >= threshold - 1e-9 for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)
        B.give_back()

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    chance = 1 / 256
    return ((x == y).mean(-1) - chance) / (1 - chance)


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose lengths and fingerprints may belong to a link."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("n_kmers").alias(f"n{c}"), F.col("print").alias(f"p{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where(_near_length("na", "nb", threshold))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                mask = pa.array(_alike(x, y) >= threshold - SLACK)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def _near_length(x: str, y: str, threshold: float):
    return F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's centre a and its other members b, of rows (bucket, node, size)."""
    company = buckets.groupBy("node").agg(F.sum(F.col("size") - 1).alias("company"))
    centres = buckets.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("c")).select("bucket", F.col("c.node").alias("a"))
    return buckets.join(centres, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def rest_pairs(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, texts_of, threshold: float) -> DataFrame:
    """Likely pairs (a, b) of different components in one bucket, found in blocks, each once."""
    rows = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    parts = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    split = split.select(
        "bucket", F.col("m.label").alias("major"), F.ceil((F.col("members") - F.col("m.n")) / LEFT_BLOCK).cast("int").alias("lefts"), F.ceil(F.col("members") / RIGHT_BLOCK).cast("int").alias("rights")
    )
    rows = store(rows.join(split, "bucket"), "rest")
    place = F.abs(F.xxhash64("node"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("label <> major").select("bucket", "node", "label", (place % F.col("lefts")).cast("int").alias("l"), each("rights").alias("r"), F.lit(True).alias("left"))
    right = rows.select("bucket", "node", "label", each("lefts").alias("l"), (place % F.col("rights")).cast("int").alias("r"), F.lit(False).alias("left"))
    kinds = store(kmers(texts_of(rows.select("node").distinct()), short=True), "kinds").select("node", F.col("kmers").alias("kinds"))
    both = left.unionByName(right).join(nodes.select("node", "n_kmers", "sketch").join(kinds, "node"), "node").join(rows.select("bucket", "node", F.col("major").alias("m")), ["bucket", "node"])

    def run(table: pa.Table) -> pa.Table:
        bucket, node, label, n, major = (np.asarray(table.column(c)) for c in ("bucket", "node", "label", "n_kmers", "m"))
        is_left = np.asarray(table.column("left"))
        sketch = np.asarray(table.column("sketch").combine_chunks().flatten()).reshape(-1, SKETCHES)
        kinds = [np.frombuffer(x, "<u2") for x in table.column("kinds").to_pylist()]
        size = np.array([len(x) for x in kinds])
        a_s, b_s = [], []
        rights = np.flatnonzero(~is_left)
        place = np.zeros(len(node), np.int64)
        place[rights] = np.arange(len(rights))
        bits = np.zeros((len(rights), 1 << 13), np.uint8)
        for p, i in enumerate(rights):
            np.bitwise_or.at(bits[p], kinds[i] >> 3, np.uint8(1) << (kinds[i] & 7).astype(np.uint8))
        for i in np.flatnonzero(is_left):
            j = rights[label[rights] != label[i]]
            j = j[(label[j] == major[j]) | (node[j] < node[i])]
            j = j[np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9]
            if not len(j):
                continue
            shared = sketch[j] == sketch[i]
            first = shared.argmax(1)
            j = j[sketch[i][first] == bucket[i]]
            if len(j):
                common = (bits[np.ix_(place[j], kinds[i] >> 3)] >> (kinds[i] & 7).astype(np.uint8) & 1).sum(1, dtype=np.int64)
                j = j[common >= (threshold - HASH_SLACK) * (size[i] + size[j] - common)]
            a_s.append(np.full(len(j), node[i]))
            b_s.append(node[j])
        del bits
        B.give_back()
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a_s]), "b": np.concatenate([none, *b_s])})

    return both.groupBy("bucket", "l", "r").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(key, id, node, class_node, class_id, class_size) for every row.

    class_id is the least id of the row's class.  Texts with the same words (by 128 bits of two
    independent hashes), null and empty ones among themselves too, are one class; texts under KMER
    words link to no other.  Rows with null ids take part, and a class of nothing else has a null
    class_id.  Repeated rows are one node.  Texts of any length are sketched and aligned whole.  Only
    id_col and text_col are read, so other columns cannot clash.  An empty table gives no rows.
    """
    rows = store(sketched(df, id_col, text_col), "sketches")
    nodes = rows.groupBy("n1", "n2").agg(
        F.min("key").alias("key"), F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n_kmers").alias("n_kmers"), F.first("sketch").alias("sketch"), F.first("print").alias("print")
    )
    nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.where("n_kmers > 0").select("node", F.explode("sketch").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = store(placed.join(sizes, "bucket"), "buckets")
    first = store(likely(star_pairs(buckets), nodes, threshold), "pairs")
    source = df.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        return source.join(wanted.join(nodes.select("node", "key"), "node"), "key").dropDuplicates(["node"]).select("node", "text")

    def links(pairs: DataFrame) -> DataFrame:
        texts = store(kmers(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())), "kmers")
        return store(verify(texts, pairs, threshold), "links")

    found = links(first)
    labels = components(found)
    rest = rest_pairs(buckets, nodes, labels, texts_of, threshold).join(first, ["a", "b"], "left_anti")
    rest = store(rest.join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = links(rest)
        if not more.isEmpty():
            labels = components(found.union(more))
    out = nodes.select("n1", "n2", "node", "id", "copies").join(labels, "node", "left").withColumn("class_node", F.coalesce("label", "node"))
    classes = out.groupBy("class_node").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    classed = out.join(classes, "class_node").select("n1", "n2", "node", "class_node", "class_id", "class_size")
    return rows.select("key", "id", "n1", "n2").join(classed, ["n1", "n2"]).select("key", "id", "node", "class_node", "class_id", "class_size")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one of the least id (null last), all columns as they are."""
    found = near_duplicates(df, id_col, text_col, threshold)
    kept = found.groupBy("class_node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("r")).select(F.col("r.key").alias("key"))
    rows = df.select(F.struct("*").alias("original"), row_key(id_col, text_col).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("original.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size")
