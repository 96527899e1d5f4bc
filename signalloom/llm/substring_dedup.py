"""Substring dedup: a count-min prefilter, then an exact count of what it lets through.

A window is ``window`` consecutive words of one text.  Each ``part`` consecutive words have a
minimiser, the least hashed ``gram``-word sequence in them (the leftmost of equal ones), which
depends on those words alone: in a repeated window every part's minimiser is repeated, so an
overestimate of minimiser counts overestimates window counts.  Partitions sketch their
minimisers; the sketches are merged cell by cell (saturating at two), and only windows all of
whose minimisers are estimated repeated in every sketch row are grouped exactly, by 128 bits of
hash: whole runs of windows around one minimiser first, single windows where a run stands once.
They are found anew from the texts for the counts and for the marks: that is cheaper than keeping
them.
No repeated window is lost; the sketch only saves work.  Its width follows the input up to
``MAX_LOG_CELLS`` (two bitmaps of 64 MB, the most that is broadcast); past that more windows
reach the exact pass, with the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, partitions, row_key, small_batches, store

WINDOW, PART, GRAM = 35, 18, 8
MIN_LOG_CELLS, MAX_LOG_CELLS, LOG_SHARD = 20, 29, 18
SKETCH_ROWS = 2
FLUSH = 1 << 21


def minimisers(h: np.ndarray, w: B.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams; the starts of the windows that lie in one row; the minimiser's start for each."""
    grams = B.gram_hashes(h, gram)
    at = np.flatnonzero(B.inside(w, window))
    if not len(at):
        return grams, at, at
    bits = max(28, len(grams).bit_length())
    low = B.U64((1 << bits) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=B.U64)
    have, need = 1, window - gram + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return grams, at, (least[at] & low).astype(np.int64)


def cells(grams: np.ndarray, row: int, log_cells: int) -> np.ndarray:
    return (B.mix(grams ^ B.U64(0xA5A5A5A5 + row)) >> B.U64(64 - log_cells)).astype(np.int64)


SKETCH = pa.schema([("shard", pa.int32()), ("entries", pa.binary())])


def sketch(part: int, gram: int, log_cells: int):
    """Per partition: the cells its minimisers fall in; of each entry the lowest bit says whether more than one did."""

    def packed(grams: np.ndarray):
        for row in range(SKETCH_ROWS):
            cell, n = np.unique(cells(grams, row, log_cells), return_counts=True)
            shard = cell >> LOG_SHARD
            entry = (((cell & ((1 << LOG_SHARD) - 1)) << 1) | (n > 1)).astype(np.uint32)
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            ids = (shard[cut] + (row << (log_cells - LOG_SHARD))).astype(np.int32)
            ends = np.append(cut[1:], len(entry))
            yield B.table(SKETCH, [ids, [entry[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for s in B.slices(b.column(0)):
                w = B.words(s)
                grams, _, least = minimisers(B.word_hashes(s, w), w, part, gram)
                if len(least):
                    found = grams[least[np.flatnonzero(np.diff(least, prepend=-1))]]
                    held.append(found)
                    size += len(found)
                if size > FLUSH:
                    yield from packed(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from packed(np.concatenate(held))

    return run


def merge(batches):
    """Sketches sorted by shard: one bitmap per shard of the cells that were hit at least twice."""
    now, counts = None, np.zeros(1 << LOG_SHARD, np.uint8)

    def out():
        return B.table(SKETCH, [[now], [np.packbits(counts > 1, bitorder="little").tobytes()]])

    for b in batches:
        for shard, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if shard != now:
                if now is not None:
                    yield out()
                now, counts = shard, np.zeros(1 << LOG_SHARD, np.uint8)
            e = np.frombuffer(entries, np.uint32)
            counts[e >> 1] = np.minimum(counts[e >> 1] + 1 + (e & 1), 2)
    if now is not None:
        yield out()


class Finder:
    """What the passes over the texts share: candidate windows and their blocks, slice by slice.

    A block is a run of candidate windows with one minimiser; equal blocks have equal windows.
    """

    def __init__(self, window: int, part: int, gram: int, maps):
        self.window, self.part, self.gram, self.maps = window, part, gram, maps

    def hit(self, hashes: np.ndarray, row: int, bits: np.ndarray) -> np.ndarray:
        cell = cells(hashes, row, (len(bits) << 3).bit_length() - 1)
        return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    def blocks(self, s: B.Slice):
        """(words, word hashes, block starts, block lengths, block grams)."""
        w = B.words(s)
        h = B.word_hashes(s, w)
        grams, at, least = minimisers(h, w, self.part, self.gram)
        run = np.zeros(len(h) + 1, np.int64)
        if len(at):
            seen = self.hit(grams, 0, self.maps.value[0]) & self.hit(grams, 1, self.maps.value[1])
            run[at[seen[least]] + 1] = 1
        np.cumsum(run, out=run)
        grams, at, least = minimisers(h, w, self.window, self.gram)
        need = self.window - self.part + 1
        ok = run[at + need] - run[at] == need
        at, least = at[ok], least[ok]
        cut = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(least, prepend=-1) != 0))
        return w, h, at[cut], np.diff(np.append(cut, len(at))), grams[least[cut]]

    def contexts(self, both: list[np.ndarray], starts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        ends = starts + n + self.window - 1
        return [B.span_hashes(h, starts, ends, seed) for seed, h in enumerate(both)]

    def windows(self, both: list[np.ndarray], starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts of the blocks' windows and their two hashes."""
        at, _, _ = B.places(starts, starts + n)
        return at, [B.gram_hashes(h, self.window, seed)[at] if len(at) else np.zeros(0, B.U64) for seed, h in enumerate(both)]


def both_hashes(s: B.Slice, w: B.Words, h: np.ndarray) -> list[np.ndarray]:
    """Two independent hashes of every word: what is grouped by them has 128 bits."""
    return [h, B.word_hashes(s, w, seed=1)]


BLOCKS = "row binary, first int, n int, c1 long, c2 long, gram long"


def find_blocks(f: Finder):
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(0)):
                w, h, starts, n, grams = f.blocks(s)
                if len(starts):
                    row = w.row[starts]
                    c1, c2 = (c.view(np.int64) for c in f.contexts(both_hashes(s, w, h), starts, n))
                    columns = (b.column(1).take(pa.array(s.first + row)), (starts - w.at[row]).astype(np.int32), n.astype(np.int32), c1, c2, grams.view(np.int64))
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return run


def open_bits(batches):
    """Sketch entries of the contexts and grams of blocks (c1, gram, log_cells) found once."""
    for b in batches:
        c1, gram = (np.unique(b.column(i).to_numpy(zero_copy_only=False).view(np.uint64)) for i in (0, 1))
        if len(c1):
            log_cells = b.column(2)[0].as_py()
            for row, hashes in ((0, c1), (1, gram)):
                cell = np.unique(cells(hashes, row, log_cells))
                shard = cell >> LOG_SHARD
                entry = (((cell & ((1 << LOG_SHARD) - 1)) << 1) | 1).astype(np.uint32)
                cut = np.flatnonzero(np.diff(shard, prepend=-1))
                ids = (shard[cut] + (row << (log_cells - LOG_SHARD))).astype(np.int32)
                yield B.table(SKETCH, [ids, [entry[x:y].tobytes() for x, y in zip(cut, np.append(cut[1:], len(entry)), strict=True)]])


def open_windows(f: Finder, opened, marked: bool):
    """Windows of blocks whose gram has an open context: (h1, h2, n) counted per batch; or, if ``marked``, (row, pos, h1, h2) of open blocks."""

    def run(batches):
        contexts, grams_open = opened.value
        for b in batches:
            for s in B.slices(b.column(0)):
                w, h, starts, n, grams = f.blocks(s)
                ok = f.hit(grams, 1, grams_open)
                if marked and len(starts):
                    ok &= f.hit(f.contexts([h], starts, n)[0], 0, contexts)
                if not ok.any():
                    continue
                at, (h1, h2) = f.windows(both_hashes(s, w, h), starts[ok], n[ok])
                if marked:
                    row = w.row[at]
                    columns = {"row": b.column(1).take(pa.array(s.first + row)), "pos": (at - w.at[row]).astype(np.int32), "h1": h1.view(np.int64), "h2": h2.view(np.int64)}
                else:
                    both = np.empty(len(at), [("a", B.U64), ("b", B.U64)])
                    both["a"], both["b"] = h1, h2
                    kinds, count = np.unique(both, return_counts=True)
                    columns = {"h1": kinds["a"].copy().view(np.int64), "h2": kinds["b"].copy().view(np.int64), "n": count}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    return run


def gathered(entries: DataFrame, log_cells: int) -> list[np.ndarray]:
    """The merged bitmaps of sketch entries, at most SKETCH_ROWS * 2**(MAX_LOG_CELLS - 3) bytes."""
    shards = SKETCH_ROWS << (log_cells - LOG_SHARD)
    merged = entries.repartition(min(shards, 4 * partitions(entries.sparkSession)), "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, entries binary")
    maps = [np.zeros(1 << (log_cells - 3), np.uint8) for _ in range(SKETCH_ROWS)]
    per, width = 1 << (log_cells - LOG_SHARD), 1 << (LOG_SHARD - 3)
    for shard, bits in merged.collect():
        maps[shard // per][(shard % per) * width :][:width] = np.frombuffer(bits, np.uint8)
    return maps


def repeated_windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Rows (row, marks): a row's key and the [first, first + n) word positions where windows start that also start elsewhere.

    Whole blocks are counted first.  Blocks found twice or more are repeated; only where a block
    stands once are its windows, and those of other blocks around the same gram, counted singly.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    part, gram = min(PART, window), min(GRAM, window)
    spark = df.sparkSession
    texts = df.select(F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_cells = min(MAX_LOG_CELLS, max(MIN_LOG_CELLS, math.ceil(math.log2(size / 12 + 1))))
    maps = gathered(texts.select("text").mapInArrow(sketch(part, gram, log_cells), "shard int, entries binary"), log_cells)
    f = Finder(window, part, gram, spark.sparkContext.broadcast(maps))
    blocks = texts.mapInArrow(find_blocks(f), BLOCKS)
    contexts = store(blocks.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.min("gram").alias("gram")), "contexts")
    alone = contexts.where("times = 1")
    log_open = min(MAX_LOG_CELLS, max(MIN_LOG_CELLS, math.ceil(math.log2(16 * alone.count() + 1))))
    single = alone.select("c1", "gram", F.lit(log_open).alias("log_cells"))
    opened = spark.sparkContext.broadcast(gathered(single.mapInArrow(open_bits, "shard int, entries binary"), log_open))
    whole = blocks.select("row", "first", "n", "c1", "c2").join(contexts.where("times > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("row", "first", "n")
    counted = texts.mapInArrow(open_windows(f, opened, False), "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2")
    singly = texts.mapInArrow(open_windows(f, opened, True), "row binary, pos int, h1 long, h2 long").join(counted, ["h1", "h2"], "left_semi").select("row", F.col("pos").alias("first"), F.lit(1).alias("n"))
    return whole.union(singly).groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("marks"))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove every word that a repeated window covers; windows are judged on the input.

    Returns (original, kept_text, n_words, n_removed, spans): ``original`` is the whole input row
    as a struct, so no column of it can clash; ``spans`` are the removed [first, end) word ranges.
    A null or empty text, and one shorter than a window, loses nothing (kept_text is its words
    joined by one space).  Rows with equal id and text count as separate places: each loses what
    the other repeats; their marks are the same and are kept once, so n equal rows cost n times one.
    A text is worked on whole, whatever its length.  An empty table gives an empty result.
    """
    marks = repeated_windows(small_batches(df), id_col, text_col, window)
    rows = df.select(F.struct("*").alias("original"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    both = rows.join(marks, "row", "left").select("original", "text", "marks")
    kind = rows.schema["original"].dataType.simpleString()
    return both.mapInArrow(_cut(window), f"original {kind}, kept_text string, n_words long, n_removed long, spans array<struct<first:int,end:int>>")


def _cut(window: int):
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            marks = b.column(2)
            texts, n_words, n_removed, cut = [], [], [], []
            for s in B.slices(b.column(1)):
                w = B.words(s)
                part = marks.slice(s.first, s.rows)
                sizes = np.asarray(part.value_lengths().fill_null(0))
                first, n = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
                starts = np.repeat(w.at[:-1], sizes) + first
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + n + window - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                texts.append(B.joined_words(s, w, ~gone))
                n_words.append(w.counts)
                n_removed.append(B.per_row(gone, w.at))
                edges = B.spans(B.Slice(0, gone.view(np.uint8), w.at), ~gone)
                base = np.repeat(w.at[:-1], edges.counts)
                value = pa.StructArray.from_arrays([pa.array((edges.starts - base).astype(np.int32)), pa.array((edges.ends - base).astype(np.int32))], ["first", "end"])
                cut.append(pa.ListArray.from_arrays(pa.array(edges.at.astype(np.int32)), value))
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.concat_arrays(texts).cast(pa.string()), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.concat_arrays(cut).cast(span)],
                    names=["original", "kept_text", "n_words", "n_removed", "spans"],
                )

    return run


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("original.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
