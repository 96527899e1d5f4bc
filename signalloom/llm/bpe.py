"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last ``ROLL`` bytes meets a pattern, so shared
passages give the same chunks in every document, whatever stands before them.  Each worker
encodes a chunk once and keeps its ids (at most ``CHUNK_MEMO_BYTES``); a copy of it anywhere
costs one look-up.

The ids at a join of two chunks are wrong where the cut broke a pre-token, so the join is
repaired: a window over the left chunk's last words and the right chunk's first ones is encoded
again, and its ids are held against those of the two chunks.  If the window's outer words have
the same ids in the window as in their chunks, and the chunks' ids end and begin with those
of their sides of the window, the window's ids replace them.  If not, the window takes twice as
many words on both sides, until all agree; two chunks that never agree become one and are encoded
whole, as is a text without places to cut windows at.

Where the tokenizer's pre-tokens hold no white space, which is tried out on ``PROBES`` and on a
chunk of every slice, a new chunk's words are looked up in a memo, and only words not met before
reach the library, many in one call.  For any other tokenizer the library encodes whole chunks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, small_batches

ROLL, MEAN_CHUNK_BITS = 48, 9
CHUNK_MEMO_BYTES, WORD_MEMO, ENTRY_BYTES = 40 << 20, 250_000, 400
SLICE_BYTES, WORD_BATCH, DECODE_BLOCK = 1 << 18, 4_000, 1 << 16
VOCABULARY = "word_bpe_49k.json"
#: A word of its own that stands between words encoded in one call.
BREAK = b"\x01"
PROBES = ("a b", " a", "a ", "a  b", "a\tb\nc", "Ab, cd. 12 (x)", "don't we've", "\u00e9 e\u0301 \u0301a", "x\u00a0y z", "<|endoftext|> a", "! ? ...")
EDGE_BYTES = 80
_sync = re.compile(rb"\S\s")
_codecs: dict[str, Codec] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunk:
    """A chunk's ids (little-endian uint32) and the places where windows may be cut: before white space that follows something else."""

    __slots__ = ("ids", "first", "last", "text")

    def __init__(self, text: bytes):
        self.text, self.ids = text, b""
        self.first = [m.start() + 1 for m in _sync.finditer(text, 0, EDGE_BYTES)]
        self.last = [m.start() + 1 for m in _sync.finditer(text, max(0, len(text) - EDGE_BYTES))]
        if len(self.first) < 2 or len(self.last) < 2 or self.first[1] > self.last[-2]:
            self.all_places()

    def all_places(self) -> None:
        self.first = self.last = [m.start() + 1 for m in _sync.finditer(self.text)]

    def places(self, words: int) -> bool:
        """Whether windows of ``words`` whole words can be cut at both ends without meeting."""
        if len(self.first) <= words or len(self.last) <= words:
            if self.first is not self.last:
                self.all_places()
        return len(self.first) > words and len(self.last) > words and self.first[words] <= self.last[-1 - words]


class Codec:
    """A worker's tokenizer with its memos of words' and chunks' ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.chunk_bytes = 0
        self.encoded_chunks = self.reused_chunks = self.widened = self.fused = 0
        self.by_words = all(self.library([x])[0] == b"".join(self.library(x.encode().split())) for x in PROBES)
        mark = self.library([BREAK])[0]
        self.mark = int.from_bytes(mark, "little") if self.by_words and len(mark) == 4 else None
        pieces = [(t.id_to_token(i) or "").encode() + b" " for i in range(t.get_vocab_size())]
        self.piece_data = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate(([0], np.cumsum([len(x) for x in pieces])))

    def library(self, texts: list) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x if isinstance(x, str) else x.decode() for x in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, new: set[bytes]) -> None:
        """Encodes words; those of a batch in one call, told apart by the break's id, which no other word gives."""
        todo = list(new)
        for a in range(0, len(todo), WORD_BATCH):
            part = todo[a : a + WORD_BATCH]
            plain = [x for x in part if BREAK not in x] if self.mark is not None else []
            if len(plain) > 1:
                ids = np.frombuffer(self.library([(b" %s " % BREAK).join(plain)])[0], "<u4")
                at = np.flatnonzero(ids == self.mark)
                if len(at) == len(plain) - 1:
                    raw, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                    start = 0
                    for word, end in zip(plain, ends, strict=True):
                        self.words[word] = raw[start:end]
                        start = end + 4
                    part = [x for x in part if BREAK in x]
            if part:
                self.words.update(zip(part, self.library(part), strict=True))

    def encode_each(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, each as if it stood alone."""
        if not self.by_words:
            return self.library(texts)
        split = [x.split() for x in texts]
        words = set().union(*split)
        missing = words.difference(self.words)
        if len(self.words) + len(missing) > WORD_MEMO:
            # Words not used since the memo was last full are forgotten.
            self.words, self.older, missing = {}, self.words, words
        older = self.older
        found = {w: older[w] for w in missing if w in older}
        self.words.update(found)
        self.learn(missing.difference(found))
        known = self.words
        out = []
        for x in split:
            out.append(b"".join([known[w] for w in x]))
        return out

    def fill(self, chunks: list[Chunk]) -> None:
        """Ids of chunks, of equal ones once; chunks met before are looked up."""
        fresh: dict[bytes, Chunk] = {}
        for c in chunks:
            old = self.chunks.get(c.text) or fresh.get(c.text)
            if old is None:
                fresh[c.text] = c
            else:
                self.reused_chunks += 1
        self.encoded_chunks += len(fresh)
        for c, ids in zip(fresh.values(), self.encode_each(list(fresh)), strict=True):
            c.ids = ids
        for c in chunks:
            if not c.ids:
                c.ids = (self.chunks.get(c.text) or fresh[c.text]).ids
        size = sum(len(x) + len(c.ids) + ENTRY_BYTES for x, c in fresh.items())
        if self.chunk_bytes + size > CHUNK_MEMO_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        if size <= CHUNK_MEMO_BYTES:
            self.chunks.update(fresh)
            self.chunk_bytes += size

    def check(self, chunk: Chunk) -> bool:
        """Whether the memo's ids of a chunk are the library's; if not, words are not looked up from here on."""
        if not self.by_words or self.library([chunk.text])[0] == chunk.ids:
            return True
        self.by_words = False
        self.words, self.older = {}, {}
        self.chunks.clear()
        self.chunk_bytes = 0
        return False

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Each text is the list of its chunks' bytes; its ids are those of the whole text."""
        plans = [self.cut([Chunk(x) if x not in self.chunks else self.chunks[x] for x in chunks]) for chunks in texts]
        flat = [c for plan in plans for c in plan]
        self.fill(flat)
        if flat and not self.check(flat[len(flat) // 2]):
            return self.encode(texts)
        #: repaired[i][j] is (ids to drop on the left, ids of the window, ids to drop on the right) of the join after chunk j.
        repaired: list[dict[int, tuple]] = [{} for _ in plans]
        todo = [(i, j, 1) for i, plan in enumerate(plans) for j in range(len(plan) - 1)]
        while todo:
            todo = self.repair(plans, repaired, todo)
        out = []
        for plan, joins in zip(plans, repaired, strict=True):
            parts, skip = [], 0
            for j, c in enumerate(plan):
                if j in joins:
                    drop, window, after = joins[j]
                    parts += (c.ids[skip : len(c.ids) - drop], window)
                    skip = after
                else:
                    parts.append(c.ids[skip:])
            out.append(b"".join(parts))
        return out

    def cut(self, chunks: list[Chunk]) -> list[Chunk]:
        """Chunks at both ends of which a window of a whole word can be cut; others become one with a neighbour."""
        plan: list[Chunk] = []
        run: list[bytes] = []
        for c in chunks:
            if run:
                run.append(c.text)
                # A run is joined only once, when the chunk that ends it is found.
                if c.places(1):
                    c, run = Chunk(b"".join(run)), []
                else:
                    continue
            if c.places(1):
                plan.append(c)
            else:
                run.append(c.text)
        if run:
            rest = b"".join(run)
            plan = [*plan[:-1], Chunk(plan[-1].text + rest)] if plan else [Chunk(rest)] if rest else []
        return plan

    def repair(self, plans: list[list[Chunk]], repaired: list[dict], todo: list[tuple]) -> list[tuple]:
        """Encodes the windows of these joins (text, chunk, words) and returns those that must be wider."""
        windows = []
        for i, j, n in todo:
            a, b = plans[i][j], plans[i][j + 1]
            if not (a.places(n) and b.places(n)):
                continue
            x, y = a.last[-1 - n], b.first[n]
            windows += (a.text[x:], b.text[:y], a.text[x:] + b.text[:y], a.text[x : a.last[-n]], b.text[b.first[n - 1] : y])
        found = iter(self.encode_each(windows))
        wider = []
        for i, j, n in todo:
            a, b = plans[i][j], plans[i][j + 1]
            if not (a.places(n) and b.places(n)):
                self.fused += 1
                return self.fuse(plans, repaired, i)
            left, right, window, first, last = (next(found) for _ in range(5))
            agree = a.ids.endswith(left) and b.ids.startswith(right) and left.startswith(first) and right.endswith(last)
            if agree and first and last and len(window) >= len(first) + len(last) and window.startswith(first) and window.endswith(last):
                repaired[i][j] = (len(left), window, len(right))
            else:
                self.widened += 1
                wider.append((i, j, 2 * n))
        return wider

    def fuse(self, plans: list[list[Chunk]], repaired: list[dict], i: int) -> list[tuple]:
        """Text i becomes one chunk; all joins of other texts that are not repaired yet start anew."""
        plans[i] = [Chunk(b"".join(c.text for c in plans[i]))]
        plans[i][0].ids = self.library([plans[i][0].text])[0]
        repaired[i] = {}
        return [(k, j, 1) for k, plan in enumerate(plans) for j in range(len(plan) - 1) if j not in repaired[k]]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decoded texts ids[at[i]:at[i + 1]]; a tokenizer without a decoder joins its pieces by spaces."""
        if self.tokenizer.decoder is not None:
            return [x.encode() for x in self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)], skip_special_tokens=False)]
        sizes = np.diff(self.piece_at)[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        parts = []
        for k in range(0, len(ids), DECODE_BLOCK):
            index, _, _ = B.places(self.piece_at[ids[k : k + DECODE_BLOCK]], self.piece_at[ids[k : k + DECODE_BLOCK] + 1])
            parts.append(self.piece_data[index].tobytes())
        whole = b"".join(parts)
        places = ends[at].tolist()
        return [whole[a : b - 1] if b > a else b"" for a, b in zip(places, places[1:], strict=False)]


def cuts(s: B.Slice, bits: int = MEAN_CHUNK_BITS, roll: int = ROLL) -> np.ndarray:
    """Sorted byte positions where chunks end: row ends and, before a whole code point, the rolling hash's choice."""
    n = len(s.data)
    if n <= roll:
        return s.off
    powers = np.full(n + 1, MULTIPLIER, B.U64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, B.U64)
    np.cumsum(B.BYTE_CODE[s.data] * powers[:n], out=sums[1:])
    at = np.arange(roll, n)
    # The pattern is looked for in the lowest bits that the window's place does not reach: h = sum / MULTIPLIER ** place.
    h = (sums[at] - sums[at - roll]) * inverse_powers(n + 1)[at - roll]
    chosen = at[((h >> B.U64(64 - bits)) == 0) & ((s.data[at] & 0xC0) != 0x80)]
    return np.union1d(chosen, s.off)


MULTIPLIER = 6364136223846793005


def inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, pow(MULTIPLIER, -1, 1 << 64), B.U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_slice(c: Codec, s: B.Slice) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All ids of a slice's texts, where each text's begin (rows + 1 numbers), and the decoded texts."""
    at = cuts(s)
    raw = s.data.tobytes()
    places = np.searchsorted(at, s.off)
    texts = []
    for i in range(s.rows):
        a, b = places[i], places[i + 1]
        edges = at[a : b + 1].tolist()
        texts.append([raw[x:y] for x, y in zip(edges, edges[1:], strict=False)])
    out = c.encode(texts)
    ids = np.frombuffer(b"".join(out), "<u4")
    at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in out]))).astype(np.int64)
    return ids, at, c.decode(ids, at)


def _encode(path: str, at: int):
    """The text is field ``at`` of the one column, so that each text crosses to the worker once."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for s in B.slices(b.column(0).field(at), SLICE_BYTES):
                flat, begin, decoded = encode_slice(c, s)
                ids = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), ids, pa.array(decoded, pa.binary()).cast(pa.string())], names=["original", "ids", "decoded"])
        B.give_back()

    return run


def encode_documents(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode every whole text and decode it again: (original, ids array<int>, decoded string).

    ``original`` is the input row as a struct, so its columns cannot clash.  A null text counts as
    empty and gives no ids and the empty string.  Equal texts give equal rows; a text is encoded
    whole, whatever its length; an empty table gives an empty result.  ``path`` is the tokenizer's file.
    """
    path = path or tokenizer_path(VOCABULARY)
    rows = small_batches(df).select(F.struct("*").alias("original"))
    kind = rows.schema["original"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, df.columns.index(text_col)), f"original {kind}, ids array<int>, decoded string")


def _digests(path: str):
    import hashlib

    def run(batches):
        c = codec(path)
        for b in batches:
            for s in B.slices(b.column(1), SLICE_BYTES):
                ids, at, decoded = encode_slice(c, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s.first, s.rows),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(ids[x:y].tobytes()).hexdigest() for x, y in zip(at, at[1:], strict=False)], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ],
                    names=["original", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        B.give_back()

    return run


def encode_digests(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode_documents with digests in place of ids and text: (original, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or tokenizer_path(VOCABULARY)
    rows = small_batches(df).select(F.struct(*[c for c in df.columns if c != text_col]).alias("original"), F.col(text_col).alias("text"))
    kind = rows.schema["original"].dataType.simpleString()
    return rows.mapInArrow(_digests(path), f"original {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_digests(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("original.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
