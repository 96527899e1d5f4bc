"""Alignment of two tokenizers through a dictionary of groups.

Byte offsets where tokens of both tokenizers end cut a text into groups (A ids, B ids).  Texts are encoded
block by block, a block being some megabytes of texts of one task; each block numbers its distinct
groups and hands on one row a distinct group, with its occurrences and documents, and one row a document
with the numbers of its groups.  Groups meet across blocks in one shuffle; a group's links are expanded
once, whatever its frequency, and multiplied by it; what a link is worth goes back to the blocks by
group key and then to their documents by block.  So the shuffles carry a row per block and distinct group, never one
per token, and the commonest group has as many rows as there are blocks.

No token of either vocabulary is empty (checked), so exactly one A and one B token end where a group
ends: a group has one link, its last A and its last B id.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, small_batches, store
from signalloom.llm.token_counts import LONG_GAP, WHITE

A_FILE, B_FILE, BLOCK_BYTES = "byte_bpe_50k.json", "piece_bpe_32k.model", 8 << 20
#: Ids of a group packed into one 64-bit number; longer groups are interned by their ids' bytes.
PACKED, ID_BITS = 4, 16
_long_gap = re.compile("[%s]{%d,}" % (WHITE, LONG_GAP))
_codecs: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable bytes of Latin-1 stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks_hold(path: str) -> bool:
    """Whether merging by rank gives the library's ids: A's merges are in the order of their ids and every token is reached from its bytes.

    Then, when a pair's bytes make the token of least rank, the merges inside them were those that
    lead to that token, so the pair is the one its merge names.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    tokenizer, special = Tokenizer.from_file(path), {x["content"] for x in spec["added_tokens"]}
    return made == sorted(made) and all(c in vocab for c in byte_alphabet()) and all(len(tokenizer.model.tokenize(t)) == 1 for t in vocab if t not in special)


class Codec:
    """Both tokenizers and their tokens' bytes.  With ``by_rank`` A is encoded by merge ranks, except texts with long white space."""

    def __init__(self, a_path: str, b_path: str, by_rank: bool):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        entries = {t: bytes(alphabet[c] for c in t) if t not in special else t.encode() for t in spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}}
        ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.a_bytes[i] = entries[t]
        self.a_path, self._library = a_path, None
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={entries[t]: i for t, i in ids.items() if t not in special}, special_tokens={}) if by_rank else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        p = self.pieces
        self.b_bytes = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, p.id_to_piece(i)) for i in range(p.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if not self.b_size.all() or any(not self.a_bytes[i] for i in ids.values()):
            raise ValueError("a vocabulary has an empty token")

    def a_ids(self, text: str) -> np.ndarray:
        if self.ranks and not (len(text) > LONG_GAP and _long_gap.search(text)):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.a_path)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)


def codec(a_path: str, b_path: str, by_rank: bool) -> Codec:
    key = (a_path, b_path, by_rank)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _packed(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for j in range(PACKED):
        more = np.flatnonzero(n > j)
        out[more] |= (ids[first[more] + j].astype(np.uint64) + B.U64(1)) << B.U64(ID_BITS * j)
    return out


def _numbered(ka: np.ndarray, kb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number the distinct pairs by falling frequency: each pair's number; a place and the frequency of each number."""
    h = B.mix(ka + B.GOLDEN) ^ B.mix(kb * B.GOLDEN)
    order = np.argsort(h)
    a, b = ka[order], kb[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    if new.sum() != 1 + (np.diff(h[order]) != 0).sum():  # two pairs share a hash and may be mixed in order
        order = np.lexsort((kb, ka))
        a, b = ka[order], kb[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    by_times = np.argsort(-times, kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[by_times] = np.arange(len(at))
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(rank, times)
    return number, order[at][by_times], times[by_times]


class Block:
    """The groups of some texts: per text token counts and group numbers, and the distinct groups by number."""

    def __init__(self, c: Codec, texts: list[str]):
        a, b, sizes, valid = [], [], [], np.zeros(len(texts), bool)
        for i, (text, ids) in enumerate(zip(texts, c.pieces.encode(texts, num_threads=1), strict=True)):
            if not text:
                continue
            spaced = " " + text
            raw = spaced.encode()
            if b"".join(map(c.b_bytes.__getitem__, ids)) != raw:
                continue
            own = c.a_ids(spaced)
            if c.ranks is None and b"".join(map(c.a_bytes.__getitem__, own.tolist())) != raw:
                continue
            valid[i] = True
            a.append(own)
            b.append(np.array(ids, np.uint32))
            sizes.append(len(raw))
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.n_a[valid], self.n_b[valid] = [len(x) for x in a], [len(x) for x in b]
        empty = np.zeros(0, np.int64)
        self.numbers, self.names, self.times, self.docs = empty, [], empty, empty
        self.at = np.zeros(len(texts) + 1, np.int64)
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        a_end, b_end, ends = np.cumsum(c.a_size[a]), np.cumsum(c.b_size[b]), np.cumsum(sizes)
        mark = np.zeros(ends[-1] + 1, np.uint8)
        mark[a_end] |= 1
        mark[b_end] |= 2
        a_last, b_last = (np.flatnonzero(mark[e] == 3) + 1 for e in (a_end, b_end))
        a_first, b_first = (np.append(0, x[:-1]) for x in (a_last, b_last))
        na, nb = a_last - a_first, b_last - b_first
        ka, kb = _packed(a, a_first, np.minimum(na, PACKED)), _packed(b, b_first, np.minimum(nb, PACKED))
        long, seen = np.flatnonzero((na > PACKED) | (nb > PACKED) | (max(len(c.a_bytes), len(c.b_bytes)) >= 1 << ID_BITS)), {}
        for g in long.tolist():
            ka[g], kb[g] = seen.setdefault((a[a_first[g] : a_last[g]].tobytes(), b[b_first[g] : b_last[g]].tobytes()), len(seen)), ~B.U64(0)
        self.numbers, place, self.times = _numbered(ka, kb)
        text = lambda ids, x, y: ",".join(map(str, ids[x:y].tolist()))
        self.names = [f"{text(a, a_first[g], a_last[g])}|{text(b, b_first[g], b_last[g])}" for g in place.tolist()]
        self.n_groups[valid] = np.diff(np.append(0, np.searchsorted(a_end[a_last - 1], ends, "right")))
        np.cumsum(self.n_groups, out=self.at[1:])
        row = np.repeat(np.arange(len(texts)), self.n_groups)
        order = np.lexsort((row, self.numbers))
        first = np.append(True, (np.diff(self.numbers[order]) != 0) | (np.diff(row[order]) != 0))
        self.docs = np.bincount(self.numbers[order][first], minlength=len(place))


FIELDS = [("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("low", pa.binary()), ("high", pa.binary())]
ENTRY = [("place", pa.int32()), ("grp", pa.string()), ("times", pa.int64()), ("docs", pa.int64())]


def _rows(block: Block, ids: pa.Array, number: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """The block's documents, then its distinct groups, in batches of the same columns."""
    names, at = block.names, block.at.tolist()
    low, high = block.numbers.astype("<u2"), (block.numbers >> 16).astype("<u2")
    digests, groups = [], []
    numbers = block.numbers.tolist()
    for x, y in zip(at, at[1:], strict=False):
        joined = ";".join(map(names.__getitem__, numbers[x:y]))
        digests.append(hashlib.sha256(joined.encode()).hexdigest() if y > x else "")
        groups.append(joined if keep else None)
    n, m = len(ids), len(names)
    cut = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())
    own = [pa.array(np.full(n, number)), pa.array(block.n_a), pa.array(block.n_b), pa.array(block.n_groups), pa.array(digests, pa.string()), pa.array(groups, pa.string()), cut(low), cut(high)]
    columns = ["id", *[f[0] for f in FIELDS], *[f[0] for f in ENTRY]]
    for x in range(0, n, 512):
        yield pa.RecordBatch.from_arrays([ids.slice(x, 512), *[c.slice(x, 512) for c in own], *[pa.nulls(min(512, n - x), t) for _, t in ENTRY]], names=columns)
    entry = [pa.array(np.arange(m, dtype=np.int32)), pa.array(names, pa.string()), pa.array(block.times, pa.int64()), pa.array(block.docs, pa.int64())]
    for x in range(0, m, 1 << 15):
        k = min(1 << 15, m - x)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, ids.type), pa.array(np.full(k, number)), *[pa.nulls(k, t) for _, t in FIELDS[1:]], *[c.slice(x, k) for c in entry]], names=columns)


def _encode(a_path: str, b_path: str, by_rank: bool, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(a_path, b_path, by_rank)
        number, held, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            col, begin = b.column(1), 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
            for i, n in enumerate(sizes):
                size += n
                if size >= BLOCK_BYTES or i + 1 == len(sizes):
                    held.append(b.column(0).slice(begin, i + 1 - begin))
                    texts += [x or "" for x in col.slice(begin, i + 1 - begin).to_pylist()]
                    begin = i + 1
                if size >= BLOCK_BYTES:
                    yield from _rows(Block(c, texts), pa.concat_arrays(held), number, keep)
                    number, held, texts, size = number + 1, [], [], 0
        if texts:
            yield from _rows(Block(c, texts), pa.concat_arrays(held), number, keep)
        B.give_back()

    return run


def _joined(bytes_col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in bytes_col.to_pylist()), "<u2").astype(np.int64)


def _summed(docs: pa.Table, values: pa.Table) -> pa.Table:
    """Per document of one block: how many links it has, how many of them are their B id's best, and their counts' sum."""
    place = values["place"].to_numpy()
    table = {c: np.zeros(len(place), np.int64) for c in ("links", "best", "counts")}
    for c, v in table.items():
        v[place] = values[c].to_numpy()
    local = _joined(docs["low"]) + (_joined(docs["high"]) << 16)
    at = np.append(0, np.cumsum(docs["n_groups"].to_numpy()))
    out = docs.drop_columns(["low", "high", "block"])
    for c, v in table.items():
        out = out.append_column(c, pa.array(B.per_row(v[local], at), pa.int64()))
    return out


class Alignment:
    """Both tokenizers over the texts of a table, stored in the shared folder.

    ``groups``: (grp, times, docs, a, b), one row per distinct group, ``grp`` as 'a1,a2|b1', with its link's ids.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False):
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
        rows = small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        kind = rows.schema["id"].dataType.simpleString()
        sql = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
        schema = f"id {kind}, " + ", ".join(f"{n} {sql[t]}" for n, t in FIELDS + ENTRY)
        whole = store(rows.mapInArrow(_encode(a_path, b_path, ranks_hold(a_path), keep_groups), schema), "aligned")
        self.kind = kind
        self.docs = whole.where("place is null").select("id", *[f[0] for f in FIELDS])
        self.entries = whole.where("place is not null").select("block", *[f[0] for f in ENTRY])
        last = lambda side, at: F.substring_index(F.substring_index("grp", "|", side), ",", -1).cast("int").alias(at)
        self.groups = store(self.entries.groupBy("grp").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).select("*", last(1, "a"), last(-1, "b")), "groups")

    def pairs(self, weight: str = "times") -> DataFrame:
        """(a, b, n, best): every linked id pair, how many links (``times``) or documents of its groups (``docs``) it has, and whether no other A id has more with its B id."""
        n = self.groups.groupBy("a", "b").agg(F.sum(weight).alias("n"))
        most = n.groupBy(F.col("b").alias("to")).agg(F.max("n").alias("most"))
        return n.join(most, F.col("b") == F.col("to")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, groups_sha256, groups, links, best, counts) for every row; ``groups`` is null unless kept."""
        worth = store(self.pairs(), "pairs").withColumnsRenamed({"a": "pa", "b": "pb"})
        valued = self.groups.join(worth, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb"))).select(F.col("grp").alias("g"), F.lit(1).cast("long").alias("links"), F.col("best").cast("long").alias("best"), F.col("n").alias("counts"))
        values = self.entries.join(valued, F.col("grp") == F.col("g")).select(F.col("block").alias("of"), "place", "links", "best", "counts")
        schema = f"id {self.kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links long, best long, counts long"
        return self.docs.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_summed, schema)


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> Alignment:
    """Align the two tokenizers over every whole text.

    Texts that are null or empty, and texts that tokenizer B changes (it reads U+2581 as a space), have no tokens:
    zeros and an empty digest.  Special tokens' strings are plain text.  Repeated rows and ids, and null ids,
    are rows like others, each counted; ties for a B id's best are all best.  A text longer than a block is a
    block of its own.  Only id_col and text_col are read, so other columns cannot clash.  An empty table has
    no rows, groups or pairs.
    """
    return Alignment(df, id_col, text_col, a_path, b_path, keep_groups)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(documents(spark, sf_dir)).documents()
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("links").alias("n_links"), F.col("best").alias("n_best"), F.col("counts").alias("count_sum"), "groups_sha256")
