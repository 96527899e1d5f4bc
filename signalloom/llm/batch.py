"""Vectorised text kernels over Arrow batches.

Every kernel works on one *slice*: the UTF-8 bytes of some consecutive rows laid end to
end plus the rows' offsets.  A slice holds about ``SLICE_BYTES`` bytes, or one row if that
row is longer, so memory is bounded by the longest text.  Words are split at the six ASCII
white-space bytes unless another separator table is given; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
SEED_STEP = np.array([0xD1342543DE82EF95, 0x2545F4914F6CDD1D], U64)

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * GOLDEN)
#: FIRST[n] keeps the n first bytes of a little-endian number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all members of the spans, one after another: index, place within the span; and where each span begins (spans + 1 numbers)."""
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    whole = np.arange(at[-1])
    return whole + np.repeat(starts - at[:-1], size), whole - np.repeat(at[:-1], size), at


def _summed(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(size.astype(U64) * GOLDEN))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte spans: sums of scrambled (eight bytes, place) pairs, so that no structure of a text cancels out.

    Two seeds give independent hashes.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    _, place, at = places(np.zeros(len(starts), np.int64), (ends - starts + 7) >> 3)
    count = np.diff(at)
    begin = np.repeat(starts, count) + (place << 3)
    block = eight[begin] & FIRST[np.minimum(np.repeat(ends, count) - begin, 8)]
    return _summed(mix(mix(block + SEED_STEP[seed]) + place.astype(U64) * GOLDEN), at, ends - starts)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of codes[start:end] of 64-bit codes, built in the same way."""
    index, place, at = places(starts, ends)
    return _summed(mix(mix(codes[index] + SEED_STEP[seed]) + place.astype(U64) * GOLDEN), at, ends - starts)


@dataclass
class Slice:
    first: int
    data: np.ndarray
    off: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    """Words of a slice: byte spans, and the index of each row's first word (rows + 1 numbers)."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and the next stage runs beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without malloc_trim
        pass


def slices(col: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def spans(s: Slice, gap: np.ndarray) -> Words:
    """Maximal runs of bytes that are not gaps and lie in one row."""
    n = len(s.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(s.rows + 1, np.int64))
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[s.off[:-1][s.off[:-1] < n]] = True
    after[s.off[1:][s.off[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    return Words(starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, s.off))


def words(s: Slice, separators: np.ndarray = WHITE) -> Words:
    return spans(s, separators[s.data])


def word_hashes(s: Slice, w: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    return byte_hashes(LOWER[s.data] if lower else s.data, w.starts, w.ends, seed)


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every k consecutive numbers of h, row ends not regarded: pairs, pairs of pairs and so on, scrambled at each step."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    now, width, done, out = mix(h + SEED_STEP[seed]), 1, 0, None
    while True:
        if k & width:
            part = now[done : done + m]
            out = part if out is None else mix(out * GOLDEN + part)
            done += width
        if done == k:
            return out
        now = mix(now[: len(now) - width] * GOLDEN + now[width:])
        width *= 2


def inside(w: Words, k: int) -> np.ndarray:
    """Which of the windows of gram_hashes(h, k) lie in one row."""
    m = len(w.starts) - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    return np.arange(m) + k <= np.repeat(w.at[1:], w.counts)[:m]


def per_row(mask_or_values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums between consecutive positions of ``at``."""
    sums = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def joined_words(s: Slice, w: Words, keep: np.ndarray) -> pa.Array:
    """Per row, the kept words with one space between them."""
    data = s.data.copy()
    edge = np.zeros(len(data) + 1, np.int8)
    edge[w.starts[keep]] += 1
    edge[w.ends[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    row = w.row[kept]
    more = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    gaps = w.ends[kept[more]]
    data[gaps] = 32
    mask[gaps] = True
    off = np.concatenate(([0], np.cumsum(per_row(mask, s.off))))
    return pa.LargeStringArray.from_buffers(s.rows, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data[mask].tobytes()))


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
