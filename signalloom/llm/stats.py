"""Statistics of whole texts that the quality operators share, counted per row of a slice."""

from __future__ import annotations

import numpy as np

from signalloom.llm import batch as B

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".,;:"]] = True
LOUD = np.zeros(256, bool)
LOUD[[ord(c) for c in "!?"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
REPEAT_WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_runs", "n_upper", "n_loud", "n_stops", "n_digits")


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return B.mix(h + row.astype(B.U64) * B.U64(0x9E3779B97F4A7C15))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_stats(s: B.Slice) -> dict[str, np.ndarray]:
    """The COUNTS of each row; all are 0 for a text without words."""
    d = s.data
    gap = B.WHITE[d]
    w = B.spans(s, gap)
    h = B.word_hashes(s, w)
    row = w.row
    in_word = lambda table: B.per_row(table[d], s.off)
    out = {"n_words": w.counts, "word_chars": B.per_row(~gap & ((d & 0xC0) != 0x80), s.off)}
    lines = B.spans(s, d == 10)
    solid = np.zeros(len(d) + 1, np.int64)
    np.cumsum(~gap, out=solid[1:])
    lh = B.byte_hashes(d, lines.starts, lines.ends)
    real = solid[lines.ends] > solid[lines.starts]
    line_row = lines.row[real]
    kinds = np.unique(_keyed(lh[real], line_row), return_index=True)[1]
    out["n_lines"] = np.bincount(line_row, minlength=s.rows)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[kinds], minlength=s.rows)
    k = REPEAT_WINDOW
    ok = np.flatnonzero(B.inside(w, k))
    found = ok[_twice(_keyed(B.gram_hashes(h, k)[ok], row[ok]))]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + k, -1)
    out["n_repeat_words"] = B.per_row(np.cumsum(edge)[:-1] > 0, w.at)
    kinds = np.unique(_keyed(h, row), return_index=True)[1]
    out["n_distinct"] = np.bincount(row[kinds], minlength=s.rows)
    out["n_runs"] = B.per_row(np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool), w.at)
    for name, chosen in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_loud", LOUD), ("n_stops", STOPS), ("n_digits", DIGIT)):
        out[name] = in_word(chosen)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def vectors(n: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text.

    Rates are taken with ``PRIOR`` pseudo-words of ordinary text added, so a short text's rate is
    drawn to the ordinary; square roots make the rates' spread alike at all levels.
    """
    words, chars = n["n_words"] + PRIOR, n["word_chars"] + 5.5 * PRIOR
    rate = lambda a, b, usual=0.0: np.sqrt((a + usual * PRIOR) / b)
    return np.stack(
        [
            np.log(chars / words),
            rate(n["n_symbols"], chars),
            rate(n["n_upper"], chars, 0.15),
            rate(n["n_loud"], words),
            rate(n["n_repeat_words"], words),
            rate(n["n_runs"], words),
            rate(n["n_dup_lines"], n["n_lines"] + 5),
            rate(n["n_stops"], words, 0.15),
        ],
        axis=1,
    )


PRIOR = 20
NAMES = ("word_length", "symbols", "upper", "loud", "repeats", "runs", "dup_lines", "stops")
