"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def substring_dedup(rows, window=35):
    """{doc_id: (n_words, n_removed, kept_sha256)}; rows are (doc_id, text)."""
    seen = Counter()
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    for _, w in texts:
        seen.update(tuple(w[a : a + window]) for a in range(len(w) - window + 1))
    out = {}
    for i, w in texts:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def bpe(rows, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    out = {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out[i] = (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t.decode(ids, skip_special_tokens=False)))
    return out


def licenses(rows):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    for i, text in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in phrases.items() for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
        out[i] = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({label for _, label in at})))
    return out


def stats(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    covered = {k for a in range(len(w) - 4) if grams[tuple(w[a : a + 5])] > 1 for k in range(a, a + 5)}
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 0


def edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 2
        out[i] = (len(text), text[: len(text) - n] + after[:n], after)
    return out


def jaccard(a, b, k=5):
    x, y = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)} for w in (WORD.findall(a or ""), WORD.findall(b or "")))
    return len(x & y) / len(x | y)


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} by clamping and resharing until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: w[s] * left / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def links(rows, k=5, threshold=0.8):
    """All pairs of different texts whose multisets of k-word sequences have that likeness, through an index of the sequences.

    A sequence counts as often as it stands: its second occurrence is another member than its first.
    """
    sets, index, same = {}, {}, {}
    out = set()
    for i, t in rows:
        w = tuple(WORD.findall(t or ""))
        if w in same:
            out.add((same[w], i))
            continue
        same[w] = i
        if len(w) >= k:
            seen = Counter()
            sets[i] = set()
            for j in range(len(w) - k + 1):
                g = w[j : j + k]
                sets[i].add((g, seen[g]))
                seen[g] += 1
    shared = Counter()
    for i, grams in sets.items():
        for g in grams:
            others = index.setdefault(g, [])
            shared.update((j, i) for j in others)
            others.append(i)
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            out.add((a, b))
    return out


def robust_distances(rows, vector, floor, covered, steps, pull, quantile, cdf):
    """{row number: squared distance} by concentration steps per (lang, source), per language and over all; rows are (lang, source, ..)."""
    p = len(floor)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        for g in ((), (r[0],), (r[0], r[1])):
            members[g].append(k)

    def spread(mean, cov, v):
        x = v - mean
        return np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov + np.diag(floor**2)), x)

    found = {}
    for g, own in members.items():
        v = vector[own]
        n = len(v)
        at = lambda q: np.sort(v, axis=0)[max(int(np.ceil(q * n)), 1) - 1]
        mean, cov = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)
        for step in range(steps + 1):
            d = spread(mean, cov, v)
            if step < steps:
                bins = np.floor(np.log(d + 1e-9) * 50)
                limit = max(b for b in set(bins) if (bins < b).sum() < covered * n)
                near, scale = bins <= limit, covered / cdf(quantile(covered, p), p + 2)
            else:
                near, scale = d <= quantile(0.975, p), 0.975 / cdf(quantile(0.975, p), p + 2)
            if near.any():
                mean, cov, count = v[near].mean(0), np.cov(v[near].T, bias=True) * scale, near.sum()
        found[g] = (count, mean, cov)

    def drawn(g):
        n, mean, cov = found[g]
        if not g:
            return mean, cov
        up_mean, up_cov = drawn(g[:-1])
        own, gap = n / (n + pull), mean - up_mean
        return up_mean + own * gap, own * cov + (1 - own) * up_cov + own * (1 - own) * np.outer(gap, gap)

    return {k: float(spread(*drawn((r[0], r[1])), vector[k : k + 1])[0]) for k, r in enumerate(rows)}


def alignment(rows, a_path, b_path):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] by the libraries, text by text."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(a_path)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, count = [], Counter()
    for i, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        pa = [bytes(alphabet[c] for c in t.id_to_token(x)) for x in a]
        pb = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        groups = []
        if a and b"".join(pa) == b"".join(pb) == (" " + text).encode():
            x = y = at_a = at_b = 0
            ga, gb = [], []
            while x < len(a) or y < len(b):
                if at_a <= at_b:
                    at_a += len(pa[x])
                    ga.append(a[x])
                    x += 1
                else:
                    at_b += len(pb[y])
                    gb.append(b[y])
                    y += 1
                if at_a == at_b:
                    groups.append((ga, gb))
                    ga, gb = [], []
        else:
            a = b = []
        count.update((ga[-1], gb[-1]) for ga, gb in groups)
        docs.append((i, len(a), len(b), groups))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, na, nb, groups in docs:
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((i, na, nb, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha(text) if groups else ""))
    return out


def whitened(vectors, k=8):
    """(whole numbers, whitened rows by numpy, share of the variance) of usable vectors."""
    x = np.floor(np.asarray(vectors, float) * 1024).astype(np.int64) + 100_000
    centred = x - x.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-value)[:k]
    return x, centred @ vector[:, order] / np.sqrt(value[order]), value[order] / value.sum()


def decontaminated(docs, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256)]; docs and items are (id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, text in items:
        w = split(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[a : a + window])].add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def nearby(docs, items, within):
    """{(row, item row): places} where all words of an item stand within so many words; a place is the rarest word's."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = set()
    for r, (_, text) in enumerate(docs):
        w = split(text)
        for k, (_, item) in enumerate(items):
            need = set(split(item))
            for a in range(len(w)):
                if need and need <= set(w[a : a + within]):
                    found.add((r, k))
    return found
