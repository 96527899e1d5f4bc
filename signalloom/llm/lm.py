"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and one end per text.  The model predicts a symbol from two
context positions, then the word within the symbol:

* every word of at least ``sqrt(training tokens) / SPREAD`` occurrences, and the end, is a symbol of
  its own, so the vocabulary grows with the corpus; every other word belongs to one of ``CLASSES``
  by its last letter and whether punctuation follows it;
* the context is the symbol before and the latest vocabulary word before that.  Its representation
  is the sum of the two symbols' vectors, each through its position's matrix; a score is the product
  with a vector plus a bias;
* symbols are dealt by frequency into about sqrt(size) groups: the model predicts the group, then
  the symbol within it, so exact probabilities cost two products with about sqrt(size) vectors;
* within a class, words have their share of the training counts, and one unseen word has the
  share of words seen once.

Training takes every token of the training texts once, in ``ROUNDS`` parts dealt by a hash of id and text: a round is one
step on the sum of its part's gradients by noise-contrastive estimation (of the group against the mean
over all noise groups, of the symbol against ``NOISE`` drawn ones of its group, the same draws for all tasks).  A sum does not
depend on how many tasks make it, so neither does the model, and the schedule is the same at every size.  Scoring normalises exactly, in batched products per group.  Word counts cover the whole training corpus and
stay distributed: the ``HEAD`` most frequent words are looked up in place, the rest through a join.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import batch as B
from signalloom.llm.common import documents, held_out, small_batches, store

FOLDS, SPREAD, HEAD = 10, 12, 1 << 18
DIM, BATCH, NOISE, RATE, SEED = 24, 16_384, 32, 0.1, 5
#: Steps; tokens a task of a step at least, in all and for each parameter, and the most tasks: each sends one gradient.
ROUNDS, SHARE, SHARE_EACH, LEARNERS = 32, 1 << 20, 2, 1024
#: Gradients that the driver takes as they are, each as large as the model that it holds anyway; more are summed in a shuffle first.
DIRECT = 4
#: Events whose gradient a task adds up at a time.
HELD = 1 << 18
WIDTH, CHUNK, BLOCK_ROWS = 96, 1 << 18, 1 << 11
SMOOTHING = 0.1
FLUSH = 1 << 22
END = np.array([0x5DEECE66D], B.U64)
LETTER = np.full(256, 19, np.int64)
for _k, _group in enumerate(("a", "e", "i", "o", "u", "n", "r", "s", "t", "l", "d", "h", "g", "m", "y", "ckqxz", "bpfvwj", "0123456789")):
    LETTER[[ord(c) for c in _group]] = _k
LETTER[128:] = 18
POINT = np.zeros(256, bool)
POINT[[ord(c) for c in ".,;:!?"]] = True
CLASSES = 40


def tokens(s: B.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes (-1 for the end) of a slice's tokens, and each row's first token (rows + 1 numbers)."""
    w = B.words(s)
    data = B.LOWER[s.data]
    at = w.at + np.arange(s.rows + 1)
    n = len(w.starts) + s.rows
    h, cls = np.empty(n, B.U64), np.full(n, -1, np.int64)
    ends = at[1:] - 1
    word = np.ones(n, bool)
    word[ends] = False
    h[ends] = END
    h[word] = B.word_hashes(s, w, lower=True)
    if len(w.starts):
        last = data[w.ends - 1]
        point = POINT[last] & (w.ends - w.starts > 1)
        last = np.where(point, data[np.maximum(w.ends - 2, 0)], last)
        cls[word] = LETTER[last] + 20 * point
    return h, cls, at


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, cls, n) of all tokens of the rows (text)."""
    schema = pa.schema([("h", pa.int64()), ("cls", pa.int32()), ("n", pa.int64())])

    def flush(held):
        h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        kinds, first, n = np.unique(h, return_index=True, return_counts=True)
        return B.table(schema, [kinds.view(np.int64), cls[first].astype(np.int32), n])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for s in B.slices(b.column(0)):
                h, cls, _ = tokens(s)
                held.append((h, cls))
                size += len(h)
                if size > FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return texts.mapInArrow(run, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


class Symbols:
    """Maps tokens to symbols and contexts.  Symbol 0 is the end, then the vocabulary, then the classes."""

    def __init__(self, shortlist: np.ndarray):
        self.order = np.argsort(shortlist)
        self.sorted = shortlist[self.order]
        self.words = len(shortlist)
        self.size = 1 + self.words + CLASSES

    def of(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = 1 + self.words + cls
        if self.words:
            at = np.minimum(np.searchsorted(self.sorted, h), self.words - 1)
            hit = (self.sorted[at] == h) & (cls >= 0)
            out[hit] = 1 + self.order[at[hit]]
        out[cls < 0] = 0
        return out

    def contexts(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before (the end at a text's start) and the latest vocabulary word before that (else the end)."""
        before = np.zeros(len(sym), np.int64)
        before[1:] = sym[:-1]
        before[at[:-1]] = 0
        place = np.arange(len(sym))
        first = np.repeat(at[:-1], np.diff(at))
        latest = np.maximum.accumulate(np.where((sym > 0) & (sym <= self.words), place, -1))
        anchor = np.full(len(sym), -1)
        anchor[2:] = latest[:-2]
        return before, np.where(anchor >= first, sym[np.maximum(anchor, 0)], 0)


def _order(at: np.ndarray, size: int) -> np.ndarray:
    """A stable order by numbers under size."""
    return np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable")


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of code in order, each row's place among them, and how often each stands (single precision)."""
    bits = len(code).bit_length()
    if int(code.max(initial=0)) >> 63 - bits:
        kinds, of, n = np.unique(code, return_inverse=True, return_counts=True)
        return kinds, of, n.astype(np.float32)
    both = np.sort(code << bits | np.arange(len(code)))  # plain numbers sort many times faster than places by them
    by = both & (1 << bits) - 1
    both >>= bits
    begin = _runs(both)
    n = np.diff(begin, append=len(code))
    of = np.empty(len(code), np.int64)
    of[by] = np.repeat(np.arange(len(begin)), n)
    return both[begin], of, n.astype(np.float32)


def _runs(at: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin in a sorted array."""
    return np.flatnonzero(np.diff(at, prepend=-1))


def _totals(v: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of v's rows between the places begin."""
    return np.add.reduceat(np.ascontiguousarray(v.T), begin, axis=1).T


def _add(out: np.ndarray, where: np.ndarray, v: np.ndarray, singly: int = 4) -> None:
    """Adds v's rows to out's rows ``where``: the first of each at once, then the second, up to ``singly``, and sums of the others."""
    by = _order(where, len(out))
    where = where[by]
    begin = _runs(where)
    n = np.diff(begin, append=len(where))
    for k in range(singly):
        some = begin[n > k]
        out[where[some]] += v.take(by[some + k], 0)
    rest = np.arange(len(where)) - np.repeat(begin, n) >= singly
    if rest.any():
        by, where = by[rest], where[rest]
        begin = _runs(where)
        out[where[begin]] += _totals(v.take(by, 0), begin)


def _logistic(scores: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-scores)), in place; 0 where exp has no number."""
    np.negative(scores, out=scores)
    with np.errstate(over="ignore"):
        np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


class LogBilinear:
    """Vectors, position matrices and biases over ``size`` symbols; the second position has ``wide`` of them."""

    def __init__(self, size: int, wide: int, counts: np.ndarray | None = None, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        share = (np.zeros(size) if counts is None else counts) + 0.5
        groups = int(np.ceil(np.sqrt(size)))
        most = -(-size // groups)
        rank = np.empty(size, np.int64)
        rank[np.argsort(-share, kind="stable")] = np.arange(size)
        self.group, self.slot, self.size, self.wide = rank // most, rank % most, size, wide
        groups = int(self.group.max()) + 1
        self.share = np.zeros((groups, most))
        self.share[self.group, self.slot] = share / share.sum()
        self.reach = np.cumsum(self.share.sum(1))
        self.reach_inside = np.cumsum(self.share / self.share.sum(1, keepdims=True), axis=1)
        self.log_noise = np.log(NOISE * self.share.sum(1)).astype(np.float32)
        self.log_noise_inside = np.log(NOISE * self.share / self.share.sum(1, keepdims=True) + 1e-30).astype(np.float32)
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(self.share / self.share.sum(1, keepdims=True)), -1e9)
        p = {
            "r": rng.normal(0, 0.3, (size, dim)),
            "s": rng.normal(0, 0.3, (wide, dim)),
            "c": np.stack((np.eye(dim), np.eye(dim))),
            "u": rng.normal(0, 0.1, (groups, dim)),
            "d": np.log(self.share.sum(1)),
            "q": rng.normal(0, 0.1, (groups, most, dim)),
            "b": inside,
        }
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.squares = {k: np.ones(v.shape) for k, v in self.p.items()}

    def draws(self, rng) -> np.ndarray:
        """One round's noise: NOISE symbols of every group, as numbers from 0 to 1 of their cumulated shares."""
        return rng.random((len(self.share), NOISE))

    def gradient(self, before: np.ndarray, anchor: np.ndarray, y: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
        """Sums of the gradients of these events: the true group and symbol against groups, and symbols of the group, drawn by frequency.

        What depends on the context alone, or on it and the group, is worked out once for all its events and counts as often as they stand.
        Events are sorted by symbol, so that those of a group, and of a symbol, stand together.
        """
        p, (groups, most) = self.p, self.share.shape
        place = (self.group * most + self.slot)[y]
        context, of, n = _distinct(before * self.wide + anchor)
        before, anchor = context // self.wide, context % self.wide
        r, s = p["r"].take(before, 0), p["s"].take(anchor, 0)
        x = r @ p["c"][0] + s @ p["c"][1]
        q, b = p["q"].reshape(groups * most, -1), p["b"].reshape(-1)
        pair, _, n_pair = _distinct(place // most * len(context) + of)
        g, c = pair // len(context), pair % len(context)
        x_pair = x.take(c, 0)
        bounds = np.searchsorted(g, np.arange(groups + 1))
        # The group against NOISE groups, whose mean over all draws is taken: there are few groups.
        offset = p["d"] - self.log_noise
        own = p["u"].take(g, 0)
        gt = -_logistic(-(np.einsum("ij,ij->i", x_pair, own) + offset.take(g))) * n_pair
        own *= gt[:, None]
        dx, d_pair, du, dd = np.empty_like(x), own, np.zeros_like(p["u"]), np.zeros_like(p["d"])
        for k in np.flatnonzero(np.diff(bounds)):
            rows = slice(bounds[k], bounds[k + 1])
            du[k], dd[k] = gt[rows] @ x_pair[rows], gt[rows].sum()
        drawn = np.exp(self.log_noise)
        for i in range(0, len(x), BLOCK_ROWS):
            rows = slice(i, i + BLOCK_ROWS)
            gf = _logistic(x[rows] @ p["u"].T + offset)
            gf *= drawn
            gf *= n[rows, None]
            dx[rows] = gf @ p["u"]
            du += gf.T @ x[rows]
            dd += gf.sum(0)
        # The symbol against noise symbols of its group.
        inner = b - self.log_noise_inside.reshape(-1)
        event, _, n_event = _distinct(place * len(context) + of)
        at, c_event = event // len(context), event % len(context)
        x_event, own = x.take(c_event, 0), q.take(at, 0)
        gt = -_logistic(-(np.einsum("ij,ij->i", x_event, own) + inner.take(at))) * n_event
        own *= gt[:, None]
        x_event *= gt[:, None]
        dq, db = np.zeros_like(q), np.zeros_like(b)
        one = _runs(at)
        if len(one):
            dq[at[one]], db[at[one]] = _totals(x_event, one), np.add.reduceat(gt, one)
        noise = []
        for k in np.flatnonzero(np.diff(bounds)):
            i, j = bounds[k], bounds[k + 1]
            z = k * most + np.minimum(np.searchsorted(self.reach_inside[k], draws[k]), most - 1)
            qz = q.take(z, 0)
            gf = _logistic(x_pair[i:j] @ qz.T + inner[z])
            gf *= n_pair[i:j, None]
            d_pair[i:j] += gf @ qz
            noise.append((z, gf.T @ x_pair[i:j], gf.sum(0)))
        if noise:
            z, gq, gb = (np.concatenate(v) for v in zip(*noise, strict=True))
            by = _order(z, groups * most)
            kinds = _runs(z[by])
            dq[z[by][kinds]] += _totals(gq.take(by, 0), kinds)
            db[z[by][kinds]] += np.add.reduceat(gb.take(by), kinds)
        _add(dx, c, d_pair)
        _add(dx, c_event, own)
        out = {"c": np.stack((r.T @ dx, s.T @ dx)), "u": du, "d": dd, "q": dq.reshape(p["q"].shape), "b": db.reshape(p["b"].shape)}
        for k, where, size, m in (("r", before, self.size, p["c"][0]), ("s", anchor, self.wide, p["c"][1])):
            by = _order(where, size)
            kinds = _runs(where[by])
            out[k] = np.zeros_like(p[k])
            if len(kinds):
                out[k][where[by][kinds]] = _totals(dx.take(by, 0), kinds) @ m.T
        return out

    def move(self, gradient: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One step, each parameter's by its own sum of squared gradients."""
        for k, g in gradient.items():
            self.squares[k] += g * g
            self.p[k] -= (rate * g / np.sqrt(self.squares[k])).astype(np.float32)

    def train(self, code: np.ndarray, n: np.ndarray, steps: int, seed: int = SEED) -> LogBilinear:
        """Steps on BATCH events each, drawn from counts n of (before * wide + anchor) * size + symbol."""
        rng, reach = np.random.default_rng(seed), np.cumsum(n) / np.sum(n)
        for _ in range(steps):
            c = code[np.minimum(np.searchsorted(reach, rng.random(BATCH)), len(code) - 1)]
            self.move(self.gradient(c // self.size // self.wide, c // self.size % self.wide, c % self.size, self.draws(rng)))
        return self

    def log10(self, before: np.ndarray, anchor: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the events."""
        out = np.empty(len(y))
        groups, most = self.share.shape
        place = self.group * most + self.slot
        q, b = self.p["q"].reshape(groups * most, -1), self.p["b"].reshape(-1)
        for i in range(0, len(y), CHUNK):
            at = place[y[i : i + CHUNK]]
            context, of, _ = _distinct(before[i : i + CHUNK] * self.wide + anchor[i : i + CHUNK])
            x = self.p["r"].take(context // self.wide, 0) @ self.p["c"][0] + self.p["s"].take(context % self.wide, 0) @ self.p["c"][1]
            total = np.concatenate([_log_total(x[j : j + BLOCK_ROWS] @ self.p["u"].T + self.p["d"]) for j in range(0, len(x), BLOCK_ROWS)])
            pair, of_pair, _ = _distinct(at // most * len(context) + of)
            g, c = pair // len(context), pair % len(context)
            x = x.take(c, 0)
            part = np.einsum("ij,ij->i", x, self.p["u"].take(g, 0)) + self.p["d"].take(g) - total.take(c)
            bounds = np.searchsorted(g, np.arange(groups + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                for j in range(bounds[k], bounds[k + 1], BLOCK_ROWS):
                    rows = slice(j, min(j + BLOCK_ROWS, bounds[k + 1]))
                    part[rows] -= _log_total(x[rows] @ self.p["q"][k].T + self.p["b"][k])
            out[i : i + CHUNK] = np.einsum("ij,ij->i", x.take(of_pair, 0), q.take(at, 0)) + b.take(at) + part.take(of_pair)
        return out / np.log(10)

    def log10_table(self) -> np.ndarray:
        """[symbol before, anchor, symbol]: all of a small model's log10 probabilities."""
        shape = (self.size, self.wide, self.size)
        return self.log10(*(v.ravel() for v in np.indices(shape))).reshape(shape)

    def still(self) -> LogBilinear:
        """The model as a task needs it: without the sums of squared gradients."""
        out = copy.copy(self)
        out.squares = None
        return out

    def flat(self, gradient: dict[str, np.ndarray]) -> np.ndarray:
        x = np.concatenate([gradient[k].ravel() for k in self.p])
        return np.pad(x, (0, -len(x) % WIDTH)).reshape(-1, WIDTH)

    def shaped(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        flat, out, at = flat.ravel(), {}, 0
        for k, v in self.p.items():
            out[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return out


def _log_total(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exp(scores) of each row, in place."""
    most = np.zeros((len(scores), 1), scores.dtype)
    if scores.max(initial=0) > 60:
        most = scores.max(1, keepdims=True)
        scores -= most
    np.exp(scores, out=scores)
    return np.log(np.maximum(scores @ np.ones(scores.shape[1], scores.dtype), 1e-37)) + most[:, 0]


def encoded(train: DataFrame, symbols: Symbols) -> DataFrame:
    """(round, y) of the rows (id, text): each text's symbols as 32-bit numbers, sorted by round in each file, so that a round reads its own pages."""

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(1)):
                h, cls, at = tokens(s)
                y = symbols.of(h, cls).astype("<u4")
                off = pa.array((at * 4).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.rows), pa.BinaryArray.from_buffers(pa.binary(), s.rows, [None, off.buffers()[1], pa.py_buffer(y.tobytes())])], names=["round", "y"])

    dealt = small_batches(train).select(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)).cast("int").alias("round"), "text")
    return store(dealt.mapInArrow(run, "round int, y binary").sortWithinPartitions("round"), "symbols")


def learners(total: int, parameters: int) -> int:
    """Tasks of a step: each sums over enough tokens that all gradients of a step stay in proportion to its tokens, however large the model is."""
    return min(LEARNERS, max(1, -(-total // (ROUNDS * max(SHARE, SHARE_EACH * parameters)))))


def summed(parts: DataFrame, tasks: int, direct: int = DIRECT) -> np.ndarray | None:
    """The sum over i of the rows (i, x) that ``tasks`` tasks give, each an i once at most and single precision; null without rows.

    Sums are double; what is shuffled is single, as a task's own sums before the shuffle would only widen its rows.
    """
    if tasks > direct:
        parts = parts.repartition("i").groupBy("i").agg(F.array(*[F.sum(F.col("x")[j].cast("double")) for j in range(WIDTH)]).alias("x"))
    got = parts.toArrow()
    if not got.num_rows:
        return None
    at = np.asarray(got.column("i"))
    out = np.zeros((int(at.max()) + 1, WIDTH))
    np.add.at(out, at, np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in got.column("x").chunks]).reshape(-1, WIDTH))
    return out


def learn(train: DataFrame, symbols: Symbols, model: LogBilinear, total: int) -> None:
    """Trains the model on all ``total`` tokens of the rows (id, text): one step a round."""
    tasks = learners(total, sum(v.size for v in model.p.values()))
    texts = encoded(train, symbols)
    for k in sorted(r[0] for r in texts.select("round").distinct().collect()):
        still, draws = model.still(), model.draws(np.random.default_rng(SEED + k))

        def run(batches, still=still, draws=draws):
            held, size, total = [], 0, None

            def add(total):
                y = np.concatenate(held)
                at = np.cumsum([0, *map(len, held)])
                before, anchor = symbols.contexts(y, at)
                for i in range(0, len(y), HELD):
                    g = still.gradient(before[i : i + HELD], anchor[i : i + HELD], y[i : i + HELD], draws)
                    total = {n: v.astype(float) for n, v in g.items()} if total is None else {n: total[n] + v for n, v in g.items()}
                return total

            for b in batches:
                for x in b.column(0):
                    held.append(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64))
                    size += len(held[-1])
                    if size >= HELD:
                        total, held, size = add(total), [], 0
            if held:
                total = add(total)
            if total is not None:
                x = still.flat(total)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), lists], names=["i", "x"])

        parts = texts.where(F.col("round") == k).select("y").coalesce(tasks).mapInArrow(run, "i long, x array<float>")
        x = summed(parts, tasks)
        if x is not None:
            model.move(model.shaped(x))


SCORED = "uid long, id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<h:long,cls:int,n:int>>"


def score_rows(rows: DataFrame, symbols: Symbols, model: LogBilinear, head_h: np.ndarray, head_n: np.ndarray, inner: np.ndarray) -> DataFrame:
    """Scores of rows (uid, id, held_out, text) as far as the head's counts go; ``rest`` are the other words.

    inner[cls] are (log10 of what a count is multiplied by, log10 of the unseen word's share).
    """
    order = np.argsort(head_h)
    known, count = head_h[order], head_n[order].astype(float)
    names = [x.split()[0] for x in SCORED.split(", ")[:7]]

    def run(batches):
        for b in batches:
            for s in B.slices(b.column(3)):
                h, cls, at = tokens(s)
                kinds, of = np.unique(h, return_inverse=True)  # what depends on the word alone is looked up once a slice
                kind = np.empty(len(kinds), np.int64)
                kind[of] = cls
                sym = symbols.of(kinds, kind)
                place = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
                have = known[place] == kinds if len(known) else np.zeros(len(kinds), bool)
                c = count[place] if len(known) else np.zeros(len(kinds))
                base = np.where(have, np.log10(c + SMOOTHING), 0.0)
                word = have & (sym > symbols.words)
                inside = np.zeros(len(kinds))
                inside[word] = np.log10(c[word]) + inner[kind[word], 0]
                sym, have, base = sym[of], have[of], base[of]
                score = model.log10(*symbols.contexts(sym, at), sym) + inside[of]
                row = np.repeat(np.arange(s.rows), np.diff(at))
                out = np.flatnonzero(~have)
                key, first, n = np.unique(B.mix(h[out] + row[out].astype(B.U64) * B.U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                first = out[first]
                by = np.argsort(row[first], kind="stable")
                first, n = first[by], n[by]
                off = np.searchsorted(row[first], np.arange(s.rows + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(cls[first].astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "cls", "n"])
                sums = [np.bincount(row, x, s.rows) for x in (have, base, score)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(s.first, s.rows) for i in range(3)), pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(off), rest)],
                    names=[*names, "rest"],
                )

    return rows.mapInArrow(run, SCORED)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts are scored whole, whatever their length, and null texts count as empty: one token, the end.
    Only id_col and text_col are read, so other columns cannot clash.  Rows with a null id are trained on.  Repeated
    rows count as often as they stand and get equal scores.  An empty table gives no rows; without
    training rows every word is unseen.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out")).select("id", "text")
    counts = store(word_counts(train.select("text")), "counts")
    end = int(END.view(np.int64)[0])
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    head_h, head_n = (np.asarray(head.column(c)) for c in ("h", "n"))
    least = max(2, int(np.sqrt(total) / SPREAD))
    frequent = counts.where((F.col("n") >= least) & (F.col("h") != end)).orderBy(F.desc("n"), "h").toArrow()
    short, short_n = (np.asarray(frequent.column(c)) for c in ("h", "n"))
    symbols = Symbols(short.view(B.U64))
    inner, class_n = np.zeros((CLASSES, 2)), np.zeros(CLASSES)
    left = counts.where((F.col("cls") >= 0) & (F.col("n") < least))
    for cls, n, once in left.groupBy("cls").agg(F.sum("n"), F.count_if(F.col("n") == 1)).collect():
        unseen = (once + 0.5) / (n + 1.0)
        inner[cls], class_n[cls] = (np.log10((1 - unseen) / n), np.log10(unseen)), n
    ends = total - short_n.sum() - class_n.sum()
    model = LogBilinear(symbols.size, symbols.words + 1, np.concatenate(([ends], short_n, class_n)))
    if total:
        learn(train, symbols, model, total)
    part = score_rows(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), symbols, model, head_h.view(B.U64), head_n, inner)
    part = store(part, "scored")
    rest = part.select("uid", F.inline("rest")).join(counts.select("h", F.col("n").alias("c")), "h", "left")
    scale, unseen = (F.array(*[F.lit(float(x)) for x in inner[:, k]])[F.greatest(F.col("cls"), F.lit(0))] for k in (0, 1))
    inside = F.when(F.col("cls") < 0, 0.0).when(F.col("c").isNull(), unseen).otherwise(F.log10("c") + scale)
    sums = rest.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("base_rest"), F.sum(F.col("n") * inside).alias("score_rest")
    )
    whole = float(np.log10(total + SMOOTHING * (kinds + 1)))
    zero = F.lit(0.0)
    return part.drop("rest").join(sums, "uid", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + F.coalesce("score_rest", zero)).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
