"""LM scoring: unigram statistics of the whole corpus and a log-bilinear model of words trained by NCE."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .cells import cell_count, ranges, with_cell
from .common import table, written

#: A word is one of the vocabulary if it has at least LEAST training tokens and this share of all: so
#: the vocabulary grows with the corpus, up to 1 / SHARE words. Others share TAILS classes by
#: their last three bytes.
LEAST, SHARE = 3, 1e-5
TAILS = 31
TAG = np.uint64(31)  # the low bits of a word's hash hold its tail class
ALPHA = 0.1
#: Words before a token that predict it, and numbers for each word.
WINDOW, DIM = 3, 16
#: Tokens of a step; noise samples of a step; steps that a chunk is cut into at least: few tokens make smaller steps.
BATCH, NOISE, CUTS = 4096, 64, 8
#: Rounds of training in all tasks, each from the mean of what the tasks made of the round before. A round predicts
#: every ROUNDS-th token of a text, each round others: together they predict every token of every training text once.
ROUNDS, RATE = 2, 0.05
#: Tokens that are scored at a time: their scores stay in the processor's cache.
PART = 2048
#: Tokens that a task holds at a time, and steps that it takes at least, by training on them again if they are all it has.
CHUNK, STEPS = 1 << 19, 60

COUNTS = "cell long, part long, counts binary, n_train long, n_types long, n_docs long, tail_n array<long>, tail_v array<long>, words binary, often binary"


def text_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tagged hashes and text numbers of the lower-cased words of a buffer, slice by slice joined."""
    hs, ds = [], []
    for lo, hi in ts.slices(off):
        d, o = ts.LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
        starts, ends, doc = ts.word_bounds(d, o)
        h = ts.word_hashes(d, starts, ends)
        tail = np.zeros(len(h), np.uint64)
        for back in (1, 2, 3):
            at = ends - back
            tail = tail * np.uint64(257) + np.where(at >= starts, d[np.maximum(at, 0)], 0).astype(np.uint64)
        hs.append((h & ~TAG) | (ts.mix(tail) % np.uint64(TAILS)))
        ds.append(doc + lo)
    return (np.concatenate(hs), np.concatenate(ds)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted different values. (np.unique alone hashes: slower.)"""
    s = np.sort(h)
    return s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _counted(n_parts: int):
    def run(t: pa.Table) -> pa.Table:
        data, off = ts.buffers(t["text"])
        h, doc = text_words(data, off)
        train = ~t["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        u = distinct(h)
        seen, n = np.unique(h[train[doc]], return_counts=True)
        c = np.zeros(len(u), np.uint32)
        c[np.searchsorted(u, seen)] = n
        cell, rows = t["cell"][0].as_py(), []
        for part, lo, hi in ranges(u, n_parts):
            rows.append((cell, part, u[lo:hi].tobytes(), c[lo:hi].tobytes(), 0))
        rows.append((cell, -1, b"", b"", int(train.sum())))
        return pa.table(list(map(list, zip(*rows))), schema=pa.schema([("cell", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64())]))

    return run


def _summed(t: pa.Table) -> pa.Table:
    """One hash range: the sum of every word's counts, given back to each cell in its own order."""
    cells, part = t["cell"].to_pylist(), t["part"][0].as_py()
    hs = [np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]]
    cs = [np.frombuffer(x.as_py(), np.uint32) for x in t["counts"]]
    h, c = np.concatenate(hs), np.concatenate(cs).astype(np.int64)
    u, inv = np.unique(h, return_inverse=True)
    total = np.bincount(inv, c, len(u)).astype(np.int64)
    none, out, at = None, [], 0
    for cell, x in zip(cells, hs):
        out.append((cell, part, total[inv[at : at + len(x)]].tobytes(), none, none, none, none, none, none, none))
        at += len(x)
    known = total > 0
    tail = (u & TAG).astype(np.int64)
    often = total >= LEAST
    out.append((-1, part, none, int(total.sum()), int(known.sum()), sum(t["n_docs"].to_pylist()), np.bincount(tail, total, TAILS).astype(np.int64).tolist(), np.bincount(tail, known, TAILS).astype(np.int64).tolist(), u[often].tobytes(), total[often].tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, pa.binary(), pa.binary()]
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return pa.table([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)], names=names)


def _frequent(least: float):
    """The words with at least ``least`` tokens, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0), b.column(1)):
                h, c = np.frombuffer(h.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[c >= least]), pa.array(c[c >= least])], ["h", "c"])

    return run


def with_ends(ids: np.ndarray, doc: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens with the end of each of ``n`` texts, the WINDOW before each (nearest first), text
    numbers. Before a text's first word stand ends."""
    size = np.bincount(doc, minlength=n) + 1
    stop = np.cumsum(size) - 1
    out = np.full(int(size.sum()), end, np.int64)
    mine = np.ones(len(out), bool)
    mine[stop] = False
    out[mine] = ids
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(out)) - np.repeat(stop - size + 1, size)
    before = np.full((len(out), WINDOW), end, np.int64)
    for k in range(WINDOW):
        before[k + 1 :, k] = np.where(place[k + 1 :] > k, out[: -k - 1], end)
    return out, before, owner


def of_round(out: np.ndarray, before: np.ndarray, owner: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a round predicts, by their places in their texts, and what is before them."""
    place = np.arange(len(out)) - np.searchsorted(owner, np.arange(owner[-1] + 1 if len(owner) else 0))[owner]
    at = place % ROUNDS == turn
    return out[at], before[at]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of x, in its place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(r: np.ndarray, x: np.ndarray, bias: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of each row of r the logarithm of the softmax of r . x + bias at ``to``."""
    s = r @ x.T
    s += bias
    s -= s.max(axis=1, keepdims=True)
    mine = s[np.arange(len(to)), to].astype(float)
    return mine - np.log(np.exp(s, out=s).sum(axis=1))


class LogBilinear:
    """Predicts a token from the WINDOW tokens before it.

    The words' vectors R, weighted by the position's vector P, add up to r. Outputs have two levels:
    a class (the vocabulary in order of frequency, cut into classes of ``width`` words; the tails; the
    end) with the score r . QC + bC, and in a class of the vocabulary a word with the score r . Q + b. Each
    level is a softmax: the probabilities of a class's words add up to that of the class.

    Token numbers: words by frequency, then tails, then the end.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tails: np.ndarray, n_docs: int, seed: int = 1):
        order = np.lexsort((words, -counts))
        self.by_hash = np.argsort(words[order])
        self.sorted = words[order][self.by_hash]
        self.v = len(words)
        self.width = max(1, int(np.ceil(np.sqrt(self.v))))
        self.n_classes = -(-self.v // self.width)
        self.end = self.v + TAILS
        c = counts[order].astype(float)
        self.q2 = (c + ALPHA) / (c + ALPHA).sum() if self.v else c
        one = np.r_[np.add.reduceat(c, np.arange(0, self.v, self.width)) if self.v else c, tails, n_docs].astype(float)
        self.q1 = (one + ALPHA) / (one + ALPHA).sum()
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.R, self.P, self.Q, self.QC = f(self.end + 1, DIM), np.full((WINDOW, DIM), 1 / WINDOW, np.float32), f(self.v, DIM), f(len(self.q1), DIM)
        self.b, self.bC = np.log(self.q2).astype(np.float32), np.log(self.q1).astype(np.float32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Token numbers of tagged hashes."""
        out = (h & TAG).astype(np.int64) + self.v
        if self.v:
            at = np.minimum(np.searchsorted(self.sorted, h), self.v - 1)
            mine = self.sorted[at] == h
            out[mine] = self.by_hash[at[mine]]
        return out

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.v, ids // self.width, ids - self.v + self.n_classes)

    def context(self, before: np.ndarray) -> np.ndarray:
        r = self.R.take(before[:, 0], axis=0) * self.P[0]
        for k in range(1, WINDOW):
            r += self.R.take(before[:, k], axis=0) * self.P[k]
        return r

    def log10(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of tokens (of a tail: of the tail) after what is before them."""
        r = self.context(before)
        cls = self.classes(ids)
        out = np.empty(len(ids))
        for a in range(0, len(ids), PART):
            i = slice(a, a + PART)
            out[i] = _log_softmax(r[i], self.QC, self.bC, cls[i])
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(self.n_classes + 1))
        for k in np.flatnonzero(np.diff(edge)):
            a, z = k * self.width, min((k + 1) * self.width, self.v)
            for x in range(edge[k], edge[k + 1], PART):
                i = order[x : min(x + PART, edge[k + 1])]
                out[i] += _log_softmax(r[i], self.Q[a:z], self.b[a:z], ids[i] - a)
        return out / np.log(10)

    def trainer(self, seed: int) -> "Trainer":
        return Trainer(self, seed)

    def rows(self, touched: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers, weights, vectors with the bias last) of the parameters that training touched."""
        out = []
        for k, (x, bias) in enumerate(self._tables()):
            at = np.flatnonzero(touched[k])
            out.append((at * 4 + k, touched[k][at], np.c_[x[at], bias[at] if bias is not None else np.zeros(len(at), np.float32)]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def take(self, row: np.ndarray, vectors: np.ndarray) -> None:
        for k, (x, bias) in enumerate(self._tables()):
            mine = row % 4 == k
            x[row[mine] // 4] = vectors[mine, :DIM]
            if bias is not None:
                bias[row[mine] // 4] = vectors[mine, DIM]

    def _tables(self):
        return [(self.R, None), (self.P, None), (self.Q, self.b), (self.QC, self.bC)]


class Trainer:
    """Noise-contrastive estimation in numpy: each token is told from noise drawn from the unigram distribution,
    at both levels. Adagrad; the noise samples are shared by a step's tokens, so scores are matrix products."""

    def __init__(self, model: LogBilinear, seed: int):
        self.m, self.rng, self.steps = model, np.random.default_rng(seed), 0
        self.touched = {k: np.zeros(len(x)) for k, (x, _) in enumerate(model._tables())}
        self.past = [np.full((len(x), DIM + 1), 1e-2, np.float32) for x, _ in model._tables()]
        self.draw = [np.cumsum(q) / q.sum() if len(q) else q for q in (model.q1, model.q2)]
        self.log_noise = [np.log(NOISE * q).astype(np.float32) for q in (model.q1, model.q2)]

    def _add(self, k: int, at: np.ndarray, g: np.ndarray) -> None:
        """Adagrad's step for rows ``at`` (repeats add up) of the k-th table."""
        order = np.argsort(at)
        s = at[order]
        edge = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
        u, g = s[edge], np.add.reduceat(g.take(order, axis=0), edge, axis=0)
        self.touched[k][u] += np.diff(np.r_[edge, len(s)])
        x, bias = self.m._tables()[k]
        past = self.past[k].take(u, axis=0)[:, : g.shape[1]] + g * g
        self.past[k][u, : g.shape[1]] = past
        g = RATE * g / np.sqrt(past)
        x[u] += g[:, :DIM]
        if bias is not None:
            bias[u] += g[:, DIM]

    def _level(self, k: int, r: np.ndarray, to: np.ndarray) -> np.ndarray:
        """One level's step; returns the gradient of r."""
        x, bias = self.m._tables()[k]
        draw, log_noise = (self.draw[0], self.log_noise[0]) if k == 3 else (self.draw[1], self.log_noise[1])
        noise = np.minimum(np.searchsorted(draw, self.rng.random(NOISE)), len(draw) - 1)
        mine, other, n = x.take(to, axis=0), x[noise], len(to)
        hit = 1 - _sigmoid(np.einsum("ij,ij->i", r, mine) + (bias[to] - log_noise[to]))
        miss = r @ other.T
        miss += bias[noise] - log_noise[noise]
        miss = _sigmoid(miss)
        g = np.empty((n + NOISE, DIM + 1), np.float32)
        np.multiply(r, hit[:, None], out=g[:n, :DIM])
        g[:n, DIM] = hit
        g[n:, :DIM] = -(miss.T @ r)
        g[n:, DIM] = -miss.sum(axis=0)
        self._add(k, np.r_[to, noise], g)
        mine *= hit[:, None]
        mine -= miss @ other
        return mine

    def step(self, to: np.ndarray, before: np.ndarray) -> None:
        m = self.m
        r = m.context(before)
        word = np.flatnonzero(to < m.v)
        inner = self._level(2, r[word], to[word]) if len(word) else None
        gr = self._level(3, r, m.classes(to))
        if inner is not None:
            gr[word] += inner
        gp = np.stack([np.einsum("ij,ij->j", gr, m.R.take(before[:, k], axis=0)) for k in range(WINDOW)])
        self._add(0, before.T.reshape(-1), np.concatenate([gr * m.P[k] for k in range(WINDOW)]))
        self._add(1, np.arange(WINDOW), gp)
        self.steps += 1

    def chunk(self, to: np.ndarray, before: np.ndarray) -> None:
        order = self.rng.permutation(len(to))
        n = max(1, min(BATCH, -(-len(to) // CUTS)))
        for a in range(0, len(to), n):
            self.step(to[order[a : a + n]], before.take(order[a : a + n], axis=0))


VECTOR = [f"x{i}" for i in range(DIM + 1)]


def _trained(model: LogBilinear, turn: int):
    """A task's training on its texts: the rows that it touched, with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.trainer(1000 * turn + TaskContext.get().partitionId())
        held, n = [], 0

        def flush() -> None:
            nonlocal n
            t.chunk(*(np.concatenate(x) for x in zip(*held)))
            n = 0

        for b in batches:
            data, off = ts.buffers(b.column(0))
            for lo, hi in ts.slices(off, 1 << 20):
                h, doc = text_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                mine, before = of_round(*with_ends(model.ids(h), doc, hi - lo, model.end), turn)
                if not len(mine):
                    continue
                held.append((mine, before))
                n += len(mine)
                if n >= CHUNK:
                    flush()
                    held = []
        if n:
            flush()
        while held and t.steps < STEPS:
            flush()
        if t.steps:
            row, weight, x = model.rows(t.touched)
            x = x * weight[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(weight), *(pa.array(x[:, i].astype(np.float64)) for i in range(DIM + 1))], ["row", "weight", *VECTOR])

    return run


def _scored(model: LogBilinear, stats: dict):
    n_train, n_types, n_docs = stats["n_train"], stats["n_types"], stats["n_docs"]
    tail_all = stats["tail_n"] + ALPHA * (stats["tail_v"] + 1)

    def run(t: pa.Table, facts: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=OUT)
        data, off = ts.buffers(t["text"])
        h, doc = text_words(data, off)
        u, n = distinct(h), t.num_rows
        order = np.argsort(facts["part"].to_numpy())
        blobs = facts["counts"].to_pylist()
        counts = np.concatenate([np.frombuffer(blobs[i], np.int64) for i in order]) if len(order) else np.zeros(0, np.int64)
        assert len(counts) == len(u), "a cell's words and counts differ"
        den = np.log10(n_train + ALPHA * (n_types + 1))
        end_base = np.log10(n_docs + ALPHA) - den
        base, score = np.full(n, end_base), np.zeros(n)
        known = np.full(n, int(n_docs > 0), np.int64)
        size = np.bincount(doc, minlength=n)
        word_base = np.log10(counts + ALPHA)
        ids = model.ids(u)
        within = np.where(ids >= model.v, word_base - np.log10(tail_all[(u & TAG).astype(np.int64)]), 0.0)
        edge = np.searchsorted(doc, np.arange(n + 1))
        for lo, hi in ts.slices(off, 1 << 18):
            a, b = edge[lo], edge[hi]
            at, d = np.searchsorted(u, h[a:b]), doc[a:b] - lo
            base[lo:hi] += np.bincount(d, word_base[at], hi - lo) - den * size[lo:hi]
            known[lo:hi] += np.bincount(d, counts[at] > 0, hi - lo).astype(np.int64)
            score[lo:hi] += np.bincount(d, within[at], hi - lo)
            out, before, owner = with_ends(ids[at], d, hi - lo, model.end)
            for x in range(0, len(out), 1 << 15):
                y = slice(x, x + (1 << 15))
                score[lo:hi] += np.bincount(owner[y], model.log10(out[y], before[y]), hi - lo)
        return pa.table([t["doc_id"].cast(pa.int64()), t["held_out"], pa.array(size + 1, pa.int64()), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score)], names=OUT)

    return run


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with ``held_out`` (by default crc32 of the id's digits divisible by 10) are
    scored, not learned from. All counts cover all training documents:

    1. Every cell counts its distinct words; hash ranges of words are summed and the sums given
       back to the cells (written once); the totals give N, V, the tails' mass and the vocabulary.
    2. The log-bilinear model is trained on every token of all training texts, each task on its own; the mean of the
       parameters that tasks touched, weighted by how often, is where the next round begins.
    3. Every cell scores its texts. The model gives normalised probabilities of words and tails
       after every context; a word of a tail shares the tail's probability with the tail's other words by
       their smoothed counts, one share being kept for words never seen.

    A null text is an empty one, of one token, the end. A null id counts as the id ''
    and is held out. Repeated rows count and are scored as often as they occur. Words of equal
    counts are ordered by hash. With no training words all counts are 0 and the scores are those of
    the smoothing alone.
    """
    if held_out is None:
        held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    n_cells = cell_count(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    celled = with_cell(d, n_cells)
    counted = celled.groupBy("cell").applyInArrow(_counted(max(1, n_cells // 2)), "cell long, part long, hashes binary, counts binary, n_docs long")
    facts = written(counted.groupBy("part").applyInArrow(_summed, COUNTS), "lm-counts")
    totals = facts.filter("cell = -1")
    r = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_types", "n_docs")]).first()
    tails = totals.select(F.posexplode(F.arrays_zip("tail_n", "tail_v"))).groupBy("pos").agg(F.sum("col.tail_n").alias("n"), F.sum("col.tail_v").alias("v")).collect()
    stats = {"n_train": r["n_train"] + r["n_docs"], "n_types": r["n_types"] + int(r["n_docs"] > 0), "n_docs": r["n_docs"], "tail_n": np.zeros(TAILS), "tail_v": np.zeros(TAILS)}
    for x in tails:
        stats["tail_n"][x["pos"]], stats["tail_v"][x["pos"]] = x["n"], x["v"]
    found = totals.select("words", "often").mapInArrow(_frequent(max(LEAST, SHARE * stats["n_train"])), "h long, c long").toArrow()  # 1 / SHARE rows at most
    words, counts = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
    k = (words & TAG).astype(np.int64)  # a word of the vocabulary leaves its tail
    stats["tail_n"] -= np.bincount(k, counts, TAILS)
    stats["tail_v"] -= np.bincount(k, minlength=TAILS)
    model = LogBilinear(words, counts, stats["tail_n"], stats["n_docs"])
    for turn in range(ROUNDS):
        made = d.filter("not held_out").select("text").mapInArrow(_trained(model, turn), "row long, weight double, " + ", ".join(f"{c} double" for c in VECTOR))
        mean = made.groupBy("row").agg(*[(F.sum(c) / F.sum("weight")).cast("float").alias(c) for c in VECTOR]).toArrow()
        if mean.num_rows:
            model.take(mean["row"].to_numpy(), np.stack([mean[c].to_numpy() for c in VECTOR], axis=1))
    back = facts.filter("cell >= 0").select("cell", "part", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return celled.groupBy("cell").cogroup(back.groupBy("cell")).applyInArrow(_scored(model, stats), schema)


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
