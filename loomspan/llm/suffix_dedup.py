"""Exact repeats of LENGTH bytes across documents, by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .cells import cell_count, give_back, ranges, with_cell
from .common import joined_if_small, table, written

LENGTH = 50
#: Bytes of an anchor, and the places in a string of LENGTH bytes where one can begin: the
#: anchor of a string is the one with the smallest hash.
ANCHOR = 24
PLACES = LENGTH - ANCHOR + 1
#: Strings in a row with one anchor stay together, this many at most.
RUN_MOST = 64
#: An anchor of more runs than this, those of all cells together, is hot: its strings are sent one by one, by
#: their own hashes. So what one anchor brings to a task is bounded, however the runs are spread over cells.
HOT_RUNS = 8192
#: A difference cover modulo V: every difference modulo V is one of two members of COVER.
V, COVER = 16, (0, 1, 2, 5, 8)
#: Suffixes sorted at a time, and bytes of contexts compared at a time.
BLOCK, PART = 1 << 18, 1 << 19
#: Texts with copies that are broadcast at most (24 bytes each).
SMALL = 500_000
#: Bytes of text that make a cell.
CELL = 7 << 20
#: Stands for a null id: larger than every id.
NO_ID = np.iinfo(np.int64).max
LOW = np.uint64(0xFFFF)

_IN_COVER = np.isin(np.arange(V), COVER)
#: SHIFT[a, b]: the least d with (a + d) % V and (b + d) % V in the cover.
SHIFT = np.array([[next(d for d in range(V) if _IN_COVER[(a + d) % V] and _IN_COVER[(b + d) % V]) for b in range(V)] for a in range(V)])


def eights(data: np.ndarray, least: int = 8) -> np.ndarray:
    """The 8 bytes from every place of ``data`` on as big-endian numbers: they sort as the bytes do."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, n, text) of the runs: ``n`` strings of LENGTH bytes from ``start`` on have
    one anchor, whose hash, mixed once more and without its lowest 16 bits, is ``key``. Unmixed, the hashes of
    anchors are small, each the least of PLACES: the first of equal ranges would hold many times its share."""
    found = []
    for lo, hi in ts.slices(off, 1 << 16):
        d = data[off[lo] : off[hi]]
        n = len(d) - LENGTH + 1
        if n <= 0:
            continue
        w = np.ndarray((len(d) - 7,), "<u8", np.ascontiguousarray(d), strides=(1,))
        m = len(d) - ANCHOR + 1
        h = w[:m] * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h += w[8 : 8 + m]
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
        h += w[16 : 16 + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        a, k = h, 1
        while 2 * k <= PLACES:
            a = np.minimum(a[:-k], a[k:])
            k *= 2
        if k < PLACES:
            a = np.minimum(a[: n], a[PLACES - k : PLACES - k + n])
        step = np.zeros(n + 1, np.int8)
        begin, stop = off[lo:hi] - off[lo], off[lo + 1 : hi + 1] - off[lo] - LENGTH + 1
        some = stop > begin
        step[begin[some]] += 1
        step[stop[some]] -= 1
        at = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
        key = a[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        if len(size) and size.max() > RUN_MOST:
            parts = -(-size // RUN_MOST)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(size, parts) - inner * RUN_MOST
            first, size = np.repeat(first, parts) + inner * RUN_MOST, np.minimum(left, RUN_MOST)
        start = at[first] + off[lo]
        found.append((ts.mix(key[first]) & ~LOW, start, size, np.searchsorted(off, start, side="right") - 1))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def range_hashes(data: np.ndarray, off: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, sorted by start, that lie within texts."""
    out, at = np.zeros(len(starts), np.uint64), 0
    for lo, hi in ts.slices(off):
        to = int(np.searchsorted(starts, off[hi]))
        if to > at:
            s = starts[at:to] - off[lo]
            out[at:to] = ts.word_hashes(data[off[lo] : off[hi]], s, s + sizes[at:to])
            at = to
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys (multiples of 2**16): the first, then of the steps between them the low 4 bytes, then the
    high 2, which are almost all 0 and so take next to nothing in a shuffle."""
    step = np.diff(keys) >> np.uint64(16)
    return keys[:1].tobytes() + step.astype(np.uint32).tobytes() + (step >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    if n < 2:
        return np.frombuffer(blob, np.uint64)
    step = np.frombuffer(blob, np.uint16, n - 1, 4 * n + 4).astype(np.uint64) << np.uint64(48)
    step |= np.frombuffer(blob, np.uint32, n - 1, 8).astype(np.uint64) << np.uint64(16)
    return np.cumsum(np.r_[np.frombuffer(blob[:8], np.uint64), step], dtype=np.uint64)


def _columns(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    give_back()
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


FACTS = ["cell", "part", "kind", "n", "keys", "flags", "sizes", "ids", "bytes"]
FACT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
FACT_SCHEMA = "cell long, part long, kind long, n long, keys binary, flags binary, sizes binary, ids binary, bytes binary"


def by_value(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``x``, where in it each different value begins, and how often it is there. (np.unique alone hashes: far slower.)"""
    order = np.argsort(x)
    s = x[order]
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, edge, np.diff(np.r_[edge, len(s)])


def _anchored(n_parts: int):
    """A cell's distinct anchors, with those flagged that two of its texts have, and their numbers of runs (as powers of 2, rounded up)."""

    def run(t: pa.Table) -> pa.Table:
        key, _, _, doc = runs_of(*ts.buffers(t["text"]))
        order, edge, size = by_value(key)
        u, doc = key[order[edge]], doc[order]
        many = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge) if len(doc) else np.zeros(0, bool)
        size = np.ceil(np.log2(size)).astype(np.uint8)
        cell = t["cell"][0].as_py()
        return _columns([(cell, p, 0, b - a, packed(u[a:b]), np.packbits(many[a:b]).tobytes(), size[a:b].tobytes(), None, None) for p, a, b in ranges(u, n_parts)], FACTS, FACT_KINDS)

    return run


def _shared(hot_runs: int):
    """One range of anchors: for each cell's anchors whether another text has them, and whether they are hot."""

    def run(t: pa.Table) -> pa.Table:
        ns, cells = t["n"].to_pylist(), t["cell"].to_pylist()
        keys = [unpacked(b.as_py(), n) for b, n in zip(t["keys"], ns)]
        flags = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n) for b, n in zip(t["flags"], ns)]
        runs = np.exp2(ts.buffers(t["sizes"])[0])
        u, inv, n_cells = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        many = (n_cells > 1) | (np.bincount(inv, np.concatenate(flags), len(u)) > 0)
        hot = np.bincount(inv, runs, len(u)) > hot_runs
        out, at, part = [], 0, t["part"][0].as_py()
        for cell, k in zip(cells, keys):
            i = inv[at : at + len(k)]
            out.append((cell, part, 1, len(k), None, np.packbits(many[i]).tobytes(), np.packbits(hot[i]).tobytes() if hot[i].any() else None, None, None))
            at += len(k)
        return _columns(out, FACTS, FACT_KINDS)

    return run


def _contexts(t: pa.Table, facts: pa.Table):
    """What a cell looks up: its distinct strings around shared anchors, and where they stand.

    Returns data, off, ids, then of the occurrences start, number of strings, text and context,
    then of the contexts key, least id, start and number of strings, sorted by key.
    """
    data, off = ts.buffers(t["text"])
    ids = t["doc_id"].to_numpy(zero_copy_only=False) if not t["doc_id"].null_count else np.array([NO_ID if x is None else x for x in t["doc_id"].to_pylist()])
    ids = ids.astype(np.int64)
    key, start, n, doc = runs_of(data, off)
    order, _, size = by_value(key)
    marks = sorted((x for x in facts.select(["part", "kind", "n", "flags", "sizes"]).to_pylist() if x["kind"] == 1), key=lambda x: x["part"])
    bits = lambda b, k: np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) if b is not None else np.zeros(k, bool)
    shared = np.concatenate([bits(x["flags"], x["n"]) for x in marks]) if marks else np.zeros(0, bool)
    hot = np.concatenate([bits(x["sizes"], x["n"]) for x in marks]) if marks else np.zeros(0, bool)
    assert len(shared) == len(size), "a cell's anchors and marks differ"
    keep = np.sort(order[np.repeat(shared, size)])
    is_hot = np.zeros(len(key), bool)
    is_hot[order[np.repeat(hot, size)]] = True
    key, start, n, doc, is_hot = key[keep], start[keep], n[keep], doc[keep], is_hot[keep]
    if is_hot.any():
        parts = np.where(is_hot, n, 1)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        key, doc, single = np.repeat(key, parts), np.repeat(doc, parts), np.repeat(is_hot, parts)
        start, n = np.repeat(start, parts) + inner, np.where(single, 1, np.repeat(n, parts))
        h = range_hashes(data, off, start, n + LENGTH - 1)
        key = np.where(single, h & ~LOW, key)
    else:
        h = range_hashes(data, off, start, n + LENGTH - 1)
    order = np.lexsort((ids[doc], h, key))
    k, x = key[order], h[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])] if len(k) else np.zeros(0, bool)
    context = np.empty(len(k), np.int64)
    context[order] = np.cumsum(new) - 1
    first = order[new]
    return data, off, ids, (start, n, doc, context), (key[first], ids[doc[first]], start[first], n[first])


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, one after the other."""
    to = np.cumsum(sizes)
    return data[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - to + sizes, sizes)]


def _sent(n_parts: int):
    def run(t: pa.Table, facts: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _columns([], FACTS, FACT_KINDS)
        data, _, _, _, (key, least, start, n) = _contexts(t, facts)
        cell = t["cell"][0].as_py()
        return _columns([(cell, p, 2, b - a, packed(key[a:b]), None, n[a:b].astype(np.uint8).tobytes(), least[a:b].tobytes(), gathered(data, start[a:b], n[a:b] + LENGTH - 1).tobytes()) for p, a, b in ranges(key, n_parts)], FACTS, FACT_KINDS)

    return run


def cover_ranks(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ranks, at the cover's places, of the next LENGTH - V bytes; -1 where they leave the string."""
    size = LENGTH - V
    rank = np.full(len(text), -1, np.int64)
    stop = np.repeat(off[1:], np.diff(off))
    at = np.flatnonzero(_IN_COVER[np.arange(len(text)) % V] & (np.arange(len(text)) + size <= stop))
    if len(at):
        e = eights(text)
        words = [e[at + j].astype(np.uint64) for j in range(0, size - 7, 8)]
        if size % 8:
            words.append(e[at + size - 8].astype(np.uint64))
        order = np.lexsort(words[::-1])
        new = np.zeros(len(at), bool)
        for w in words:
            new[1:] |= w[order[1:]] != w[order[:-1]]
        rank[at[order]] = np.cumsum(new)
    return rank


def least_ids(text: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every string of LENGTH bytes of the contexts its place and the least id that has it.

    Suffixes are sorted one bucket of leading bytes at a time: by their first V and, of the
    LENGTH bytes that count, their last V bytes. What lies between, the long ties, is decided
    by the ranks of the cover's sample, computed once: two suffixes i and j that agree so far
    are equal if the ranks at i + d and j + d are, with the d that puts both in the cover.
    """
    at = np.flatnonzero(np.arange(len(text)) + LENGTH <= np.repeat(off[1:], np.diff(off)))
    own = ids[np.searchsorted(off, at, side="right") - 1]
    least = own.copy()
    if not len(at):
        return at, least
    rank, e = cover_ranks(text, off), eights(text)
    head = e[at].astype(np.uint64)
    by_head = np.argsort(head)
    edge, lo = head[by_head], 0
    while lo < len(at):
        hi = min(lo + BLOCK, len(at))
        hi = int(np.searchsorted(edge, edge[hi - 1], side="right"))  # a bucket ends where a head does
        block = by_head[lo:hi]
        p = at[block]
        words = [edge[lo:hi], *(e[p + j].astype(np.uint64) for j in (8, LENGTH - V, LENGTH - 8))]
        order = np.lexsort(words[::-1])
        new = np.zeros(len(p), bool)
        new[0] = True
        for w in words:
            new[1:] |= w[order[1:]] != w[order[:-1]]
        group = np.cumsum(new) - 1
        idx, p = block[order], p[order]
        todo = np.flatnonzero(np.bincount(group)[group] > 1)
        while len(todo):  # each turn compares what is left of a tie with the first of it
            g = group[todo]
            first = np.r_[True, g[1:] != g[:-1]]
            leader = p[todo[np.flatnonzero(first)[np.cumsum(first) - 1]]]
            mine = p[todo]
            d = SHIFT[mine % V, leader % V]
            same = rank[mine + d] == rank[leader + d]
            m = todo[same]
            start = np.flatnonzero(np.r_[True, group[m][1:] != group[m][:-1]])
            low = np.minimum.reduceat(own[idx[m]], start)
            least[idx[m]] = np.repeat(low, np.diff(np.r_[start, len(m)]))
            todo = todo[~same]
        lo = hi
    return at, least


def _resolved(t: pa.Table) -> pa.Table:
    """One range of anchors: for every cell's contexts a bit for each string that a smaller id has.

    The range is worked through in parts of its keys, so that the arrays of one part, not
    those of the whole range, are in memory at a time. What cells sent is put together once, so the
    time doesn't grow with cells times parts."""
    ns, cells, part = t["n"].to_pylist(), t["cell"].to_pylist(), t["part"][0].as_py()
    keys = np.concatenate([unpacked(b.as_py(), n) for b, n in zip(t["keys"], ns)])
    sizes, ids, text = ts.buffers(t["sizes"])[0], np.frombuffer(ts.buffers(t["ids"])[0], np.int64), ts.buffers(t["bytes"])[0]
    long = sizes.astype(np.int64) + LENGTH - 1
    start = np.cumsum(long) - long
    order, edge, size = by_value(keys)
    stop, masks, lo = np.cumsum(np.add.reduceat(long[order], edge)), np.empty(len(keys), np.uint64), 0
    edge = np.r_[edge, len(keys)]
    while lo < len(size):  # whole keys of PART bytes, or one that is longer
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + PART, side="right")))
        at = np.sort(order[edge[lo] : edge[hi]])
        masks[at] = _answers(keys[at], sizes[at], ids[at], gathered(text, start[at], long[at]))
        lo = hi
    to = np.cumsum(ns)
    return _columns([(cell, part, 3, n, None, masks[z - n : z].tobytes(), None, None, None) for cell, n, z in zip(cells, ns, to)], FACTS, FACT_KINDS)


def _answers(key: np.ndarray, size: np.ndarray, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For contexts (key, number of strings, least id, bytes) the bits of the strings that a smaller id has."""
    if not len(key):
        return np.zeros(0, np.uint64)
    size = size.astype(np.int64)
    off = np.r_[0, np.cumsum(size + LENGTH - 1)]
    # equal contexts are one: what copies of a passage have inside
    h = range_hashes(text, off, off[:-1], np.diff(off))
    order = np.lexsort((ids, h, key))
    k, x = key[order], h[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    low, n = ids[first], size[first]
    # then the strings of all different contexts, in suffix order
    at, least = least_ids(gathered(text, off[first], n + LENGTH - 1), np.r_[0, np.cumsum(n + LENGTH - 1)], low)
    to = np.r_[0, np.cumsum(n)]
    assert len(at) == to[-1], "a context's strings and answers differ"
    owner = np.repeat(np.arange(len(key)), n[which])
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
    hit = least[to[which[owner]] + inner] < ids[owner]
    mask = np.zeros(len(key), np.uint64)
    np.bitwise_or.at(mask, owner[hit], np.uint64(1) << inner[hit].astype(np.uint64))
    return mask


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
OUT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _removed(t: pa.Table, facts: pa.Table) -> pa.Table:
    if not t.num_rows:
        return _columns([], OUT, OUT_KINDS)
    data, off, ids, (start, n, doc, context), (_, least, _, _) = _contexts(t, facts)
    found = sorted((x for x in facts.select(["part", "kind", "flags"]).to_pylist() if x["kind"] == 3), key=lambda x: x["part"])
    mask = np.concatenate([np.frombuffer(x["flags"], np.uint64) for x in found]) if found else np.zeros(0, np.uint64)
    assert len(mask) == len(least), "a cell's contexts and answers differ"
    step = np.zeros(len(data) + 1, np.int32)
    whole = ids[doc] > least[context]
    np.add.at(step, start[whole], 1)
    np.add.at(step, start[whole] + n[whole] + LENGTH - 1, -1)
    some = np.flatnonzero(~whole & (mask[context] > 0)) if len(context) else np.zeros(0, np.int64)
    owner = np.repeat(some, n[some])
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
    hit = (mask[context[owner]] >> inner.astype(np.uint64)) & np.uint64(1) > 0 if len(owner) else np.zeros(0, bool)
    np.add.at(step, start[owner[hit]] + inner[hit], 1)
    np.add.at(step, start[owner[hit]] + inner[hit] + LENGTH, -1)
    np.cumsum(step, out=step)
    gone = step[:-1] > 0
    rows, keep_text = [], "keep_text" in t.column_names
    for i, x in enumerate(t["doc_id"].to_pylist()):
        g, d = gone[off[i] : off[i + 1]], data[off[i] : off[i + 1]]
        rest = d[~g].tobytes() if g.any() else d.tobytes()
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        rows.append((x, len(d), int(g.sum()), spans, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
    return _columns(rows, OUT, OUT_KINDS)


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot_cells: int = HOT_RUNS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes if ``keep_text``, else null).

    Every byte covered by a string of LENGTH bytes that also starts in a document with a smaller
    id goes; strings are judged on the input. Each string has an anchor inside it, the
    smallest-hashed run of ANCHOR bytes, wherever the string stands. So:

    0. Copies of a whole text with a smaller id lose all of it (if it has LENGTH bytes) and
       leave here; a text is known by 128 bits of hashes.
    1. Cells of documents post their distinct anchors; hash ranges of anchors tell which of them
       two documents share. Most text has none and is done.
    2. Cells post the distinct strings around their shared anchors, strings in a row together,
       each with the least id in the cell. Equal ones are one entry per cell, so a passage of a
       third of all documents is one entry per cell. Ranges sort them blockwise by suffix
       (``least_ids``) and answer for each string whether a smaller id has it.
    3. Cells mark the bytes.

    The three uses of the documents by cell share one shuffle. Anchors of more than ``hot_cells`` runs, counted over
    all cells, whose surroundings could fill one task, are sent string by string, by the strings' own hashes.

    A null text is empty. A null id counts as larger than every id: its text removes nothing and
    is removed where an id has it. Texts of rows with equal ids don't remove each other.
    """
    n_parts = n_cells = cell_count(docs, CELL)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")}
    copied = d.select("doc_id", *[v.alias(k) for k, v in key.items()]).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null")
    d = joined_if_small(d.withColumns(key), written(copied.select("h1", "h2", "first_id"), "sd-copied"), ["h1", "h2"], "left", SMALL)
    d = d.withColumn("copy", F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    copies, size = d.filter("copy"), F.octet_length("text").cast("long")
    whole = size >= LENGTH
    rest = F.when(whole, "").otherwise(F.col("text"))
    copies = copies.select("doc_id", size.alias("n_bytes"), F.when(whole, size).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"), F.sha2(rest, 256).alias("kept_sha256"), (rest if keep_text else F.lit(None)).cast("binary").alias("kept"))
    d = d.filter("not copy").select("doc_id", "text", *([F.lit(True).alias("keep_text")] if keep_text else []))
    celled = with_cell(d, n_cells)
    anchors = celled.groupBy("cell").applyInArrow(_anchored(n_parts), FACT_SCHEMA)
    marks = anchors.groupBy("part").applyInArrow(_shared(hot_cells), FACT_SCHEMA)
    sent = celled.groupBy("cell").cogroup(marks.groupBy("cell")).applyInArrow(_sent(n_parts), FACT_SCHEMA)
    answers = sent.groupBy("part").applyInArrow(_resolved, FACT_SCHEMA)
    facts = marks.unionByName(answers)
    found = celled.groupBy("cell").cogroup(facts.groupBy("cell")).applyInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found.unionByName(copies)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
