"""License scans: winnowed fingerprints find candidate places, banded alignment measures them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .common import table
from .license_texts import TEMPLATES

#: Words in a fingerprint, and how many neighbouring fingerprints one is chosen from.
GRAM, WINDOW = 3, 4
#: How far an alignment may leave the diagonal that a hit proposes, in words: a quarter of the
#: template's length, within these bounds.
BAND_LEAST, BAND = 2, 12
#: Least share of a template's words that must match; short templates must match nearly whole.
COVERAGE, SHORT, SHORT_COVERAGE = 0.6, 20, 0.8
#: Alignments of one template are parts of one license text if they follow each other in both, with
#: at most GAP words put in between; a part has at least PART_LEAST matches that others lack.
GAP, PART_LEAST = 200, 8
#: Of a template of at least LONG words, this share of the fingerprints must be in a document before anything is
#: aligned, and what is aligned is the surroundings of hits: AROUND words on either side, hits farther apart than twice
#: that on their own.
LONG, HIT_SHARE, AROUND = 200, 0.1, 100


def words_of(data: np.ndarray, off: np.ndarray):
    d = ts.LOWER[data]
    starts, ends, doc = ts.word_bounds(d, off, ts.IS_MARK)
    return starts, ends, doc, ts.word_hashes(d, starts, ends)


def winnowed(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window; of equal ones the last. Short lists keep one."""
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class Index:
    """Inverted index: fingerprint -> (template, place), sorted by fingerprint."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.words = [t[0] for t in templates], []
        rows = []
        for i, (_, text) in enumerate(templates):
            data = np.frombuffer(text.encode(), np.uint8)
            h = words_of(data, np.array([0, len(data)]))[3]
            self.words.append(h)
            g, _ = ts.gram_hashes(h, np.zeros(len(h), np.int8), GRAM)
            rows += [(g[j], i, j) for j in winnowed(g)]
        rows.sort()
        self.prints = Counter(r[1] for r in rows)
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template, self.place = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """The matches (place in ``a``, place in ``b``) of the best local alignment of template ``a`` with words ``b``.

    Word i of the template may meet words i + shift - band to i + shift + band of ``b``.
    A match adds 1; a mismatch or a gap takes 1.
    """
    w = 2 * band + 1
    score = np.zeros((len(a) + 1, w), np.int32)  # column c of row i: word i - 1 + shift - band + c
    step = np.arange(w)
    hit = np.zeros((len(a) + 1, w), bool)
    for i in range(1, len(a) + 1):
        j = i - 1 + shift - band + step
        there = (j >= 0) & (j < len(b))
        hit[i] = there & (b[np.clip(j, 0, len(b) - 1)] == a[i - 1])
        s = score[i - 1] + np.where(hit[i], 1, -1)
        s[:-1] = np.maximum(s[:-1], score[i - 1, 1:] - 1)
        s = np.where(there, np.maximum(s, 0), 0)
        score[i] = np.maximum(np.maximum.accumulate(s + step) - step, 0)
    i, c = np.unravel_index(int(np.argmax(score)), score.shape)
    found = []
    while i > 0 and score[i, c] > 0:
        if hit[i, c] and score[i, c] == score[i - 1, c] + 1:
            found.append((int(i) - 1, int(i - 1 + shift - band + c)))
            i -= 1
        elif c + 1 < w and score[i, c] == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        elif c > 0 and score[i, c] == score[i, c - 1] - 1:
            c -= 1
        else:
            i -= 1
    return found[::-1]


def chained(parts: list[list[tuple[int, int]]], size: int) -> list[tuple[int, int, int]]:
    """(matches, first, last) of the texts that the alignments of a template of ``size`` words make up, alone or in a row.

    Of chains that share a part, the one with most matches counts.
    """
    parts = sorted(parts, key=lambda p: (p[0][1], p[-1][1]))
    need = (SHORT_COVERAGE if size < SHORT else COVERAGE) * size
    total, before = [len(p) for p in parts], [-1] * len(parts)
    for k, q in enumerate(parts):
        for m in range(k - 1, -1, -1):
            if q[0][1] - parts[m][0][1] > GAP + 2 * (size + BAND):
                break
            i, j = parts[m][-1]
            own = [x for x in q if x[0] > i and x[1] > j]
            if len(own) >= PART_LEAST and len(q) - len(own) < PART_LEAST and len(parts[m]) >= PART_LEAST and own[0][1] - j - (own[0][0] - i) <= GAP and total[m] + len(own) > total[k]:
                total[k], before[k] = total[m] + len(own), m
    out, used = [], set()
    for k in sorted(range(len(parts)), key=lambda k: (-total[k], parts[k][-1][1])):
        chain = [k]
        while before[chain[-1]] >= 0:
            chain.append(before[chain[-1]])
        matches = total[k]
        if used & set(chain):
            chain, matches = [k], len(parts[k])
        if matches >= need and not used & set(chain):
            used |= set(chain)
            out.append((matches, parts[chain[-1]][0][1], parts[k][-1][1]))
    return out


def found_in(h: np.ndarray, hits: list[tuple[int, int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """(template, matches, first, last) for one text's words; hits: (template, begin, place).

    Hits of one template whose proposed beginnings lie within the band are one candidate; of a long
    template, neighbouring ones (see LONG). The candidates' alignments are chained before their coverage is judged, so words put into a
    license text don't hide it. A match inside another with as many matches or more is left out.
    """
    parts: dict[int, list] = {}
    places: dict[int, set] = {}
    for t, _, p in hits:
        places.setdefault(t, set()).add(p)
    hits = sorted(x for x in set(hits) if len(index.words[x[0]]) < LONG or len(places[x[0]]) >= HIT_SHARE * index.prints[x[0]])
    k = 0
    while k < len(hits):
        t, begin, _ = hits[k]
        a = index.words[t]
        band = min(BAND, max(BAND_LEAST, len(a) // 4))
        end = k + 1
        while end < len(hits) and hits[end][0] == t and hits[end][1] - begin <= band:
            end += 1
        near = sorted(p for _, _, p in hits[k:end])
        cuts = [0, *(i for i in range(1, len(near)) if near[i] - near[i - 1] > 2 * AROUND), len(near)] if len(a) >= LONG else [0, len(near)]
        for i, j in zip(cuts, cuts[1:]):
            first, last = (max(0, near[i] - AROUND), near[j - 1] + GRAM + AROUND) if len(a) >= LONG else (0, len(a))
            part = a[first:last]
            at = begin + first
            lo = max(0, at - band)
            b = h[lo : max(0, at + len(part) + 2 * band)]
            if found := align(part, b, at - lo, band):
                parts.setdefault(t, []).append([(first + x, lo + y) for x, y in found])
        k = end
    out = []
    for t, found in parts.items():
        out += [(t, *x) for x in chained(found, len(index.words[t]))]
    out.sort(key=lambda x: (-x[1], x[2], x[3], x[0]))
    kept: list[tuple[int, int, int, int]] = []
    for x in out:
        if not any(y[2] <= x[2] and x[3] <= y[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[2], x[3]))


SCHEMA = "doc_id long, license string, n_matched long, n_template long, coverage double, start long, end long"


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), []
            data, off = ts.buffers(b.column(1))
            for lo, hi in ts.slices(off):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, doc, h = words_of(d, o)
                g, at = ts.gram_hashes(h, doc, GRAM)
                left, right = np.searchsorted(index.hash, g), np.searchsorted(index.hash, g, side="right")
                hits: dict[int, list] = {}
                for x in np.flatnonzero(left < right):
                    for y in range(left[x], right[x]):
                        hits.setdefault(int(doc[at[x]]), []).append((int(index.template[y]), int(at[x] - index.place[y]), int(index.place[y])))
                for i, places in hits.items():
                    a, z = np.searchsorted(doc, [i, i + 1])
                    for t, n, first, last in found_in(h[a:z], [(t, p - int(a), q) for t, p, q in places], index):
                        text = d[o[i] : o[i + 1]]
                        begin, end = (int(((text[:stop] & 0xC0) != 0x80).sum()) for stop in (starts[a + first] - o[i], ends[a + last] - o[i]))
                        size = len(index.words[t])
                        rows.append((ids[lo + i].as_py(), index.names[t], n, size, n / size, begin, end))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, text) -> a row for each license text found.

    Fingerprints of GRAM words of every document are looked up in the inverted index of the
    templates' winnowed fingerprints; each proposes where a template would begin, and a banded
    alignment there gives matched words; alignments of one template that follow each other are
    one text, with their coverage of the template and the span in code points. The index holds the
    templates alone and doesn't grow with the data; nothing is shuffled. Documents without a license text, null texts among them, give no row; equal rows
    give equal rows. A template of fewer than GRAM words has no fingerprint and isn't
    found, nor is a text of which no GRAM words in a row are left.
    """
    d = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return d.mapInArrow(_scan(Index(templates)), SCHEMA)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
