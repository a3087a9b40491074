"""Operators over the corpus against brute force: near duplicates, repeats, language model."""

import collections
import hashlib
import math
import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest

from loomspan.llm import cells, graph, lm_score, near_dup, suffix_dedup, textscan


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def test_words_and_hashes():
    texts = ["", "a b", None, " \n", "é\tñ  x", "b a", "x" * 300_000 + " a", "a"]
    data, off = textscan.buffers(pa.array(texts))
    found, hashes = collections.defaultdict(list), {}
    for lo, hi in textscan.slices(off, 64):
        d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, doc = textscan.word_bounds(d, o)
        for s, e, k, h in zip(starts, ends, doc, textscan.word_hashes(d, starts, ends)):
            w = d[s:e].tobytes().decode()
            found[lo + k].append(w)
            assert hashes.setdefault(w, h) == h
    assert [found.get(i, []) for i in range(len(texts))] == [cases.words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)
    data, off = textscan.buffers(pa.chunked_array([["ab"], [], ["c"]], pa.string()))
    assert data.tobytes() == b"abc" and off.tolist() == [0, 2, 3]


def shingles(text):
    w = cases.words((text or "").translate(cases.LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def least(ids):
    ids = [i for i in ids if i is not None]
    return min(ids) if ids else None


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 70 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = collections.defaultdict(list)
    for g, r in zip(group, rows):
        ids[g].append(r[0])
    return [(r[0], len(s), least(ids[g]), r[0] == least(ids[g])) for r, s, g in zip(rows, sets, group)]


def test_near_duplicates(docs, none):
    got = near_dup.near_duplicates(docs).collect()
    assert cases.spread((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == cases.spread(brute_components(cases.documents()))
    assert cases.spread((r.doc_id, r.n_shingles, r.n_links) for r in got) == cases.spread(brute_links(cases.documents()))
    assert max(r.class_size for r in got) >= 16 and max(r.n_links for r in got) >= 1
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_in_blocks(docs, monkeypatch):
    """Components that are cut into several blocks give the same links."""
    monkeypatch.setattr(near_dup, "BLOCK", 500)
    got = near_dup.near_duplicates(docs).collect()
    rows = cases.documents()
    assert cases.spread((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == cases.spread(brute_components(rows))
    assert cases.spread((r.doc_id, r.n_shingles, r.n_links) for r in got) == cases.spread(brute_links(rows))


def brute_links(rows):
    sets = [shingles(r[1]) for r in rows]
    each = set(sets) - {frozenset()}
    linked = {s: sum(1 for t in each if t != s and 100 * len(s & t) >= 70 * len(s | t)) for s in each}
    return [(r[0], len(s), linked.get(s, 0)) for r, s in zip(rows, sets)]


def test_near_duplicate_chains_and_thresholds(spark):
    """A chain whose ends aren't similar, and pairs just at and below the threshold."""
    rng = random.Random(2)
    rows, w = [], [f"u{i}" for i in range(104)]
    for i in range(12):
        rows.append((i, " ".join(w), "en", "s"))
        at = 8 * i
        w = w[:at] + [f"v{i}_{k}" for k in range(4)] + w[at + 4 :]
    a = [f"p{i}" for i in range(104)]
    for k, n in enumerate((17, 18, 24)):  # 100 shingles each, 83, 82 and 76 shared
        rows.append((20 + k, " ".join(a[:104 - n] + [f"q{k}_{i}" for i in range(n)]), "en", "s"))
    rng.shuffle(rows)
    got = near_dup.near_duplicates(cases.frame(spark, rows)).collect()
    assert cases.spread((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == cases.spread(brute_components(rows))


def test_near_duplicate_stage(spark, docs, none):
    out = near_dup.near_dup_stage(spark, docs, "")
    assert out.schema == docs.schema
    ids = [r.doc_id for r in out.collect()]
    kept = [r[0] for r in brute_components(cases.documents()) if r[3] and r[0] is not None]
    assert {i for i in ids if i is not None} == set(kept)
    assert collections.Counter(ids)[102] <= 1 and None in ids
    assert near_dup.near_dup_stage(spark, none, "").count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            x, y = want.setdefault(a, a), want.setdefault(b, b)
            want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    assert got == want


def brute_repeats(rows, length=50):
    first = {}
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            x = math.inf if i is None else i
            first[g] = min(first.get(g, math.inf), x)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (math.inf if i is None else i):
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("n_cells", "hot"), [(1, 256), (5, 256), (6, 1)])
def test_repeats(docs, monkeypatch, n_cells, hot):
    monkeypatch.setattr(suffix_dedup, "cell_count", lambda *_: n_cells)
    rows = cases.documents()
    got = suffix_dedup.remove_repeats(docs, keep_text=True, hot_cells=hot).collect()
    assert cases.spread((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cases.spread(brute_repeats(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_hot_anchors_are_those_of_many_runs():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghij") for _ in range(60))
    anchored, shared = suffix_dedup._anchored(1), suffix_dedup._shared(suffix_dedup.HOT_RUNS)

    def hot(texts):  # a list of texts for each cell
        facts = [anchored(pa.table({"cell": pa.array([c] * len(x), pa.int64()), "text": pa.array(x)})) for c, x in enumerate(texts)]
        marks = shared(pa.concat_tables(facts))
        assert all(any(m) for m in marks["flags"].to_pylist())
        return any(m is not None for m in marks["sizes"].to_pylist())

    assert not hot([[passage]] * 300)  # one run in each of many cells is little
    assert hot([[rng.choice("xyz") * 40 + str(i) + passage for i in range(9000)]])


def test_repeats_at_their_edges(spark, none):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij") for _ in range(400))
    rows = [(5, text, "en", "s"), (3, text[100:149], "en", "s"), (2, text[200:250], "en", "s"), (9, "x" + text[50:101] + "y" + text[90:170], "en", "s"), (7, text[:60] + text[:60], "en", "s"), (1, "ab" * 200, "en", "s"), (8, "ba" * 100 + "z", "en", "s"), (4, text[300:] + "é😀" * 30, "en", "s"), (6, "é😀" * 30, "en", "s")]
    got = suffix_dedup.remove_repeats(cases.frame(spark, rows)).drop("kept").collect()
    assert cases.spread(map(tuple, got)) == cases.spread(brute_repeats(rows))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_least_ids_agree_with_a_dictionary():
    rng = random.Random(6)
    base = "".join(rng.choice("ab") for _ in range(300))
    texts = [base[a : a + rng.randint(50, 110)] for a in (rng.randrange(200) for _ in range(60))] + ["a" * 113, "a" * 90]
    ids = np.array([rng.randrange(40) for _ in texts])
    text = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    best = {}
    for t, i in zip(texts, ids):
        for k in range(len(t) - 49):
            best[t[k : k + 50]] = min(best.get(t[k : k + 50], 99), i)
    at, low = suffix_dedup.least_ids(text, off, ids)
    whole = "".join(texts)
    assert len(at) == sum(max(0, len(t) - 49) for t in texts)
    assert all(best[whole[a : a + 50]] == b for a, b in zip(at, low))


def test_difference_cover():
    inside = {d % suffix_dedup.V for d in suffix_dedup.COVER}
    for a in range(suffix_dedup.V):
        for b in range(suffix_dedup.V):
            d = suffix_dedup.SHIFT[a, b]
            assert (a + d) % suffix_dedup.V in inside and (b + d) % suffix_dedup.V in inside and d < suffix_dedup.V


def test_packed_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64) & ~suffix_dedup.LOW)
    near = np.arange(1000, dtype=np.uint64) << np.uint64(20)
    for k in (keys, keys[:1], keys[:0], near):
        assert (suffix_dedup.unpacked(suffix_dedup.packed(k), len(k)) == k).all()
    assert [(p, a, z) for p, a, z in cells.ranges(np.array([1, 2, 1 << 63], np.uint64), 2)] == [(0, 0, 2), (1, 2, 3)]


def test_ranges_of_anchors_hold_equal_shares():
    data = np.random.default_rng(1).integers(97, 123, 400_000, np.uint8)
    keys = np.sort(suffix_dedup.runs_of(data, np.arange(0, len(data) + 1, 1000))[0])
    for n in (8, 40):
        size = [z - a for _, a, z in cells.ranges(keys, n)]
        assert len(size) == n and max(size) < 1.3 * len(keys) / n
        # 6 bytes a key at most, however far apart they are
        assert all(len(suffix_dedup.packed(keys[a:z])) <= 6 * (z - a) + 2 for _, a, z in cells.ranges(keys, n))


def brute_unigrams(rows):
    tok = [cases.words((r[1] or "").translate(cases.LOWER)) + [None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    c = collections.Counter(x for t, h in zip(tok, held) if not h for x in t)
    n, v = sum(c.values()), len(c)
    den = n + 0.1 * (v + 1)
    return [(r[0], h, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / den) for x in t), 5)) for r, t, h in zip(rows, tok, held)]


@pytest.mark.parametrize("n_cells", [1, 4])
def test_lm_base(docs, monkeypatch, n_cells):
    monkeypatch.setattr(lm_score, "cell_count", lambda d: n_cells)
    got = lm_score.score_documents(docs).collect()
    assert cases.spread((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == cases.spread(brute_unigrams(cases.documents()))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_empty(spark, none):
    assert lm_score.score_documents(none).count() == 0
    row = lm_score.score_documents(cases.frame(spark, [(None, "only held out", "en", "s")])).first()
    assert (row.held_out, row.n_known, row.train_tokens) == (True, 0, 0) and math.isfinite(row.base_score) and math.isfinite(row.score)


def test_lm_learns_and_is_normalised(spark):
    """Two languages: words of one don't follow words of the other; held-out texts score better than by unigrams."""
    rng = random.Random(7)
    vocabulary = [[f"{a}{k}{'ing' if a == 'x' else 'ung'}" for k in range(300)] for a in "xy"]
    rows = []
    for i in range(300):
        words = vocabulary[i % 2]
        rows.append((i, " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(80)), "en", "s"))
    got = lm_score.score_documents(cases.frame(spark, rows)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 10
    base, score = (sum(getattr(r, k) for r in held) / sum(r.n_tokens for r in held) for k in ("base_score", "score"))
    assert score > base + 0.15


def naive_log10(m, ids):
    """Log10 probabilities of one text's tokens, one output after the other."""
    out, past = [], [m.end] * lm_score.WINDOW
    for i in [*ids, m.end]:
        r = sum(m.P[k].astype(float) * m.R[past[-1 - k]] for k in range(lm_score.WINDOW))
        first = [math.exp(r @ m.QC[c] + m.bC[c]) for c in range(len(m.bC))]
        c = i // m.width if i < m.v else m.n_classes + i - m.v
        p = first[c] / sum(first)
        if i < m.v:
            inner = {w: math.exp(r @ m.Q[w] + m.b[w]) for w in range(m.v) if w // m.width == c}
            p *= inner[i] / sum(inner.values())
        out.append(math.log10(p))
        past.append(i)
    return out


def test_lm_scores_agree_with_one_output_after_the_other(docs, monkeypatch):
    """The whole query against a plain computation from the trained model's numbers."""
    kept = {}
    made = lm_score._scored
    monkeypatch.setattr(lm_score, "_scored", lambda m, stats: kept.update(m=m, stats=stats) or made(m, stats))
    got = lm_score.score_documents(docs).collect()
    m, stats = kept["m"], kept["stats"]
    rows = cases.documents()
    c = collections.Counter(w for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 for w in cases.words((r[1] or "").translate(cases.LOWER)))
    assert 50 < m.v < len(c) and m.n_classes > 1
    want = []
    for i, text, *_ in rows:
        words = cases.words((text or "").translate(cases.LOWER))
        if len(words) > 300:
            continue
        h = lm_score.text_words(*textscan.buffers(pa.array([(text or "").translate(cases.LOWER)])))[0]
        ids = m.ids(h).tolist()
        score = sum(naive_log10(m, ids))
        for w, x, tag in zip(words, ids, (h & lm_score.TAG).astype(int)):
            if x >= m.v:
                score += math.log10((c[w] + 0.1) / (stats["tail_n"][tag] + 0.1 * (stats["tail_v"][tag] + 1)))
        want.append((i, len(words), round(score, 2)))
    assert cases.spread((r.doc_id, r.n_tokens - 1, round(r.score, 2)) for r in got if r.n_tokens <= 301) == cases.spread(want)


@pytest.mark.parametrize("v", [0, 1, 7, 50])
def test_lm_is_normalised(v):
    rng = np.random.default_rng(v)
    m = lm_score.LogBilinear(np.arange(v, dtype=np.uint64) * np.uint64(1000), np.arange(v)[::-1] + 3, np.zeros(lm_score.TAILS), 2)
    for x, _ in m._tables():
        x += rng.normal(0, 1, x.shape).astype(np.float32)
    before = rng.integers(0, m.end + 1, (4, lm_score.WINDOW))
    every = np.arange(m.end + 1)
    for b in before:
        assert (10 ** m.log10(every, np.repeat(b[None], len(every), axis=0))).sum() == pytest.approx(1, abs=1e-4)


def test_lm_vocabulary_orders_ties_by_hash():
    """Words of equal counts have the same numbers in whatever order they come."""
    h, c = np.arange(1, 40, dtype=np.uint64) * np.uint64(12800), np.repeat([7, 3, 3], 13)
    order = np.random.default_rng(0).permutation(39)
    one, two = (lm_score.LogBilinear(h[i], c[i], np.zeros(lm_score.TAILS), 1) for i in (np.arange(39), order))
    assert (one.ids(h) == two.ids(h)).all() and sorted(one.ids(h).tolist()) == list(range(39)) and (one.q2 == two.q2).all()


def test_lm_trains_on_every_token(monkeypatch):
    """The rounds together predict each token of each text, and its end, once."""
    texts = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((40, 1, 0, 7, 300))]
    words = lm_score.text_words(*textscan.buffers(pa.array(texts)))[0]
    m = lm_score.LogBilinear(words, np.full(len(words), 3), np.zeros(lm_score.TAILS), len(texts))
    seen = collections.Counter()
    monkeypatch.setattr(lm_score, "STEPS", 0)
    monkeypatch.setattr(lm_score, "TaskContext", type("Task", (), {"get": lambda: type("Here", (), {"partitionId": lambda self: 0})()}))
    monkeypatch.setattr(lm_score.Trainer, "chunk", lambda self, to, before: seen.update(to.tolist()))
    for turn in range(lm_score.ROUNDS):
        list(lm_score._trained(m, turn)(iter([pa.record_batch([pa.array(texts)], ["text"])])))
    assert seen == {**{int(i): 1 for i in m.ids(words)}, m.end: len(texts)}


def test_lm_rows_carry_all_that_training_changed():
    m = lm_score.LogBilinear(np.arange(20, dtype=np.uint64) * np.uint64(1000), np.arange(20) + 3, np.ones(lm_score.TAILS), 2)
    t, rng = m.trainer(3), np.random.default_rng(0)
    t.chunk(rng.integers(0, m.end + 1, 500), rng.integers(0, m.end + 1, (500, lm_score.WINDOW)))
    row, weight, x = m.rows(t.touched)
    other = lm_score.LogBilinear(np.arange(20, dtype=np.uint64) * np.uint64(1000), np.arange(20) + 3, np.ones(lm_score.TAILS), 2)
    other.take(row, x)
    assert (weight > 0).all() and all((p[0] == q[0]).all() and (p[1] is None or (p[1] == q[1]).all()) for p, q in zip(m._tables(), other._tables()))
