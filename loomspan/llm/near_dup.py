"""Near-duplicate documents: MinHash signatures, an inverted join of their coordinates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textscan as ts
from .cells import give_back
from .common import drop, joined_if_small, packed, row_key, small_batches, table, written
from .graph import components

K = 5
COORDS = 64
#: Coordinates that a pair must share. At a Jaccard similarity of 0.7 a pair shares 44.8 on
#: average with a deviation of 3.7, so fewer than 24 has a probability of about 1e-8.
MATCHES = 24
PERCENT = 70
#: Rows that are broadcast at most (about 60 bytes each).
SMALL = 500_000
#: Shingles of a block, a class counting 4 * COORDS besides: what a task has of one component at a time, twice.
#: Small components share bins of a quarter of this.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240117)
_A = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2)


def shingle_sets(texts, k: int = K) -> Iterator[np.ndarray]:
    """For each text in turn the sorted distinct hashes of its word k-shingles.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    data, off = ts.buffers(texts)
    for lo, hi in ts.slices(off):
        d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        d = ts.LOWER[d]
        starts, ends, doc = ts.word_bounds(d, o)
        h = ts.word_hashes(d, starts, ends)
        n = np.bincount(doc, minlength=hi - lo)
        grams, at = ts.gram_hashes(h, doc, k)
        n_grams = np.maximum(n - k + 1, 0)
        g, w = 0, 0
        for i in range(hi - lo):
            if n_grams[i]:
                yield np.unique(grams[g : g + n_grams[i]])
            elif n[i]:
                yield ts.gram_hashes(h[w : w + n[i]], np.zeros(n[i], np.int8), int(n[i]))[0] + np.uint64(n[i])
            else:
                yield np.zeros(0, np.uint64)
            g += n_grams[i]
            w += n[i]


def node_of(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set, as two signed numbers: equal sets, equal name."""
    out = []
    for salt in ts._SHIFT[:2]:
        h = (int(ts.mix(s ^ salt).sum(dtype=np.uint64)) + len(s) * int(salt)) % (1 << 64)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out[0], out[1]


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest hash under each of COORDS hash functions, whole: equal values come from one shingle."""
    best = np.full(COORDS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 512):
        np.minimum(best, (s[i : i + 512, None] * _A + _B).min(axis=0), out=best)
    return best.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, node, sig = [], [], []
        for s in shingle_sets(b.column(1)):
            n.append(len(s))
            node.append(node_of(s))
            sig.append(signature(s) if len(s) else np.zeros(COORDS, np.int64))
        flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64))
        sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDS), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), *(pa.array([x[k] for x in node], pa.int64()) for k in (0, 1)), sigs], ["doc_id", "r1", "r2", "n", "node", "node2", "sig"])
        give_back()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows without those that repeat an earlier one of it: equal rows don't gather in one group."""
    seen: set = set()
    for b in batches:
        keep = []
        for i, k in enumerate(zip(b.column("r1").to_pylist(), b.column("r2").to_pylist())):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def links_of(sets: list[np.ndarray], block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each of the different sets its number of links and a number for its group of linked sets.

    Sets are taken by size. Each merges the posting lists of its (coordinate, value) pairs but for
    its MATCHES - 1 longest: a partner that shares MATCHES pairs is in one of the others. In the
    lists, what lies before the set or beyond the sizes that allow the threshold is skipped by
    binary search. The candidates' collisions are counted over all coordinates, and of those with
    MATCHES the full sets are compared. With ``block``, only sets of different blocks are compared.
    """
    m = len(sets)
    links, group = np.zeros(m, np.int64), np.arange(m)
    if m < 2:
        return links, group
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    sig = np.stack([signature(sets[i]) for i in order])
    grams, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    off = np.r_[0, np.cumsum(size)]
    values, which, often = np.unique(sig, return_inverse=True, return_counts=True)
    which = which.reshape(sig.shape)
    posts = np.argsort(which.reshape(-1), kind="stable") // COORDS  # by value, then by size
    edge = np.r_[0, np.cumsum(often)]
    del values
    mine = np.zeros(len(grams), bool)
    side = None if block is None else block[order]
    for i in range(m - 1):
        last = int(np.searchsorted(size, size[i] * 100 // PERCENT, side="right"))
        lists = which[i][np.argsort(-often[which[i]], kind="stable")][MATCHES - 1 :]
        found = []
        for x in lists[often[lists] > 1]:
            p = posts[edge[x] : edge[x + 1]]
            found.append(p[np.searchsorted(p, i, side="right") : np.searchsorted(p, last)])
        near = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if side is not None:
            near = near[side[near] != side[i]]
        near = near[(sig[near] == sig[i]).sum(axis=1) >= MATCHES]
        if not len(near):
            continue
        mine[ids[off[i] : off[i + 1]]] = True
        to = np.cumsum(size[near])
        at = np.arange(to[-1]) + np.repeat(off[near] - to + size[near], size[near])
        both = np.add.reduceat(mine[ids[at]].astype(np.int64), to - size[near])
        mine[ids[off[i] : off[i + 1]]] = False
        near = near[100 * both >= PERCENT * (size[i] + size[near] - both)]
        links[i] += len(near)
        links[near] += 1
        joined = np.unique(group[np.r_[i, near]])
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return links[back], order[group[back]]


def _linked(t: pa.Table) -> pa.Table:
    """One bin of small components, or one pair of blocks of a large one: the links of its classes."""
    found: dict = {}
    names = list(zip(*(t[c].to_pylist() for c in ("comp", "node", "node2", "block"))))
    for name, s in zip(names, shingle_sets(t["text"])):
        assert node_of(s) == name[1:3], "a text isn't the one that its class was made from"
        found.setdefault(name[0], {})[name[1:3]] = (s, name[3])
    cross, out, members = t["i"][0].as_py() != t["j"][0].as_py(), [], None
    for members in found.values():
        keys = list(members)
        links, group = links_of([members[k][0] for k in keys], np.array([members[k][1] for k in keys]) if cross else None)
        out += [(*keys[k], *keys[group[k]], int(links[k])) for k in np.flatnonzero(links)]
    del found, members
    give_back()
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names=["node", "node2", "root", "root2", "n_links"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> every row as (doc_id, r1, r2, n_shingles, class_id, class_size, n_links,
    component_id, kept); r1, r2 are the row_key of id and text.

    1. Rows with equal shingle sets form a class; from here on only classes count, so
       thousands of copies are one node. A class is named by a 128-bit hash of its set.
    2. Every class is posted under its 64 (coordinate, value) pairs. Pairs that occur once
       are dropped. Of the rest, ordered by frequency, a class keeps what is outside its 23
       most frequent: two classes that share at least 24 of 64 must meet in what is kept
       (prefix filter), so passages in many documents are skipped unless they make up more
       than a third of a document.
    3. Classes that meet in a list, directly or over others, are a candidate component. The texts of
       its classes, one each, meet in a task, which merges their posting lists and
       confirms candidates on full sets (``links_of``). Small components share bins; a large one is cut
       into blocks of BLOCK shingles, and each pair of blocks is a task. No pair leaves a task: it
       gives its classes' numbers of links and a star of those that are connected.

    ``n_links`` is the number of other classes that a row's class is linked with, exactly: of m
    different near copies that takes m * m / 2 comparisons; equal texts cost nothing. Rows without words are
    linked with nothing. A null doc_id stands for no id: it never names a component unless
    all ids of it are null. Repeated rows are copies.
    """
    on = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    on = on.select("doc_id", "text", *row_key("doc_id", "text"))
    with small_batches(docs.sparkSession):
        rows = written(on.mapInArrow(_signed, "doc_id long, r1 long, r2 long, n long, node long, node2 long, sig array<long>"), "nd-rows")
    key = ["node", "node2"]
    classes = rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n"), F.min(F.struct("r1", "r2")).alias("row"), F.first("sig").alias("sig"))
    classes = written(classes, "nd-classes")
    posts = classes.select("node", F.explode("sig").alias("key"))
    often = posts.groupBy("key").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("often"), F.desc("key")))
    prefix = posts.join(often, "key").withColumn("rank", rank).filter(F.col("rank") > MATCHES - 1).select("node", "key")
    prefix = written(prefix, "nd-prefix")
    lists = prefix.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = written(components(prefix.join(lists, "key").select(F.col("hub").alias("a"), F.col("node").alias("b"))), "nd-met")
    drop(prefix)
    wanted = met.join(classes.select(*key, "n", "row.*"), "node")
    weight = F.col("n") + 4 * COORDS
    total = wanted.groupBy("comp").agg(F.sum(weight).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    wanted = written(wanted.join(total, "comp").withColumn("block", F.pmod(F.xxhash64("node2", "node"), F.col("blocks"))), "nd-wanted")
    n_bins = max(1, -(-4 * (wanted.agg(F.sum(weight)).first()[0] or 0) // BLOCK))
    texts = joined_if_small(on.select("r1", "r2", "text"), wanted, ["r1", "r2"], "inner", SMALL)
    texts = texts.select("r1", "r2", "text", *key, "comp", "blocks", "block")
    texts = texts.mapInArrow(_once, texts.schema).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    place = [F.when(one, F.pmod(F.xxhash64("comp"), F.lit(n_bins))).otherwise(F.col("comp")).alias("bin"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    tiles = texts.select("text", *key, "comp", "block", one.alias("one"), *place)
    found = tiles.groupBy("one", "bin", "i", "j").applyInArrow(_linked, "node long, node2 long, root long, root2 long, n_links long")
    with small_batches(docs.sparkSession):
        found = written(found, "nd-found")
    degree = found.groupBy(*key).agg(F.sum("n_links").alias("n_links"))
    star = found.select(*key, F.col("root").alias("comp"), F.col("root2").alias("comp2"))
    if wanted.filter("blocks > 1").limit(1).count():  # the stars of pairs of blocks are connected; a component's other stars are complete
        large = wanted.filter("blocks > 1").select(*key)
        over = star.join(large, key, "left_semi")
        joined = components(over.select(F.col("node").alias("a"), F.col("comp").alias("b"))).select("node", "comp", F.lit(0).cast("long").alias("comp2"))
        star = star.join(large, key, "left_anti").unionByName(large.join(joined, "node").select(*star.columns))
    nodes = classes.select(*key, "rep", "class_size").join(degree, key, "left").join(star.distinct(), key, "left")
    nodes = nodes.withColumns({"comp2": F.when(F.col("comp").isNull(), F.col("node2")).otherwise(F.col("comp2")), "comp": F.coalesce("comp", "node")})
    ids = nodes.groupBy("comp", "comp2").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(ids, ["comp", "comp2"]).select(*key, F.col("rep").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    nodes = written(nodes, "nd-nodes")
    drop(classes, wanted, met, found)
    out = rows.select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), *(F.when(F.col("n") > 0, F.col(k)).alias(k) for k in key)).join(nodes, key, "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id",
        "r1",
        "r2",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("r1", "r2")


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one document stays, the one with the smallest id.

    Rows are told apart by id and text: rows equal in both stay once, and an id with two texts
    can lose one of them. Documents without words are in no component and stay, and so do
    rows without an id.
    """
    found = written(near_duplicates(docs).filter("doc_id is not null").select("r1", "r2", "kept"), "nd-kept")
    key = ["r1", "r2"]
    r1, r2 = row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = packed(docs, r1=r1, r2=r2)
    out = joined_if_small(out, found.filter("not kept").select(key).distinct(), key, "left_anti", SMALL)
    twice = found.filter("kept").groupBy(key).count().filter("count > 1").select(key)
    if twice.limit(1).count():
        twice = written(twice, "nd-twice")
        once = joined_if_small(out, twice, key, "left_anti", SMALL)
        out = once.unionByName(joined_if_small(out, twice, key, "left_semi", SMALL).dropDuplicates(key))
    return out.select("_row.*")
