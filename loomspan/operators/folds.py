"""Ordered folds over the blocks of one document, in plain Python.

What these compute depends on what they emitted before (overlap, deferred titles, an answer
to a prompt), so no window expresses it. A fold sees one document at a time, as a stream of
rows that arrive clustered by source and in order: a task holds one document, never a partition.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.functions.strings import split_sentences_py
from loomspan.functions.vectors import percentile, savitzky_golay
from loomspan.schema import CHUNK, STANDALONE

Block = dict
Chunk = dict
FOLD_COLUMNS = ["source", "kind", "text", "page_idx", "bbox", "title_level", "html", "img_path", "captions", "footnotes", "block_index", "reading_order"]
DELIMITERS = [*(mark + " " for mark in ".!?"), "\n"]


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[Block]]]:
    """Each source with its blocks."""
    rows = (r for b in batches for r in b.to_pylist())
    for source, group in groupby(rows, key=lambda r: r["source"]):
        yield source, list(group)


def in_documents(blocks: DataFrame) -> DataFrame:
    return blocks.select(*FOLD_COLUMNS).repartition("source").sortWithinPartitions("source", "reading_order", "block_index")


def fold(blocks: DataFrame, fn: Callable[[list[Block]], list[Chunk]]) -> DataFrame:
    """Blocks -> chunks by ``fn``, one document at a time: one shuffle, sorted within partitions."""
    schema = to_arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Chunk] = []
        for source, group in documents(batches):
            out += linked(fn(group), source)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return in_documents(blocks).mapInArrow(run, CHUNK)


def fold_numbers(blocks: DataFrame, fns: dict[str, Callable[[list[Block]], list[Chunk]]]) -> DataFrame:
    """(strategy, source, chunk_index): all chunks by each of ``fns``, under its name, in one pass.

    Every fold makes its chunks in whole, but a document is sorted and read once for all of them, and
    only the numbers go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32()))], ["strategy", "source", "chunk_index"])

        for source, group in documents(batches):
            for name, fn in fns.items():
                out += [(name, c["source"], c["chunk_index"]) for c in linked(fn(group), source)]
                if len(out) >= 10_000:
                    yield batch()
                    out = []
        if out:
            yield batch()

    return in_documents(blocks).mapInArrow(run, "strategy string, source string, chunk_index int")


def linked(chunks: list[Chunk], source: str | None) -> list[Chunk]:
    """Numbers chunks and links neighbours where a fold hasn't done so."""
    for i, c in enumerate(chunks):
        c["source"] = source
        if "chunk_index" not in c:
            c.update(chunk_index=i, prev_chunk_index=i - 1 if i else None, next_chunk_index=i + 1 if i + 1 < len(chunks) else None)
    return chunks


def new_chunk(content: str, kind: str, titles: Titles, blocks: list[Block], reading_order: int | None, extras: dict | None = None) -> Chunk:
    return {
        "page_content": content,
        "kind": kind,
        "title_path": titles.path,
        "title_level": titles.level,
        "position_int": [[b["page_idx"], *(b["bbox"] or [])] for b in blocks],
        "extras": extras or {},
        "block_indices": [b["block_index"] for b in blocks],
        "reading_order": reading_order,
        "token_count": 0,
        "content_hash": "",
        "doc_summary": "",
        "chunk_context": "",
        "granularity": "",
    }


@dataclass
class Titles:
    """The breadcrumb in force: a title cuts the stack by number to its level less one."""

    stack: list[str] = field(default_factory=list)
    level: int = 0

    @property
    def path(self) -> str:
        return " > ".join(self.stack)

    def enter(self, block: Block) -> None:
        self.level = block["title_level"] or 1
        text = (block["text"] or "").strip()
        self.stack = self.stack[: max(self.level - 1, 0)] + ([text] if text else [])


def content_of(b: Block) -> str:
    if b["text"]:
        return b["text"]
    captions = " ".join(b["captions"] or [])
    if b["kind"] == "table":
        return b["html"] or captions
    return captions if b["kind"] == "image" else ""


def alone(b: Block, titles: Titles) -> Chunk:
    extras = {k: b[k] for k in ("html", "img_path", "captions", "footnotes") if b[k]}
    return new_chunk(content_of(b), b["kind"], titles, [b], b["reading_order"], extras)


def tail_within(items: list, size: Callable, most: int) -> tuple[list, int]:
    """The longest run at the end whose sizes add up to ``most`` at most, and their sum."""
    total, k = 0, len(items)
    while k and total + size(items[k - 1]) <= most:
        k -= 1
        total += size(items[k])
    return items[k:], total


def token_chunks(blocks: list[Block], count: Callable[[str], int], max_tokens: int, overlap: int, discarded: bool) -> list[Chunk]:
    """Whole blocks are packed up to ``max_tokens``; the next window begins with the last ones that
    fit into ``overlap``. What is carried over isn't checked against the limit again, so a
    window can hold up to overlap + one block more. A block above the limit stands alone with
    its kind. Titles and standalone blocks end the window and its overlap."""
    out: list[Chunk] = []
    titles, buf, total = Titles(), [], 0

    def flush() -> None:
        nonlocal buf, total
        if buf:
            mine = [b for b, _ in buf]
            out.append(new_chunk(" ".join(b["text"] for b in mine if b["text"]), "text", titles, mine, mine[0]["reading_order"]))
            buf, total = tail_within(buf, lambda x: x[1], overlap)

    for b in blocks:
        kind = b["kind"]
        if kind == "discarded" and not discarded:
            continue
        n = count(b["text"] or "")
        if kind == "title" or kind in STANDALONE or n > max_tokens:
            flush()
            buf, total = [], 0
            if kind == "title":
                titles.enter(b)
            out.append(alone(b, titles) if kind == "title" or kind in STANDALONE else new_chunk(b["text"] or "", kind, titles, [b], b["reading_order"]))
            continue
        if total + n > max_tokens:
            flush()
        buf.append((b, n))
        total += n
    flush()
    return out


@dataclass
class Sentence:
    text: str
    tokens: int
    blocks: list[Block]


def run_sentences(run: list[Block], count: Callable[[str], int], delimiters: list[str], include: str | None, least: int) -> list[Sentence]:
    """Sentences of a run of blocks, whose stripped texts are joined by line breaks, with the blocks
    that each overlaps."""
    spans, parts, at = [], [], 0
    for b in run:
        text = (b["text"] or "").strip()
        if text:
            at += bool(parts)
            spans.append((at, at + len(text), b))
            parts.append(text)
            at += len(text)
    merged, begin, out = "\n".join(parts), 0, []
    if not merged:
        return out
    for s in split_sentences_py(merged, delimiters, include, least):
        found = merged.find(s, begin)
        if found < 0:
            found = merged.find(s)
        a = begin if found < 0 else found
        begin = a + len(s)
        mine = [b for lo, hi, b in spans if hi > a and lo < begin]
        out.append(Sentence(s, count(s), mine or [spans[0][2]]))
    return out


def rendered(sentences: list[Sentence]) -> str:
    out = ""
    for s in (x.text.strip() for x in sentences):
        if not s:
            continue
        glue = out and out[-1] not in " \n\t([{/-" and s[0] not in " \n\t.,;:!?)]}/-"
        out += (" " if glue else "") + s
    return out


def distinct_blocks(sentences: list[Sentence]) -> list[Block]:
    return list({id(b): b for s in sentences for b in s.blocks}.values())


@dataclass(frozen=True)
class SentenceRules:
    chunk_size: int = 512
    overlap: int = 128
    reserved: int = 0
    min_sentences: int = 1
    min_chars: int = 12
    delimiters: tuple[str, ...] = tuple(DELIMITERS)
    include_delim: str | None = "prev"
    discarded: bool = False
    #: Also what looks like oversight: an empty title chunk after each title whose text was
    #: emitted, and a title's tokens kept off the limit after an oversized sentence.
    compat: bool = False


def sentence_chunks(blocks: list[Block], count: Callable[[str], int], rules: SentenceRules) -> list[Chunk]:
    """Sentences are packed up to chunk_size less the tokens of a title that waits to head the next
    chunk. A title without text after it is a chunk of its own. An oversized sentence is a chunk
    of its own; the overlap that a full buffer leaves before it is emitted once more."""
    out: list[Chunk] = []
    titles, buf, total = Titles(), [], 0
    waiting: Block | None = None
    prefix, prefix_level, prefix_tokens = "", 0, 0

    def headed(text: str, keep_tokens: bool = False) -> str:
        nonlocal waiting, prefix, prefix_tokens
        if prefix:
            text, prefix = f"{prefix}\n\n{text}", ""
            if not keep_tokens:
                prefix_tokens = 0
        if not rules.compat:
            waiting, prefix_tokens = None, 0
        return text

    def emit(forced: bool) -> None:
        nonlocal buf, total
        if not buf or (not forced and len(buf) < rules.min_sentences):
            return
        mine = distinct_blocks(buf)
        out.append(new_chunk(headed(rendered(buf)), "text", titles, mine, buf[0].blocks[0]["reading_order"]))
        buf, total = ([], 0) if forced else tail_within(buf, lambda s: s.tokens, rules.overlap)

    def emit_title() -> None:
        nonlocal waiting, prefix, prefix_tokens
        if waiting is not None:
            c = new_chunk(prefix, "title", titles, [waiting], waiting["reading_order"])
            c.update(title_path=prefix, title_level=prefix_level)
            out.append(c)
            waiting, prefix, prefix_tokens = None, "", 0

    def limit() -> int:
        return max(10, rules.chunk_size - rules.reserved - prefix_tokens)

    def flush_run(run: list[Block]) -> None:
        nonlocal total
        for s in run_sentences(run, count, list(rules.delimiters), rules.include_delim, rules.min_chars):
            if s.tokens > limit():
                emit(False)
                emit(True)
                out.append(new_chunk(headed(s.text, keep_tokens=True), s.blocks[0]["kind"], titles, s.blocks, min(b["reading_order"] for b in s.blocks)))
                continue
            if total + s.tokens > limit():
                emit(False)
                if total + s.tokens > limit():
                    emit(True)
            buf.append(s)
            total += s.tokens

    run: list[Block] = []
    for b in blocks:
        kind = b["kind"]
        if kind == "discarded" and not rules.discarded:
            continue
        if kind != "title" and kind not in STANDALONE:
            if (b["text"] or "").strip():
                run.append(b)
            continue
        flush_run(run)
        run = []
        emit(True)
        emit_title()
        if kind == "title":
            titles.enter(b)
            waiting, prefix, prefix_level = b, titles.path, titles.level
            prefix_tokens = count(prefix + "\n\n") if prefix else 0
        else:
            out.append(alone(b, titles))
    flush_run(run)
    emit(True)
    emit_title()
    return out


#: Levels of recursive splitting: delimiters (None: white space) and where they go.
RECURSIVE_LEVELS: tuple[tuple[tuple[str, ...] | None, str | None], ...] = (
    (("\n" * 2, "\n" * 3), None),
    (tuple(mark + gap for gap in " \n" for mark in ".!?"), "prev"),
    (tuple(mark + " " for mark in ",;:"), "prev"),
    (None, "prev"),
    (None, None),
)


def split_at_level(text: str, delimiters: tuple[str, ...] | None, include: str | None, least: int) -> list[str]:
    if delimiters is not None:
        return split_sentences_py(text, list(delimiters), include, least)
    return [w for w in text.split() if len(w) >= least] or [text.strip()]


def recursive_split(text: str, count: Callable[[str], int], size: int, levels=RECURSIVE_LEVELS, least: int = 24, word_least: int = 1, hard: bool = False, level: int = 0) -> list[str]:
    """Pieces of at most ``size`` tokens, by the first level that parts the text; pieces still too
    large go to the next, the others are joined by blanks as far as they fit. After the last
    level a piece is left too large, or with ``hard`` cut by characters."""
    if not text.strip():
        return []
    if count(text) <= size:
        return [text]
    if level >= len(levels):
        if not hard or len(text) < 2:
            return [text]
        k = len(text) // 2
        return [p for half in (text[:k], text[k:]) for p in recursive_split(half, count, size, levels, least, word_least, hard, level)]
    delimiters, include = levels[level]
    pieces = split_at_level(text, delimiters, include, least if delimiters is not None else word_least)
    if pieces == [text.strip()]:
        return recursive_split(text, count, size, levels, least, word_least, hard, level + 1)
    fine = []
    for p in pieces:
        fine += recursive_split(p, count, size, levels, least, word_least, hard, level + 1) if count(p) > size else [p]
    out, parts, total = [], [], 0
    for p in fine:
        n = count(p)
        if parts and total + n > size:
            out.append(" ".join(parts))
            parts, total = [], 0
        parts.append(p)
        total += n
    return out + ([" ".join(parts)] if parts else [])


def over_runs(blocks: list[Block], discarded: bool, split: Callable[[list[Block], Titles], list[Chunk]], blank: bool = False) -> list[Chunk]:
    """Titles and standalone blocks are chunks of their own; ``split`` gives those of the runs between."""
    out: list[Chunk] = []
    titles, run = Titles(), []
    for b in blocks:
        if b["kind"] == "discarded" and not discarded:
            continue
        if b["kind"] == "title" or b["kind"] in STANDALONE:
            out += split(run, titles) if run else []
            run = []
            if b["kind"] == "title":
                titles.enter(b)
            out.append(alone(b, titles))
        elif blank or (b["text"] or "").strip():
            run.append(b)
    return out + (split(run, titles) if run else [])


def pieces_to_chunks(pieces: list[str], run: list[Block], titles: Titles) -> list[Chunk]:
    """Chunks of pieces of a run's joined texts; a piece that isn't found in one piece has all blocks."""
    ends = list(accumulate(len(b["text"]) for b in run))
    text, out = "".join(b["text"] for b in run), []
    for p in pieces:
        if p.strip():
            a = text.find(p)
            mine = run if a < 0 else [b for b, e in zip(run, ends) if e > a and e - len(b["text"]) < a + len(p)]
            mine = mine or run[:1]
            out.append(new_chunk(p, "text", titles, mine, mine[0]["reading_order"]))
    return out


def recursive_chunks(blocks: list[Block], count: Callable[[str], int], size: int, levels, least: int, discarded: bool, hard: bool = False) -> list[Chunk]:
    def split(run: list[Block], titles: Titles) -> list[Chunk]:
        return pieces_to_chunks(recursive_split("".join(b["text"] for b in run), count, size, levels, least, hard=hard), run, titles)

    return over_runs(blocks, discarded, split)


def candidate_spans(text: str, count: Callable[[str], int], size: int, least: int) -> list[tuple[int, int]]:
    """True offsets of the pieces of at most ``size`` tokens, unmerged."""

    def pieces(t: str, level: int) -> list[str]:
        if not t.strip() or count(t) <= size or level >= len(RECURSIVE_LEVELS):
            return [t] if t.strip() else []
        delimiters, include = RECURSIVE_LEVELS[level]
        return [q for p in split_at_level(t, delimiters, include, least if delimiters is not None else 1) for q in ([p] if count(p) <= size else pieces(p, level + 1))]

    out, at = [], 0
    for p in pieces(text, 0):
        a = text.find(p.strip(), at)
        if a >= 0:
            out.append((a, a + len(p.strip())))
            at = out[-1][1]
    return out


def guided_chunks(blocks: list[Block], count: Callable[[str], int], choose: Callable[[list[str], int, int], int], size: int, candidate: int, least: int, discarded: bool, retries: int = 3) -> list[Chunk]:
    """``choose(passages, first, end)`` names the first passage of the next chunk, first < answer <= end.

    Passages are candidate spans, shown with their numbers, as many as fit into ``size`` tokens.
    An answer beyond the end is asked for again, ``retries`` times in all; then the whole group is a chunk."""

    def split(run: list[Block], titles: Titles) -> list[Chunk]:
        text = "".join(b["text"] for b in run)
        spans = candidate_spans(text, count, candidate, least)
        shown = [f"ID {i}: {text[a:z]}".replace("\n", " ") for i, (a, z) in enumerate(spans)]
        sums = list(accumulate((count(text[a:z]) for a, z in spans), initial=0))
        at, pieces = 0, []
        while at < len(spans):
            end = max(at + 1, min(bisect_left(sums, sums[at] + size) - 1, len(spans)))
            for _ in range(retries):
                cut = choose(shown[at:end], at, end)
                if cut <= end:
                    break
            else:
                cut = end
            cut = max(cut, at + 1)
            pieces.append(text[spans[at][0] : spans[cut - 1][1]])
            at = cut
        return pieces_to_chunks(pieces, run, titles)

    return over_runs(blocks, discarded, split)


def smoothed(sims: np.ndarray, window: int, order: int, derivative: int = 0) -> np.ndarray:
    """Savitzky-Golay; at the edges the polynomial of the first and last window is evaluated."""
    n = len(sims)
    w = min(window, n)
    w -= w % 2 == 0
    if w <= 1:
        return np.zeros(n) if derivative else sims.copy()
    rows = savitzky_golay(w, min(order, w - 1), derivative)
    h = w // 2
    out = np.convolve(sims, rows[h][::-1], mode="same")
    for i in range(h):
        out[i], out[n - 1 - i] = rows[i] @ sims[:w], rows[w - 1 - i] @ sims[n - w :]
    return out


@dataclass(frozen=True)
class SemanticRules:
    threshold_type: str = "percentile"
    threshold: float = 25.0
    skip_window: int = 0
    window: int = 3
    order: int = 2
    #: Cut at local minima only: where the fitted curve is level within this tolerance, and bends upwards.
    minima: float | None = None
    min_chars: int = 12
    delimiters: tuple[str, ...] = tuple(DELIMITERS)
    include_delim: str | None = "prev"
    discarded: bool = False


def _unit_cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def semantic_groups(vecs: np.ndarray, rules: SemanticRules) -> list[list[int]]:
    """Sentences by number in groups: cut where the smoothed similarity of neighbours is below the
    threshold; with skip_window, neighbouring groups of similar centroids are joined until none are."""
    n = len(vecs)
    norms = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = vecs / np.where(norms == 0, 1.0, norms)
    k = max(1, rules.skip_window)
    sims = [float(a @ b) for a, b in zip(unit, unit[1:])] if k == 1 else [max(float(unit[i] @ unit[j]) for j in range(i + 1, min(i + k, n - 1) + 1)) for i in range(n - 1)]
    sims = np.array(sims)
    level = np.round(smoothed(sims, rules.window, rules.order), 9)  # so that sums in another order give the same cuts
    bound = percentile(level, rules.threshold) if rules.threshold_type == "percentile" else rules.threshold
    cut = level < bound
    if rules.minima is not None:
        slope, curve = (np.round(smoothed(sims, rules.window, rules.order, k), 9) for k in (1, 2))
        cut = (np.abs(slope) < rules.minima) & (curve > 0) & (level <= bound)
    groups, begin = [], 0
    for i in np.flatnonzero(cut):
        groups.append(list(range(begin, i + 1)))
        begin = i + 1
    groups.append(list(range(begin, n)))
    if rules.skip_window > 0:
        least = 1 - rules.threshold / 100 if rules.threshold_type == "percentile" else rules.threshold
        changed = True
        while changed:
            changed, merged, i = False, [], 0
            while i < len(groups):
                if i + 1 < len(groups) and round(_unit_cosine(vecs[groups[i]].mean(axis=0), vecs[groups[i + 1]].mean(axis=0)), 9) >= least:
                    merged.append(groups[i] + groups[i + 1])
                    i, changed = i + 2, True
                else:
                    merged.append(groups[i])
                    i += 1
            groups = merged
    return groups


def semantic_chunks(blocks: list[Block], embed: Callable[[list[str]], list[list[float]]], rules: SemanticRules) -> list[Chunk]:
    def split(run: list[Block], titles: Titles) -> list[Chunk]:
        sentences = [Sentence(s, len(s) // 4, [b]) for b in run if (b["text"] or "").strip() for s in split_sentences_py(b["text"], list(rules.delimiters), rules.include_delim, rules.min_chars)]
        if not sentences:
            return []
        groups = [[0]] if len(sentences) == 1 else semantic_groups(np.asarray(embed([s.text for s in sentences]), float), rules)
        out = []
        for g in groups:
            mine = [sentences[i] for i in g]
            of = distinct_blocks(mine)
            c = new_chunk(" ".join(s.text for s in mine), "text", titles, of, min((b["reading_order"] for b in of if b["reading_order"] is not None), default=None))
            c["token_count"] = sum(s.tokens for s in mine)
            out.append(c)
        return out

    if rules.discarded:  # discarded blocks stand alone here
        out, titles_kept = [], [dict(b, kind="equation", _was="discarded") if b["kind"] == "discarded" else b for b in blocks]
        for c, was in ((c, {b["block_index"] for b in titles_kept if b.get("_was")}) for c in over_runs(titles_kept, False, split, blank=True)):
            if c["kind"] == "equation" and set(c["block_indices"]) & was:
                c["kind"] = "discarded"
            out.append(c)
        return out
    return over_runs(blocks, False, split, blank=True)


def multipass_chunks(base: list[Chunk], count: Callable[[str], int], base_name: str, levels: list[tuple[str, int]], links: bool) -> list[Chunk]:
    """The base chunks and, level by level, chunks that pack those of the level before.

    Titles and standalone chunks stay alone. Indices run on over the levels, links stay within one."""
    for i, c in enumerate(base):
        c.update(granularity=base_name, chunk_index=i, prev_chunk_index=i - 1 if i else None, next_chunk_index=i + 1 if i + 1 < len(base) else None)
        c["token_count"] = c["token_count"] or (count(c["page_content"]) if c["page_content"] else 0)
    every, children = list(base), base
    for name, most in levels:
        groups: list[list[Chunk]] = []
        total, open_ = 0, False
        for c in children:
            single = c["kind"] in STANDALONE or c["kind"] == "title"
            if single or not open_ or total + c["token_count"] > most:
                groups.append([])
                total = 0
            groups[-1].append(c)
            total += c["token_count"]
            open_ = not single
        offset, parents = len(every), []
        for k, g in enumerate(groups):
            extras: dict = {}
            for key in ("html", "img_path"):
                found = [c["extras"][key] for c in g if key in c["extras"]]
                if found:
                    extras[key] = found[0]
            for key in ("captions", "footnotes"):
                found = [x for c in g for x in c["extras"].get(key) or []]
                if found:
                    extras[key] = list(dict.fromkeys(found))
            content = "\n\n".join(c["page_content"] for c in g)
            parents.append({
                **g[0], "page_content": content, "kind": g[0]["kind"] if len(g) == 1 else "text", "extras": extras,
                "position_int": [p for c in g for p in c["position_int"]], "block_indices": list(dict.fromkeys(i for c in g for i in c["block_indices"])),
                "chunk_index": offset + k, "prev_chunk_index": offset + k - 1 if k else None, "next_chunk_index": offset + k + 1 if k + 1 < len(groups) else None,
                "token_count": count(content), "granularity": name,
            })
            if links:
                for c in g:
                    c["extras"] = {**c["extras"], "parent_chunk_index": offset + k}
        every += parents
        children = parents
    return every
