"""HTML extraction: the page's structure first, and a host's repeated token runs where it is silent."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: A run of this many tokens is long; a shorter block counts as a whole, if it is loose.
RUN = 8
#: A run is boilerplate if it is in this many distinct page contents of a host and this share of them.
PAGES_LEAST, PAGES_SHARE = 3, 0.02
#: Page contents of a host in one suffix array. Those of larger hosts are worked through in parts of
#: about this size; what is boilerplate is decided for the host.
SHARD = 2000
#: How far up an element is looked for that a start tag closes.
DEPTH = 512

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "title", "textarea", "select"}
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text of the page: a short block in one of them is loose only if it is all links.
TEXTUAL = {"p", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre", "summary", "address"}
WORDS_DROPPED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
#: Parts of names that may stand beside those above: "post-comments" is dropped, "related-work" isn't.
WORDS_BESIDE = {"", "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "entry", "footer", "form", "global", "grid", "header", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "module", "outer", "page", "pages", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "title", "top", "ui", "unit", "wrap", "wrapper"}
ROLES_DROPPED = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Elements that a start tag of the key closes, up to the nearest element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"</?([^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")


def _kind(name: str, attrs: str) -> str:
    """'drop', 'header', 'main', 'article' or ''."""
    kind = "drop" if name in DROPPED else name if name in ("header", "article", "main") else ""
    if kind != "drop" and attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "itemprop" in attrs or "CLASS" in attrs or "ID" in attrs):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                kind = "drop" if value in ROLES_DROPPED else "main" if value == "main" else kind
            elif key in ("class", "id") and name not in ("body", "html", "article", "main"):
                for token in value.split():
                    parts = {x for x in _PARTS.split(token) if not x.isdigit()}
                    if parts <= WORDS_DROPPED | WORDS_BESIDE:
                        kind = "drop" if parts & WORDS_DROPPED else "header" if "header" in parts and kind != "drop" else kind
            elif key in ("class", "id") and name == "article":
                kind = "drop" if set(_PARTS.split(value)) & {"comment", "comments", "reply", "ad", "advert", "related"} else kind
            elif key == "itemprop" and value == "articlebody":
                kind = "article"
            if kind == "drop":
                break
    return kind


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(from, to, name, is an end tag, attributes) of the tags in order; name '' for comments and the like.

    A '>' within quotes doesn't end a tag, until a tag turns out to have a quote that isn't closed
    or no end outside quotes: from there on every '>' ends one. So a page is read once or twice.
    """
    at, n, quotes = 0, len(page), True
    while True:
        m = _OPEN.search(page, at)
        if not m:
            return
        a = m.start()
        if page.startswith("<!--", a):
            z = page.find("-->", a + 4)
            z = n if z < 0 else z + 3
            at = yield a, z, "", False, ""
        else:
            z = page.find(">", a)
            if page[a + 1] in "!?":
                z = n if z < 0 else z + 1
                at = yield a, z, "", False, ""
            elif z < 0:  # no tag ends any more: the rest is text
                return
            else:
                name = _NAME.match(page, a)
                end = _QUOTED.match(page, name.end()) if quotes else None
                quotes = quotes and end is not None
                z = end.end() if end else page.find(">", name.end()) + 1
                at = yield a, z, name[1].lower(), page[a + 1] == "/", page[name.end() : z - 1]
        at = z if at is None else at


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(rank, text) of the visible blocks that aren't marked as something else."""
    return [b[:2] for b in loose_blocks(page) if not b[3]]


def loose_blocks(page: str) -> list[tuple[int, str, bool, bool]]:
    """(rank, text, loose, marked) of the blocks in page order: rank 2 in an article, 1 in the main
    element, 0 elsewhere. Marked is what menus, footers, adverts and their like hold; of a
    header inside an article the headings are not. Loose are blocks that are neither headings nor
    in a textual element, and blocks other than headings that are all links.

    Takes time in proportion to the page: an open element is looked for no further up than DEPTH.
    """
    out: list[tuple[int, str, bool, bool]] = []
    stack: list[tuple[str, bool, int, bool, str]] = []  # name, dropped, rank, in a header, innermost block
    count: Counter = Counter()  # of the names in the stack
    run: list[str] = []
    dropped, rank, header, inner = False, 0, False, ""
    heading, plain, off = False, False, False

    def close() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            out.append((rank, text, inner not in HEADINGS and not (plain and inner in TEXTUAL), off))
        run.clear()
        plain = False

    def back(size: int) -> None:
        nonlocal dropped, rank, header, inner
        for x in stack[size:]:
            count[x[0]] -= 1
        del stack[size:]
        dropped, rank, header, inner = stack[-1][1:] if stack else (False, 0, False, "")

    def end_open(ends: set[str], stops: set[str]) -> None:
        if any(count[x] for x in ends):
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if stack[i][0] in ends:
                    back(i)
                    return
                if stack[i][0] in stops:
                    return

    def put(text: str) -> None:
        nonlocal plain, off
        if text:
            now = dropped or (header and not heading)
            if now != off:
                close()
                off = now
            run.append(text)
            plain = plain or (not count["a"] and not text.isspace())

    at, tags = 0, _tags(page)
    tag = next(tags, None)
    while tag:
        a, z, name, ends_one, attrs = tag
        put(page[at:a])
        at = z
        if name == "br":
            put(" ")
        elif name:
            if name in BLOCKS:
                close()
            if name in HEADINGS:
                heading = not ends_one
            if ends_one:
                if count[name]:
                    back(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            elif name not in VOID:
                if name in BLOCKS:
                    end_open({"p"}, BLOCKS)  # a block ends an open paragraph
                if name in CLOSES:
                    end_open(*CLOSES[name])
                if not attrs.rstrip().endswith("/") or name in BLOCKS:
                    kind = _kind(name, attrs)
                    dropped = dropped or kind == "drop" or (kind == "header" and rank == 0)
                    header = header or kind == "header"
                    rank = 2 if kind == "article" else max(rank, 1) if kind == "main" else rank
                    inner = name if name in BLOCKS else inner
                    stack.append((name, dropped, rank, header, inner))
                    count[name] += 1
        try:
            tag = tags.send(at)
        except StopIteration:
            tag = None
    put(page[at:])
    close()
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, sure, rest, loose, marked = [], [], [], [], []
        for page in b.column("html"):
            found = loose_blocks(page.as_py() or "")
            ours = [(r, t, x) for r, t, x, off in found if not off]
            best = max((r for r, _, _ in ours), default=2)
            texts.append("\n".join(t for r, t, _ in ours if r) if best else None)
            sure.append(best > 0)
            rest.append([t for r, t, _ in ours if r == 0])
            loose.append([x for r, _, x in ours if r == 0])
            marked.append([t for r, t, _, off in found if off])
        cols = [b.column(c) for c in ("page_id", "url", "host")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(sure, pa.bool_()), pa.array(rest, pa.list_(pa.string())), pa.array(loose, pa.list_(pa.bool_())), pa.array(marked, pa.list_(pa.string()))], ["page_id", "url", "host", "text", "sure", "rest", "loose", "marked"])


def depth_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of ``ids`` in their order by the first ``depth`` tokens (a power of
    two): the suffix array's order by prefix doubling, stopped at the depth that is asked for.

    Deeper order isn't needed: a token is in a substring of at least ``depth`` tokens that is on
    so many pages exactly if it is in one of ``depth`` tokens that is."""
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while k < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def occurrences(blocks: list[str], pages: list[np.ndarray], loose: list[bool], run: int = RUN) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, int]]:
    """(text, pages, blocks, places, tokens) of every loose short block and of every run of ``run`` tokens:
    on how many pages it is, and in which blocks at which token. pages: on which pages a block is."""
    toks = [b.split() for b in blocks]
    size = np.array([len(t) for t in toks], np.int64)
    names = {t: i for i, t in enumerate(dict.fromkeys(x for t in toks for x in t))}
    for i in np.flatnonzero(size < run):
        if loose[i]:
            yield " ".join(toks[i]), len(pages[i]), np.array([i]), np.array([0]), int(size[i])
    long = np.flatnonzero(size >= run)
    if not len(long):
        return
    stream, owner, place = [], [], []
    for i in long:
        stream += [names[t] for t in toks[i]] + [len(names) + int(i)]  # each block ends in a token of its own
        owner += [i] * (size[i] + 1)
        place += range(size[i] + 1)
    owner, place = np.array(owner), np.array(place)
    rank = depth_ranks(np.array(stream), run)
    whole = place + run <= size[owner]
    order = np.argsort(rank[whole], kind="stable")
    r, o, p = rank[whole][order], owner[whole][order], place[whole][order]
    edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
    for a, z in zip(edge[:-1], edge[1:]):
        at = np.unique(o[a:z])
        n = len(pages[at[0]]) if len(at) == 1 else len(np.unique(np.concatenate([pages[i] for i in at])))
        yield " ".join(toks[o[a]][p[a] : p[a] + run]), n, o[a:z], p[a:z], run


def repeated(blocks: list[str], pages: list[np.ndarray], n_pages: int, least: float, run: int = RUN, loose: list[bool] | None = None, known: set[str] | None = None) -> list[np.ndarray]:
    """For every distinct block the tokens covered by boilerplate: what is on ``least`` pages, or what is ``known``."""
    covered = [np.zeros(len(b.split()), bool) for b in blocks]
    for text, n, o, p, size in occurrences(blocks, pages, loose or [True] * len(blocks), run):
        if n >= least if known is None else text in known:
            for i, q in zip(o, p):
                covered[i][q : q + size] = True
    return covered


def _least(pdf: pd.DataFrame) -> float:
    return max(PAGES_LEAST, PAGES_SHARE * int(pdf["n"].iloc[0]))


def _indexed(pdf: pd.DataFrame) -> tuple[dict[tuple[str, bool], int], list[np.ndarray]]:
    index: dict[tuple[str, bool], int] = {}
    pages: list[list[int]] = []
    for k, (rest, loose, marked) in enumerate(zip(pdf["rest"], pdf["loose"], pdf["marked"])):
        for b in dict.fromkeys([*zip(rest, map(bool, loose)), *((t, True) for t in marked), *((t, False) for t in marked)]):
            i = index.setdefault(b, len(index))
            if i == len(pages):
                pages.append([])
            pages[i].append(k)
    return index, [np.array(p) for p in pages]


def _cleaned(pdf: pd.DataFrame, known: set[str] | None = None) -> pd.DataFrame:
    """Contents of a host, or with its known boilerplate of a part of it -> the texts of the unsure ones."""
    index, pages = _indexed(pdf)
    covered = repeated([b for b, _ in index], pages, len(pdf), _least(pdf), loose=[x for _, x in index], known=known)
    out = []
    for row in pdf[~pdf["sure"]].itertuples():
        kept = []
        for t, x in zip(row.rest, row.loose):
            c, words = covered[index[t, bool(x)]], t.split(" ")
            if not c.any():
                kept.append(t)
            elif not c.all():
                kept.append(" ".join(w for w, gone in zip(words, c) if not gone))
        out.append((row.host, row.c1, row.c2, "\n".join(kept)))
    return pd.DataFrame(out, columns=["host", "c1", "c2", "text"])


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    return _cleaned(pdf)


def _proposed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part: what could be boilerplate of the host, which some part must hold in its share of the threshold."""
    index, pages = _indexed(pdf)
    least = _least(pdf) / int(pdf["parts"].iloc[0])
    found = {x[0] for x in occurrences([b for b, _ in index], pages, [x for _, x in index]) if x[1] >= least}
    return pd.DataFrame({"host": [pdf["host"].iloc[0]] * len(found), "run": list(found)})


def _counted(pdf: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Of one part: in how many contents each proposed run is."""
    if not len(pdf) or not len(runs):
        return pd.DataFrame({"host": [], "run": [], "n": []})
    index, pages = _indexed(pdf)
    wanted = set(runs["run"])
    found = [(pdf["host"].iloc[0], x[0], x[1]) for x in occurrences([b for b, _ in index], pages, [x for _, x in index]) if x[0] in wanted]
    return pd.DataFrame(found, columns=["host", "run", "n"])


def _part(pdf: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    return _cleaned(pdf, set(runs["run"])) if len(pdf) else pd.DataFrame({"host": [], "c1": [], "c2": [], "text": []})


def _in_parts(contents: DataFrame) -> DataFrame:
    """(host, c1, c2, text) of hosts that are worked through in parts, decided by counts over all parts."""
    key = ["host", "part"]
    sizes = written(contents.select("host", "n", "parts").distinct(), "html-large")

    def everywhere(runs: DataFrame) -> DataFrame:
        return runs.join(sizes, "host").select("host", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    proposed = written(contents.groupBy(*key).applyInPandas(_proposed, "host string, run string").distinct(), "html-proposed")
    counts = contents.groupBy(*key).cogroup(everywhere(proposed).groupBy(*key)).applyInPandas(_counted, "host string, run string, n long")
    counts = counts.groupBy("host", "run").agg(F.sum("n").alias("on")).join(sizes, "host")
    runs = written(counts.filter(F.col("on") >= F.greatest(F.lit(float(PAGES_LEAST)), PAGES_SHARE * F.col("n"))).select("host", "run"), "html-runs")
    return contents.groupBy(*key).cogroup(everywhere(runs).groupBy(*key)).applyInPandas(_part, "host string, c1 long, c2 long, text string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars; one row per row.

    Pages with articles or a main element give their blocks whole: repetition doesn't
    count against them, since copies of an article are articles. On other pages all blocks
    outside menus and the like are in question. There, the tokens of all blocks outside articles of
    all of a host's pages, menus and the like included, are ordered in one suffix array (to the depth of RUN tokens), and runs that
    stand in enough distinct page contents are boilerplate; what they cover goes, and the rest of
    the page stays. Copies of a page count once. Short blocks go only if they are loose (see
    loose_blocks): headings and short paragraphs or items of text stay, however often they occur.
    So what one page has in a footer is found on a page that doesn't mark it. Large hosts are worked through
    in parts, whose counts are added up before anything is decided.

    A null or empty html gives an empty text. A null url is the host ''. Equal rows give equal
    rows. White space is Unicode's; <br> is white space.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:[Ww]{3}\.)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    parsed = written(rows.mapInArrow(_parsed, "page_id long, url string, host string, text string, sure boolean, rest array<string>, loose array<boolean>, marked array<string>"), "html-parsed")
    parsed = parsed.withColumns({"c1": F.xxhash64("text", "rest", "loose", "marked"), "c2": F.xxhash64(F.lit(7), "marked", "rest", "loose", "text")})
    sure = parsed.filter("sure").select("page_id", "url", "text")
    open_ = parsed.filter("not sure and size(rest) > 0").select("host").distinct()
    contents = parsed.filter("size(rest) + size(marked) > 0").join(open_, "host", "left_semi").select("host", "c1", "c2", "sure", "rest", "loose", "marked").dropDuplicates(["host", "c1", "c2"])
    contents = written(contents, "html-contents")
    size = written(contents.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / SHARD)), "html-hosts")
    contents = contents.join(size, "host").withColumn("part", F.pmod(F.col("c1"), F.col("parts")))
    found = contents.filter("parts = 1").groupBy("host").applyInPandas(_whole, "host string, c1 long, c2 long, text string")
    if size.filter("parts > 1").limit(1).count():
        found = found.unionByName(_in_parts(contents.filter("parts > 1")))
    found = parsed.filter("not sure and size(rest) > 0").select("page_id", "url", "host", "c1", "c2").join(found, ["host", "c1", "c2"]).select("page_id", "url", "text")
    empty = parsed.filter("not sure and size(rest) = 0").select("page_id", "url", F.lit("").alias("text"))
    return sure.unionByName(found).unionByName(empty).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
