"""Chunkers: blocks -> chunks. Configurations are checked when made; plans are lazy.

By block, page, section and fixed size are built of windows and aggregates. The others fold
over each document in order (``folds``): one shuffle by source, a sort within partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import tokens, vectors
from loomspan.interfaces import Chunker
from loomspan.operators import folds
from loomspan.operators.context import ORDER, extras, in_order, no_extras, page_content, position, with_breadcrumb, with_links, with_section
from loomspan.schema import CHUNK, STANDALONE


def check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def as_chunks(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a chunk, in order; what is missing is empty."""
    empty: dict[str, Column] = {"extras": no_extras(), "token_count": F.lit(0), "granularity": F.lit("")}
    empty |= {c: F.lit("") for c in ("content_hash", "doc_summary", "chunk_context")}
    return df.select([(F.col(f.name) if f.name in df.columns else empty[f.name]).cast(f.dataType).alias(f.name) for f in CHUNK])


class Folding(Chunker):
    """A chunker that folds over each document in order."""

    include_discarded: bool

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        raise NotImplementedError

    def __call__(self, blocks: DataFrame) -> DataFrame:
        return folds.fold(kept(blocks, self.include_discarded), self.folding())


def kept(blocks: DataFrame, discarded: bool) -> DataFrame:
    return blocks if discarded else blocks.filter("kind <> 'discarded'")


@dataclass(frozen=True)
class ByBlock(Chunker):
    """Every block is a chunk of its own kind."""

    include_discarded: bool = False

    def __call__(self, blocks: DataFrame) -> DataFrame:
        d = with_breadcrumb(kept(blocks, self.include_discarded))
        d = d.select("source", "kind", "title_path", "title_level", "reading_order", "block_index", page_content().alias("page_content"), extras().alias("extras"), position().alias("position_int"), F.array("block_index").alias("block_indices"))
        return as_chunks(with_links(d, *ORDER))


@dataclass(frozen=True)
class ByPage(Chunker):
    """All text of a page is a chunk, under the breadcrumb of its first block."""

    include_discarded: bool = False
    separator: str = "\n"

    def __call__(self, blocks: DataFrame) -> DataFrame:
        d = with_breadcrumb(kept(blocks, self.include_discarded))
        return _grouped(d, "page_idx", self.separator)


@dataclass(frozen=True)
class BySection(Chunker):
    """A title and all that follows it up to the next title is a chunk."""

    include_discarded: bool = False
    separator: str = "\n\n"

    def __call__(self, blocks: DataFrame) -> DataFrame:
        d = with_breadcrumb(kept(blocks, self.include_discarded))
        d = d.withColumn("_section", F.sum((F.col("kind") == "title").cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
        return _grouped(d, "_section", self.separator)


def _grouped(d: DataFrame, key: str, separator: str) -> DataFrame:
    row = F.struct(*ORDER, page_content().alias("content"), position().alias("position"), F.col("block_index").alias("i"), "title_path", "title_level", "kind")
    g = d.groupBy("source", key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    g = g.select(
        "source", first["reading_order"].alias("reading_order"), first["title_path"].alias("title_path"), first["title_level"].alias("title_level"),
        F.when(F.size("rows") == 1, first["kind"]).otherwise("text").alias("kind"),
        F.array_join(F.filter(F.transform("rows", lambda r: r["content"]), lambda c: c != ""), separator).alias("page_content"),
        F.flatten(F.transform("rows", lambda r: r["position"])).alias("position_int"),
        F.transform("rows", lambda r: r["i"]).alias("block_indices"), first["i"].alias("block_index"),
    )
    return as_chunks(with_links(g, *ORDER))


@dataclass(frozen=True)
class FixedSize(Chunker):
    """Runs of text between titles and standalone blocks are cut into windows of ``size`` characters
    that overlap by ``overlap``; titles and standalone blocks stay whole."""

    size: int = 1000
    overlap: int = 0
    include_discarded: bool = False

    def __post_init__(self):
        check(self.size > 0, "size must be positive")
        check(0 <= self.overlap < self.size, "overlap must be at least 0 and below size")

    def __call__(self, blocks: DataFrame) -> DataFrame:
        d = with_section(with_breadcrumb(kept(blocks, self.include_discarded)))
        whole = F.col("kind").isin("title", *STANDALONE)
        row = F.struct(*ORDER, F.when(whole, page_content()).otherwise(F.col("text")).alias("content"), position().alias("position"), F.col("block_index").alias("i"), "title_path", "title_level", "kind")
        g = d.withColumn("_whole", whole).groupBy("source", "section_id", "_whole").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.first(extras()).alias("_extras"))
        text = F.array_join(F.transform("rows", lambda r: r["content"]), "\n")
        g = g.withColumn("_text", text)
        step = self.size - self.overlap
        starts = F.when(F.col("_whole"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.length("_text") - 1 - self.overlap, F.lit(0)), F.lit(step)))
        g = g.select("*", F.posexplode(starts).alias("_k", "_at"))
        first = F.get("rows", F.lit(0))
        g = g.select(
            "source", "section_id", "_whole", "_k", first["title_path"].alias("title_path"), first["title_level"].alias("title_level"), first["reading_order"].alias("reading_order"),
            F.when(F.col("_whole"), first["kind"]).otherwise("text").alias("kind"), F.when(F.col("_whole"), F.col("_extras")).otherwise(no_extras()).alias("extras"),
            F.when(F.col("_whole"), F.col("_text")).otherwise(F.substring("_text", F.col("_at") + 1, F.lit(self.size))).alias("page_content"),
            F.flatten(F.transform("rows", lambda r: r["position"])).alias("position_int"), F.transform("rows", lambda r: r["i"]).alias("block_indices"),
        )
        return as_chunks(with_links(g.withColumn("_last", ~F.col("_whole")), "section_id", "_last", "_k"))


@dataclass(frozen=True)
class ByToken(Folding):
    max_tokens: int = 512
    overlap_tokens: int = 64
    tokenizer: object = None
    include_discarded: bool = False

    def __post_init__(self):
        check(self.max_tokens > 0, "max_tokens must be positive")
        check(0 <= self.overlap_tokens < self.max_tokens, "overlap_tokens must be at least 0 and below max_tokens")

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        count, most, overlap, discarded = tokens.resolve(self.tokenizer).count, self.max_tokens, self.overlap_tokens, self.include_discarded
        return lambda b: folds.token_chunks(b, count, most, overlap, discarded)


@dataclass(frozen=True)
class BySentence(Folding):
    chunk_size: int = 512
    chunk_overlap: int = 128
    reserved_tokens: int = 0
    min_sentences: int = 1
    min_chars: int = 12
    delimiters: tuple[str, ...] = tuple(folds.DELIMITERS)
    include_delim: str | None = "prev"
    tokenizer: object = None
    include_discarded: bool = False
    compat: bool = False

    def __post_init__(self):
        check(self.chunk_size > 0, "chunk_size must be positive")
        check(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be at least 0 and below chunk_size")
        check(self.reserved_tokens >= 0, "reserved_tokens must not be negative")
        check(self.min_sentences >= 1 and self.min_chars >= 1, "min_sentences and min_chars must be at least 1")
        check(self.include_delim in ("prev", "next", None), "include_delim must be 'prev', 'next' or None")

    def rules(self) -> folds.SentenceRules:
        return folds.SentenceRules(self.chunk_size, self.chunk_overlap, self.reserved_tokens, self.min_sentences, self.min_chars, tuple(self.delimiters), self.include_delim, self.include_discarded, self.compat)

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        count, rules = tokens.resolve(self.tokenizer).count, self.rules()
        return lambda b: folds.sentence_chunks(b, count, rules)


@dataclass(frozen=True)
class Recursive(Folding):
    chunk_size: int = 512
    min_chars: int = 24
    levels: tuple = folds.RECURSIVE_LEVELS
    tokenizer: object = None
    include_discarded: bool = False
    hard_split: bool = False

    def __post_init__(self):
        check(self.chunk_size > 0, "chunk_size must be positive")
        check(self.min_chars >= 1, "min_chars must be at least 1")

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        count, me = tokens.resolve(self.tokenizer).count, self
        return lambda b: folds.recursive_chunks(b, count, me.chunk_size, me.levels, me.min_chars, me.include_discarded, me.hard_split)


@dataclass(frozen=True)
class Semantic(Folding):
    embedder: object = None
    threshold_type: str = "percentile"
    threshold: float = 25.0
    skip_window: int = 0
    smooth_window: int = 3
    smooth_order: int = 2
    min_chars: int = 12
    include_discarded: bool = False
    minima: float | None = None

    def __post_init__(self):
        check(self.threshold_type in ("percentile", "threshold"), "threshold_type must be 'percentile' or 'threshold'")
        check(0 <= self.threshold <= 100, "threshold must lie in [0, 100]")
        check(self.skip_window >= 0, "skip_window must not be negative")
        check(self.smooth_window >= 1, "smooth_window must be at least 1")

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        embed = vectors.resolve_embedder(self.embedder)
        rules = folds.SemanticRules(self.threshold_type, self.threshold, self.skip_window, self.smooth_window, self.smooth_order, self.minima, self.min_chars, discarded=self.include_discarded)
        return lambda b: folds.semantic_chunks(b, embed, rules)


def halfway(passages: list[str], first: int, end: int) -> int:
    """A stand-in for a model: a group ends before its longest passage after the first, else at its end."""
    if end - first < 3:
        return end
    return first + max(range(1, len(passages)), key=lambda i: len(passages[i]))


@dataclass(frozen=True)
class Guided(Folding):
    """A model names where chunks end; ``choose`` gets numbered passages and their range."""

    choose: Callable[[list[str], int, int], int] = halfway
    chunk_size: int = 512
    candidate_size: int = 128
    min_chars: int = 24
    max_retries: int = 3
    tokenizer: object = None
    include_discarded: bool = False

    def __post_init__(self):
        check(self.chunk_size > 0, "chunk_size must be positive")
        check(0 < self.candidate_size <= self.chunk_size, "candidate_size must be positive and at most chunk_size")
        check(self.min_chars >= 1 and self.max_retries >= 1, "min_chars and max_retries must be at least 1")

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        count, me = tokens.resolve(self.tokenizer).count, self
        return lambda b: folds.guided_chunks(b, count, me.choose, me.chunk_size, me.candidate_size, me.min_chars, me.include_discarded, me.max_retries)


@dataclass(frozen=True)
class Multipass(Folding):
    """Sentence chunks, and coarser levels that pack the chunks of the level before."""

    base: BySentence = BySentence(chunk_size=150, chunk_overlap=0)
    base_name: str = "mini"
    levels: tuple[tuple[str, int], ...] = (("normal", 512), ("large", 2048))
    parent_links: bool = True
    tokenizer: object = None

    @property
    def include_discarded(self) -> bool:
        return self.base.include_discarded

    def folding(self) -> Callable[[list[folds.Block]], list[folds.Chunk]]:
        me, rules = self, self.base.rules()
        count, own = tokens.resolve(self.tokenizer).count, tokens.resolve(self.base.tokenizer).count
        return lambda b: folds.multipass_chunks(folds.sentence_chunks(b, own, rules), count, me.base_name, list(me.levels), me.parent_links)


STRATEGIES: dict[str, type] = {
    "by_block": ByBlock, "by_page": ByPage, "by_section": BySection, "fixed_size": FixedSize, "by_token": ByToken, "by_sentence": BySentence,
    "by_recursive": Recursive, "recursive": Recursive, "by_semantic": Semantic, "semantic": Semantic, "by_slumber": Guided, "slumber": Guided, "guided": Guided, "multipass": Multipass,
}


def chunker(strategy: str | Chunker, **options: object) -> Chunker:
    """The chunker of a strategy; options that it doesn't know are an error. A chunker is taken as it is."""
    if isinstance(strategy, Chunker):
        check(not options, "options go to a chunker when it is made")
        return strategy
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](**options)


def numbers(blocks: DataFrame, by: dict[str, Chunker]) -> DataFrame:
    """(strategy, source, chunk_index): all chunks by several chunkers, under their names; those that fold share one pass."""
    out = [c(blocks).select(F.lit(name).alias("strategy"), "source", "chunk_index") for name, c in by.items() if not isinstance(c, Folding)]
    for discarded in (False, True):
        fns = {name: c.folding() for name, c in by.items() if isinstance(c, Folding) and c.include_discarded == discarded}
        if fns:
            out.append(folds.fold_numbers(kept(blocks, discarded), fns))
    return reduce(DataFrame.unionByName, out)
