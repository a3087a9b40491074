"""What a user may bring: bases of fetchers, parsers, chunkers, refineries, sinks, tokenizers, embedders and models.

All work on DataFrames, so a batch is a union of frames and one plan.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("a batch needs at least one frame")
    return reduce(DataFrame.unionByName, frames)


class Fetcher(ABC):
    """Where documents come from: rows of schema.FETCHED."""

    @abstractmethod
    def fetch(self, spark: SparkSession, path: str | None = None, folder: str | None = None, **options: object) -> DataFrame: ...

    def fetch_named(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} doesn't fetch by name")

    def __call__(self, spark: SparkSession, *args: object, **options: object) -> DataFrame:
        return self.fetch(spark, *args, **options)


class Parser(ABC):
    """Fetched documents to blocks."""

    @abstractmethod
    def process(self, docs: DataFrame) -> DataFrame: ...

    def process_batch(self, frames: list[DataFrame]) -> DataFrame:
        return self.process(union(frames))

    def __call__(self, docs: DataFrame) -> DataFrame:
        return self.process(docs)


class Chunker(ABC):
    """Blocks to chunks."""

    @abstractmethod
    def __call__(self, blocks: DataFrame) -> DataFrame: ...

    def chunk(self, blocks: DataFrame, source: str | None = None) -> DataFrame:
        """The chunks of blocks, which all become those of ``source`` if it is given."""
        return self(blocks if source is None else blocks.withColumn("source", F.lit(source)))

    def chunk_batch(self, frames: list[DataFrame], sources: list[str]) -> DataFrame:
        """The chunks of several documents by one plan."""
        if len(frames) != len(sources):
            raise ValueError(f"{len(frames)} frames of blocks, but {len(sources)} sources")
        return self(union([b.withColumn("source", F.lit(s)) for b, s in zip(frames, sources)]))


class PerDocument(Chunker):
    """A function of one document's blocks, as dicts in order, that gives its chunks as dicts."""

    def __init__(self, fn: Callable[[list[dict]], list[dict]]):
        self.fn = fn

    def __call__(self, blocks: DataFrame) -> DataFrame:
        from loomspan.operators.folds import Titles, fold, new_chunk

        fn = self.fn

        def whole(chunk: dict) -> dict:
            empty = new_chunk("", "text", Titles(), [], None)
            wrong = set(chunk) - set(empty)
            if wrong:
                raise ValueError(f"not fields of a chunk: {', '.join(sorted(wrong))}")
            return empty | chunk

        return fold(blocks, lambda b: [whole(c) for c in fn(b)])


class Refinery(ABC):
    """Chunks to chunks that say more."""

    @abstractmethod
    def enrich(self, chunks: DataFrame) -> DataFrame: ...

    def enrich_batch(self, frames: list[DataFrame]) -> DataFrame:
        return self.enrich(union(frames))

    def __call__(self, chunks: DataFrame) -> DataFrame:
        return self.enrich(chunks)


class Sink(ABC):
    """Chunks to records, or to files of a target."""

    @abstractmethod
    def export(self, chunks: DataFrame, target: str | None = None) -> DataFrame | None: ...

    def export_batch(self, frames: list[DataFrame], target: str | None = None) -> DataFrame | None:
        return self.export(union(frames), target)

    def __call__(self, chunks: DataFrame, target: str | None = None) -> DataFrame | None:
        return self.export(chunks, target)


class Tokenizer(ABC):
    @abstractmethod
    def count_tokens(self, text: str) -> int: ...

    def count_tokens_batch(self, texts: list[str]) -> list[int]:
        return [self.count_tokens(t) for t in texts]


class Embedder(ABC):
    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Model(ABC):
    """A language model. What it can't do raises NotImplementedError."""

    @abstractmethod
    def generate(self, prompt: str) -> str: ...

    def generate_batch(self, prompts: list[str]) -> list[str]:
        return [self.generate(p) for p in prompts]

    async def generate_async(self, prompt: str) -> str:
        import asyncio

        return await asyncio.to_thread(self.generate, prompt)

    def generate_contextual(self, context: str, prompt: str) -> str:
        return self.generate(context + prompt)

    def generate_json(self, prompt: str) -> object:
        raise NotImplementedError(f"{type(self).__name__} doesn't answer in JSON")

    def generate_vision(self, prompt: str, image: str) -> str:
        raise NotImplementedError(f"{type(self).__name__} doesn't see")
