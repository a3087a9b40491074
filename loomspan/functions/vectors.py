"""Vector expressions on array<double> columns, and embedders."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidEmbedderError(ValueError):
    """An object that can't embed texts."""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


@lru_cache(256)
def savitzky_golay(window: int, order: int, derivative: int = 0) -> np.ndarray:
    """Row i: the weights that give the value, or a derivative, at place i of a window from the polynomial of the
    given order that fits the window best. The middle row smooths, the others serve the edges."""
    x = np.arange(window) - window // 2
    powers = np.vander(x, order + 1, increasing=True).astype(float)
    at = np.zeros_like(powers)
    for j in range(derivative, order + 1):
        at[:, j] = np.prod(np.arange(j - derivative + 1, j + 1), initial=1.0) * powers[:, j - derivative]
    out = at @ np.linalg.pinv(powers)
    out.flags.writeable = False
    return out


def hashed(text: str, size: int = 64) -> list[float]:
    """A deterministic bag-of-words embedding: each word adds to the places its hash names."""
    v = [0.0] * size
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % size] += 1.0
        v[(h >> 16) % size] += -1.0 if h & 0x8000 else 1.0
    return v


def percentile(values: np.ndarray, q: float) -> float:
    """np.percentile of one dimension, to the last bit, without what that takes for each short run."""
    x = np.sort(values).tolist()
    at = (len(x) - 1) * (q / 100)
    i = int(at)
    t, a, b = at - i, x[i], x[min(i + 1, len(x) - 1)]
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def resolve_embedder(embedder: object = None) -> Callable[[list[str]], list[list[float]]]:
    """texts -> vectors, from None (hashed words), an object with embed_batch, or a callable on lists.

    A string names a sentence-transformers model, which must be installed."""
    if embedder is None:
        return lambda texts: [hashed(t) for t in texts]
    if isinstance(embedder, str):
        try:
            import sentence_transformers  # noqa: F401
        except ImportError as e:
            raise InvalidEmbedderError(f"{embedder!r} needs sentence-transformers: {e}") from e
        loaded: dict = {}

        def embed(texts: list[str]) -> list[list[float]]:
            from sentence_transformers import SentenceTransformer

            if not loaded:
                loaded["model"] = SentenceTransformer(embedder)
            return np.asarray(loaded["model"].encode(texts), float).tolist()

        return embed
    if callable(getattr(embedder, "embed_batch", None)):
        return lambda texts: [list(map(float, v)) for v in embedder.embed_batch(texts)]
    if callable(embedder):
        return lambda texts: [list(map(float, v)) for v in embedder(texts)]
    raise InvalidEmbedderError(f"can't embed with {embedder!r}")


def embedding(text: Column, embedder: object = None) -> Column:
    """array<double>; one call of the embedder for each Arrow batch."""
    embed = resolve_embedder(embedder)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return run(text)
