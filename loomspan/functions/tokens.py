"""Token counters: Column expressions where the count is one, Arrow UDFs for vocabularies and callables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import n_words


class InvalidTokenizerError(ValueError):
    """Nothing answers to a tokenizer's name; ``backend_errors`` says what each backend found."""

    def __init__(self, name: object, backend_errors: dict[str, str]):
        super().__init__(f"no tokenizer {name!r}: " + "; ".join(f"{k}: {v}" for k, v in backend_errors.items()))
        self.backend_errors = backend_errors


@dataclass(frozen=True)
class TokenCounter:
    """Counts tokens of a Column and of a Python string, alike."""

    name: str
    column: Callable[[Column], Column]
    count: Callable[[str], int]

    def count_batch(self, texts: list[str]) -> list[int]:
        return [self.count(t) for t in texts]


BUILT_IN = {
    "heuristic": TokenCounter("heuristic", lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int"), lambda s: max(1, len(s) // 4)),
    "quarter": TokenCounter("quarter", lambda c: F.floor(F.length(c) / 4).cast("int"), lambda s: len(s) // 4),
    "character": TokenCounter("character", F.length, len),
    "word": TokenCounter("word", lambda c: n_words(c).cast("int"), lambda s: len(s.split())),
    "byte": TokenCounter("byte", F.octet_length, lambda s: len(s.encode())),
}


def from_callable(count: Callable[[str], int], name: str = "callable") -> TokenCounter:
    def column(c: Column) -> Column:
        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            return texts.map(count, na_action="ignore").astype("Int32")

        return counted(c)

    return TokenCounter(name, column, count)


def resolve(tokenizer: object = None) -> TokenCounter:
    """A counter from None, a name, a counter, an object with count_tokens, or a callable.

    Names are those of BUILT_IN, the path of a tokenizers JSON file, a tiktoken encoding
    whose vocabulary is at hand, or a model that transformers has on disk.
    """
    if tokenizer is None:
        return BUILT_IN["heuristic"]
    if isinstance(tokenizer, TokenCounter):
        return tokenizer
    if isinstance(tokenizer, str):
        if tokenizer in BUILT_IN:
            return BUILT_IN[tokenizer]
        errors: dict[str, str] = {}
        for backend, load in (("tokenizers", _tokenizers), ("tiktoken", _tiktoken), ("transformers", _transformers)):
            try:
                return load(tokenizer)
            except Exception as e:  # noqa: BLE001
                errors[backend] = f"{type(e).__name__}: {e}"
        raise InvalidTokenizerError(tokenizer, errors)
    if callable(getattr(tokenizer, "count_tokens", None)):
        return from_callable(tokenizer.count_tokens, type(tokenizer).__name__)
    if callable(tokenizer):
        return from_callable(tokenizer)
    raise InvalidTokenizerError(tokenizer, {"object": "neither callable nor with count_tokens"})


def _tokenizers(path: str) -> TokenCounter:
    from tokenizers import Tokenizer

    Tokenizer.from_file(path)  # fails here rather than on the executors
    loaded: dict = {}

    def count(text: str) -> int:
        if path not in loaded:
            loaded[path] = Tokenizer.from_file(path)
        return len(loaded[path].encode(text, add_special_tokens=False).ids)

    return from_callable(count, path)


def _tiktoken(name: str) -> TokenCounter:
    import tiktoken

    tiktoken.get_encoding(name)

    def count(text: str) -> int:
        return len(tiktoken.get_encoding(name).encode_ordinary(text))

    return from_callable(count, name)


def _transformers(name: str) -> TokenCounter:
    from transformers import AutoTokenizer

    AutoTokenizer.from_pretrained(name, local_files_only=True)
    loaded: dict = {}

    def count(text: str) -> int:
        if name not in loaded:
            loaded[name] = AutoTokenizer.from_pretrained(name, local_files_only=True)
        return len(loaded[name].encode(text, add_special_tokens=False))

    return from_callable(count, name)
