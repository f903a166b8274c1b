"""Places for real models: each is loaded once in a worker process, at its first use, and sees batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict[str, Any] = {}


def once_a_worker(name: str, load: Callable[[], Any]) -> Any:
    """What ``load`` gives, kept for the life of the process under a name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def with_key(variable: str, make: Callable[[str], Any]) -> Callable[[], Any]:
    """A loader of a client that needs a key from the environment; RuntimeError where there is none."""

    def load() -> Any:
        key = os.environ.get(variable)
        if not key:
            raise RuntimeError(f"no key in the environment variable {variable}")
        return make(key)

    return load


def embedder(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """An embedder for ``vectors.embed`` and chunking."""

    def embed(texts: list[str]) -> np.ndarray:
        return once_a_worker(name, load)(texts)

    return embed


def pair_scorer(name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A reranker for ``hybrid``: scores of queries and texts, to 6 places."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once_a_worker(name, load)
        for queries, texts in batches:
            yield pd.Series(model(queries.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64").round(6)

    return lambda query, text: score(query, text)


def text_model(name: str, load: Callable[[], Callable[[list[str]], list[str | None]]], fails_open: bool = False) -> Callable[[Column], Column]:
    """A generator, judge or rewriter: a text for each text. With ``fails_open`` an error gives nulls, which a rewrite takes for the original."""

    @F.pandas_udf("string")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series(once_a_worker(name, load)(texts.fillna("").tolist()), dtype="object")
            except Exception:
                if not fails_open:
                    raise
                yield pd.Series([None] * len(texts), dtype="object")

    return lambda text: write(text)
