"""Vectors: a deterministic hashed bag-of-words embedder, and its place for a real model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
Embedder = Callable[[list[str]], np.ndarray]
_TOKENS = re.compile("[a-z0-9]+")
_PLACES: dict[str, int] = {}


def _place(token: str) -> int:
    if len(_PLACES) > 500_000:
        _PLACES.clear()
    return _PLACES.setdefault(token, int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % DIMENSIONS)


def hashed_bag_of_words(texts: list[str]) -> np.ndarray:
    """Counts of hashed tokens, each row of length one (or zero where there is no token)."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in enumerate(texts):
        tokens = _TOKENS.findall(text.lower())
        if tokens:
            out[row] = np.bincount([_place(t) for t in tokens], minlength=DIMENSIONS)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1.0)


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Embedder = hashed_bag_of_words, batch: int = 1024) -> DataFrame:
    """(id, embedding array<double>) of each row; a null text is embedded as ''. The embedder sees batches and may load a model once a worker."""
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                part = rows.slice(low, batch)
                vectors = embedder([t or "" for t in part.column(1).to_pylist()])
                flat = pa.array(np.ascontiguousarray(vectors, dtype=np.float64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=schema)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, embedding array<double>").withColumnRenamed("id", id_col)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a guard against zero vectors."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))
