"""Chunk tables of a corpus by three strategies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.vectors import Embedder, hashed_bag_of_words

STRATEGIES = ("fixed_size", "sentence", "semantic")


def chunk_rows(df: DataFrame, id_col: str, chunks: str) -> DataFrame:
    """(id, chunk_index, chunk_text) from an array column; no row for null and empty arrays.

    The outer form, as Spark would compute the array twice for the inner one, once before any shuffle to filter out empty arrays.
    """
    return df.select(id_col, F.posexplode_outer(chunks).alias("chunk_index", "chunk_text")).where(F.col("chunk_text").isNotNull())


def fixed_size(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 100) -> DataFrame:
    return chunk_rows(df.select(id_col, T.fixed_size_chunks(F.col(text_col), size, overlap).alias("chunks")), id_col, "chunks")


def sentence(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 200) -> DataFrame:
    split = df.select(id_col, T.split_sentences(F.col(text_col)).alias("sentences"))
    return chunk_rows(split.select(id_col, T.sentence_chunks(F.col("sentences"), max_tokens).alias("chunks")), id_col, "chunks")


def semantic(df: DataFrame, id_col: str, text_col: str, embedder: Embedder = hashed_bag_of_words, threshold: float = 0.55, max_tokens: int = 250) -> DataFrame:
    """A chunk begins where a sentence's similarity to the one before it is under the threshold, or the budget is full."""
    split = df.select(id_col, T.split_sentences(F.col(text_col)).alias("sentences")).where(F.size("sentences") > 0)
    shape = split.schema

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(shape).append(pa.field("breaks", pa.list_(pa.bool_())))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            lists = batch.column(1).to_pylist()
            if not lists:
                continue
            vectors = embedder([s for sentences in lists for s in sentences])
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            near = np.r_[0.0, (vectors[1:] * vectors[:-1]).sum(axis=1) / (norms[1:] * norms[:-1] + 1e-8)] if len(vectors) else np.zeros(0)
            apart = np.floor(near * 1e9 + 0.5) / 1e9 < threshold
            breaks, at = [], 0
            for sentences in lists:
                breaks.append(apart[at : at + len(sentences)].tolist())
                at += len(sentences)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(breaks, pa.list_(pa.bool_()))], schema=schema)

    ddl = f"{id_col} {shape[id_col].dataType.simpleString()}, sentences array<string>, breaks array<boolean>"
    cut = split.mapInArrow(run, ddl)
    return chunk_rows(cut.select(id_col, T.semantic_chunks(F.col("sentences"), F.col("breaks"), max_tokens).alias("chunks")), id_col, "chunks")


def build_chunks(pairs: DataFrame, strategy: str, embedder: Embedder | None = None) -> DataFrame:
    """The chunk table of QA pairs: chunk_id, pair_uid, chunk_index, chunk_text, strategy and the pair's columns."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    if strategy == "semantic" and embedder is None:
        raise ValueError("strategy 'semantic' needs an embedder")
    made = {"fixed_size": fixed_size, "sentence": sentence}[strategy](pairs, "pair_uid", "answer") if strategy != "semantic" else semantic(pairs, "pair_uid", "answer", embedder)
    keyed = made.select("pair_uid", "chunk_index", "chunk_text", F.lit(strategy).alias("strategy"), F.concat_ws("::", "pair_uid", F.lit(strategy), F.col("chunk_index").cast("string")).alias("chunk_id"))
    return keyed.join(pairs.drop("answer"), "pair_uid")
