"""The retrieval pipeline over the tables of one data directory."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import embed_text, strip
from tessella.functions.vectors import Embedder, embed, hashed_bag_of_words
from tessella.operators import dense, fusion, sparse
from tessella.session import settle, shared_folder, spread
from tessella.sources.tables import table

#: Scores columns of queries and texts.
Reranker = Callable[[Column, Column], Column]
#: Candidates of each retriever, and rows that are kept.
CANDIDATES, TOP_K = 20, 5


def corpus(spark: SparkSession, folder: str, strategy: str = "sentence") -> DataFrame:
    """The index rows of one strategy, each chunk once, without nulls in what is embedded or searched."""
    rows = table(spark, folder, "chunks").where(F.col("strategy") == strategy)
    fields = (F.coalesce("focus", F.lit("unknown")).alias("focus"), F.col("source"), F.col("url"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))
    return spread(rows, "chunk_id").select("chunk_id", *fields).distinct()  # scoring then needs no other shuffle


def with_texts(chunks: DataFrame) -> DataFrame:
    """Adds what the sparse index holds (question and text) and what is embedded (question, focus and text)."""
    return chunks.select("*", F.concat("question", F.lit(" "), "chunk_text").alias("sparse_text"), embed_text(F.col("question"), F.col("focus"), F.col("chunk_text")).alias("dense_text"))


def eval_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items as queries."""
    items = table(spark, folder, "eval_items")
    return items.select(F.col("item_id").cast("string").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"), "item_type", "expects_refusal", "gold_pair_uid", F.col("item_id").alias("ordinal"))


@dataclass
class Store:
    """The stored tables of one strategy: chunks, their vectors, these by cells, and the BM25 index."""

    chunks: DataFrame
    vectors: DataFrame
    cells: dense.CellIndex
    sparse: sparse.SparseIndex


#: Folders of what this process has stored.
_STORED: dict[tuple[str, str, str, str], str] = {}


def write_store(chunks: DataFrame, path: str, embedder: Embedder = hashed_bag_of_words) -> Store:
    """Writes the tables that queries need and returns them, opened."""
    session = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    texts = with_texts(session.read.parquet(f"{path}/chunks"))
    embed(texts, "chunk_id", "dense_text", embedder).write.mode("overwrite").parquet(f"{path}/vectors")
    dense.write_cells(session.read.parquet(f"{path}/vectors"), "chunk_id", "embedding", f"{path}/cells")
    sparse.write_index(texts, "chunk_id", "sparse_text", f"{path}/sparse")
    return open_store(session, path)


def open_store(spark: SparkSession, path: str) -> Store:
    """Stored tables; RuntimeError where they were never written."""
    index = sparse.open_index(spark, f"{path}/sparse")
    return Store(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), dense.open_cells(spark, f"{path}/cells"), index)


def stored(spark: SparkSession, folder: str, strategy: str = "sentence", embedder: Embedder = hashed_bag_of_words, refresh: bool = False) -> Store:
    """The store of one strategy of the tables in a folder, written once an application in the shared folder and opened by every later query; ``refresh`` writes it anew."""
    key = (spark.sparkContext.applicationId, folder, strategy, f"{embedder.__module__}.{embedder.__qualname__}")
    if refresh or key not in _STORED:
        path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        write_store(corpus(spark, folder, strategy), path, embedder)
        _STORED[key] = path
    return open_store(spark, _STORED[key])


def stored_vectors(spark: SparkSession, folder: str) -> dense.CellIndex:
    """The table of embeddings by cells, written once an application."""
    key = (spark.sparkContext.applicationId, folder, "embeddings", "")
    if key not in _STORED:
        path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
        dense.write_cells(table(spark, folder, "embeddings"), "vec_id", "embedding", path)
        _STORED[key] = path
    return dense.open_cells(spark, _STORED[key])


def dense_top_k(queries: DataFrame, store: Store, k: int, embedder: Embedder = hashed_bag_of_words) -> DataFrame:
    """(query_id, rank, chunk_id, cosine, score_l2) of the nearest chunks; score_l2 is one minus the squared distance of unit vectors."""
    asked = embed(queries.select("query_id", "question"), "query_id", "question", embedder)
    near = dense.top_k_cells(store.cells, asked, "query_id", "embedding", k)
    return near.select("query_id", "rank", F.col("id").alias("chunk_id"), F.col("score").alias("cosine"), F.round(2.0 * F.col("score") - 1.0, 6).alias("score_l2"))


def sparse_top_k(queries: DataFrame, store: Store, k: int) -> DataFrame:
    return sparse.top_k(store.sparse, queries, k)


def fused(queries: DataFrame, store: Store, candidates: int = CANDIDATES, embedder: Embedder = hashed_bag_of_words) -> DataFrame:
    """(query_id, rank, chunk_id, rrf_score): dense and sparse candidates, fused; not cut before reranking."""
    return fusion.reciprocal_rank_fusion([dense_top_k(queries, store, candidates, embedder), sparse_top_k(queries, store, candidates)])


def best_of(ranked: DataFrame, asked: DataFrame, chunks: DataFrame, k: int = TOP_K, reranker: Reranker = fusion.lexical_logit) -> DataFrame:
    """The fused rows of each query reranked: the best k with their chunk's columns and rerank_score. ``reranker`` scores columns of queries and texts."""
    rows = ranked.join(chunks.select("chunk_id", "focus", "source", "url", F.col("question").alias("chunk_question"), "chunk_text"), "chunk_id")
    rows = rows.join(asked.select("query_id", F.col("question").alias("asked")), "query_id")
    score = reranker(F.col("asked"), embed_text(F.col("chunk_question"), F.col("focus"), F.col("chunk_text")))
    best = fusion.rerank(rows, k, score)
    return best.select("query_id", "rank", "chunk_id", "focus", "source", "url", F.col("chunk_question").alias("question"), "chunk_text", "rerank_score", "fused_rank")


def hybrid(queries: DataFrame, store: Store, k: int = TOP_K, candidates: int = CANDIDATES, use_reranker: bool = True, rewrite: Callable[[Column], Column] | None = None, embedder: Embedder = hashed_bag_of_words, reranker: Reranker = fusion.lexical_logit) -> DataFrame:
    """The best k rows of each query with their chunk's columns: reranked with rerank_score, or without the reranker fused with rrf_score.

    A rewritten query, where ``rewrite`` is given, reaches both retrievers and the reranker; null and blank rewrites fall back to the original.
    Without the reranker copies of a text are not removed.
    """
    asked = queries
    if rewrite is not None:
        asked = queries.withColumn("question", rewritten(F.col("question"), rewrite))
    ranked = fused(asked, store, candidates, embedder)
    if use_reranker:
        return best_of(ranked, asked, store.chunks, k, reranker)
    rows = ranked.where(F.col("rank") <= k).join(store.chunks.select("chunk_id", "focus", "source", "url", "question", "chunk_text"), "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", "focus", "source", "url", "question", "chunk_text", "rrf_score")


def warm_up(store: Store, question: str = "warm up") -> None:
    """Answers one query without rewriting, so that later ones find code compiled and files open."""
    asked = store.chunks.sparkSession.createDataFrame([("warm", question)], "query_id string, question string")
    hybrid(asked, store).write.format("noop").mode("overwrite").save()


def timed_hybrid(queries: DataFrame, store: Store, k: int = TOP_K) -> tuple[DataFrame, dict[str, float]]:
    """``hybrid`` stage by stage, each written and read again, and the milliseconds each took, to one place."""
    took: dict[str, float] = {}

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.perf_counter()
        made = settle(make())
        took[name] = round(1000.0 * (time.perf_counter() - began), 1)
        return made

    near = stage("dense", lambda: dense_top_k(queries, store, CANDIDATES))
    hits = stage("sparse", lambda: sparse_top_k(queries, store, CANDIDATES))
    ranked = stage("fusion", lambda: fusion.reciprocal_rank_fusion([near, hits]))
    return stage("rerank", lambda: best_of(ranked, queries, store.chunks, k)), took


def rewritten(question: Column, rewrite: Callable[[Column], Column]) -> Column:
    """The rewritten question without white space around it, or the original where that is null or blank."""
    return F.coalesce(F.nullif(strip(rewrite(question)), F.lit("")), question)


#: Phrases of the dictionary rewriter and what they become.
REWRITES = {"Which medicines help against": "treatment of", "Which signs point to": "symptoms of", "What lies behind": "causes of", "hairfall": "hair loss"}


def dictionary(question: Column) -> Column:
    """Stand-in for a model that rewrites: phrases replaced by a dictionary."""
    out = question
    for phrase, plain in REWRITES.items():
        out = F.replace(out, F.lit(phrase), F.lit(plain))
    return out
