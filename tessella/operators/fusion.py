"""Reciprocal rank fusion, order-preserving deduplication and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import tokenize
from tessella.session import union_all

#: Fixed value of the fusion formula.
RRF_K = 60


def reciprocal_rank_fusion(lists: list[DataFrame], rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, rank, chunk_id, rrf_score) of lists (query_id, rank, chunk_id); ties go to what comes first in the first list that has it."""
    rows = union_all(*(ranked.select("query_id", "chunk_id", "rank", F.lit(number).alias("list_no")) for number, ranked in enumerate(lists)))
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen"))
    return fused.select("query_id", rank.alias("rank"), "chunk_id", "rrf_score")


def dedup(ranked: DataFrame) -> DataFrame:
    """Of ranked rows (query_id, rank, chunk_id, chunk_text, ...) the first of each chunk_id, then the first of each text."""
    by_id = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("rank"))
    by_text = F.row_number().over(W.partitionBy("query_id", "chunk_text").orderBy("rank"))
    once = ranked.withColumn("_n", by_id).where("_n = 1").drop("_n")
    return once.withColumn("_n", by_text).where("_n = 1").drop("_n")


def lexical_logit(query: Column, text: Column, slope: float = 8.0, offset: float = 4.0) -> Column:
    """Stand-in for a cross-encoder: the share of the query's distinct tokens found in the text, as a logit that can be negative."""
    asked = F.array_distinct(tokenize(query))
    common = F.size(F.array_intersect(asked, F.array_distinct(tokenize(text))))
    return F.round(F.when(F.size(asked) > 0, slope * common / F.size(asked)).otherwise(F.lit(0.0)) - offset, 6)


def rerank(ranked: DataFrame, k: int, score: Column) -> DataFrame:
    """Deduplicated rows in order of ``score`` (an expression of their columns), the old rank breaking ties: (…, rank, rerank_score), k for each query."""
    scored = dedup(ranked).withColumn("rerank_score", score).withColumnRenamed("rank", "fused_rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
