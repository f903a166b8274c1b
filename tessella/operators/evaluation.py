"""Evaluation sets, recall, reports, diagnosis and parsing of judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import pair_uid_of, word_count

#: Questions sampled of each source, seed, and the words an answer should have.
PER_SOURCE, SEED, LEAST_WORDS = 4, 42, 40
GOLD, REFUSAL_TYPES = ("real", "paraphrase"), ("out_of_domain", "borderline")


def stratified_sample(pairs: DataFrame, n: int = PER_SOURCE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """(source, pair_uid, question): n pairs of each source in order of a seeded hash, of those with long answers, or of all where a source has none."""
    ok = word_count(F.col("answer")) >= least_words
    by_source = W.partitionBy("source")
    marked = pairs.withColumn("_ok", ok).select("source", "pair_uid", "question", "_ok")
    with_any = marked.groupBy("source").agg(F.max("_ok").alias("_any"))
    kept = marked.join(with_any.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("_ok") | ~F.col("_any"))
    order = F.row_number().over(by_source.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "pair_uid")), "pair_uid"))
    return kept.withColumn("_n", order).where(F.col("_n") <= n).select("source", "pair_uid", "question")


def gold_ranks(items: DataFrame, ranked: DataFrame, name: str) -> DataFrame:
    """items with a column of the first rank at which their gold pair was found, null if not."""
    hit = items.select("query_id", "gold_pair_uid").join(ranked.select("query_id", "rank", "chunk_id"), "query_id").where(pair_uid_of(F.col("chunk_id")) == F.col("gold_pair_uid"))
    return items.join(hit.groupBy("query_id").agg(F.min("rank").alias(name)), "query_id", "left")


def report(items: DataFrame) -> DataFrame:
    """One row of the retrieval report from (item_type, gold_pair_uid, expects_refusal, dense_rank, hybrid_rank, refused); rates without rows are null."""
    gold, test = F.col("item_type").isin(*GOLD), F.col("item_type").isin(*REFUSAL_TYPES)
    with_id = gold & F.col("gold_pair_uid").isNotNull()

    def share(of: Column, among: Column) -> Column:
        return F.round(F.avg(F.when(among, of.cast("double"))), 3)

    return items.agg(
        F.count(F.when(with_id, 1)).alias("n_gold_items"),
        share(F.col("dense_rank").isNotNull(), with_id).alias("dense_recall_at_k"),
        share(F.col("hybrid_rank").isNotNull(), with_id).alias("hybrid_recall_at_k"),
        share(F.col("refused"), gold).alias("false_refusal_rate_on_answerable"),
        F.count(F.when(test, 1)).alias("n_refusal_test_items"),
        share(F.col("refused") == F.col("expects_refusal"), test).alias("refusal_gate_accuracy"),
    )


def diagnosis(fused: Column, reranked: Column, candidate_k: int) -> Column:
    """Which stage lost the gold chunk."""
    return F.when(fused.isNull(), "retrieval_miss").when((fused <= candidate_k) & reranked.isNull(), "reranker_miss").when(fused > candidate_k, "beyond_candidate_k").otherwise("success")


def parsed_judgement(raw: Column) -> Column:
    """struct(groundedness, relevance, failed) of a judge's JSON; failed where either can't be read."""
    fields = F.from_json(raw, "groundedness int, relevance int")
    return F.struct(fields["groundedness"].alias("groundedness"), fields["relevance"].alias("relevance"), (fields["groundedness"].isNull() | fields["relevance"].isNull()).alias("failed"))


def calibrated(groundedness: Column) -> Column:
    """Whether the judge gave a fabricated answer at most 2; false where it gave nothing."""
    return F.coalesce(groundedness <= 2, F.lit(False))
