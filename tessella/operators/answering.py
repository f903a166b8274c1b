"""Confidence gate, sources, context blocks, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import sigmoid
from tessella.session import union_all

#: The least confidence that is answered, and what is said otherwise.
THRESHOLD = 0.5
REFUSAL = "I don't have confident enough information in my knowledge base to answer that question. Please consult a healthcare professional, or try rephrasing your question with more specific medical terms."


def gate(queries: DataFrame, ranked: DataFrame, score_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, confidence, refused): confidence is the sigmoid of the first row's score, 0 without rows; refused below the threshold."""
    top = ranked.where(F.col("rank") == 1).select("query_id", F.round(sigmoid(F.col(score_col)), 6).alias("c"))
    joined = queries.select("query_id").join(top, "query_id", "left")
    return joined.select("query_id", F.coalesce("c", F.lit(0.0)).alias("confidence"), (F.coalesce("c", F.lit(0.0)) < threshold).alias("refused"))


def _in_order(columns: list[Column]) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("rank"), *columns)))


def sources(ranked: DataFrame, score_col: str) -> DataFrame:
    """(query_id, index, focus, source, url, question, score): numbered sources, one row each; score to 4 places."""
    return ranked.select("query_id", F.col("rank").alias("index"), "focus", "source", "url", "question", F.round(score_col, 4).alias("score"))


def sources_array(ranked: DataFrame, score_col: str) -> DataFrame:
    """(query_id, sources): the same as an ordered array; ranked holds at most k rows a query."""
    rows = sources(ranked, score_col).withColumnRenamed("index", "rank")
    columns = [F.col(c) for c in ("focus", "source", "url", "question", "score")]
    return rows.groupBy("query_id").agg(_in_order(columns).alias("sources"))


def context(ranked: DataFrame) -> DataFrame:
    """(query_id, context): ``[i] (Topic: focus) text`` of the rows in order, with a blank line between; ranked holds at most k rows a query."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Topic: "), F.coalesce("focus", F.lit("unknown")), F.lit(") "), F.col("chunk_text"))
    lines = ranked.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(_in_order([F.col("line")]).alias("lines"))
    return lines.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def prompt(context_col: Column, query: Column) -> Column:
    return F.concat(F.lit("Sources:\n"), context_col, F.lit("\n\nQuestion: "), query)


def extractive(prompt_col: Column) -> Column:
    """Stand-in for a generator: the first source's first 200 characters with its number."""
    first = F.regexp_extract(prompt_col, r"(?s)^Sources:\n\[1\] \(Topic: .*?\) (.*?)(?:\n\n\[2\]|\n\nQuestion: )", 1)
    return F.concat(F.substring(first, 1, 200), F.lit(" [1]"))


def answers(queries: DataFrame, ranked: DataFrame, score_col: str, generate: Callable[[Column], Column] = extractive, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, answer, confidence, refused). Only queries past the gate reach the generator: they are split off, not branched on. A query without rows is refused."""
    judged = gate(queries, ranked, score_col, threshold)
    refused = judged.where("refused").select("query_id", F.lit(REFUSAL).alias("answer"), "confidence", "refused")
    passed = judged.where("not refused").join(context(ranked), "query_id").join(queries.select("query_id", "question"), "query_id")
    made = passed.select("query_id", generate(prompt(F.col("context"), F.col("question"))).alias("answer"), "confidence", "refused")
    return union_all(made, refused)
