"""A judge over answers: prompts, a run over the first real questions, calibration on a fabricated answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import tokenize
from tessella.operators import answering, evaluation

#: How many real questions are judged, and an answer that no source holds.
JUDGED = 8
FABRICATED = "Quartz lanterns orbiting Neptune were patented by choirs during winter 1742"

_HEAD, _ASKED, _SAID, _TAIL = "Grade an answer against its sources.\n\nSources:\n", "\n\nQuestion: ", "\n\nAnswer: ", '\n\nReply only with JSON: {"groundedness": 1 to 5, "relevance": 1 to 5}'


def judge_prompt(context: Column, question: Column, answer: Column) -> Column:
    """What the judge is asked."""
    return F.concat(F.lit(_HEAD), context, F.lit(_ASKED), question, F.lit(_SAID), answer, F.lit(_TAIL))


def _share(of: Column, among: Column) -> Column:
    """1 to 5 by the share of distinct tokens of one text found in another."""
    tokens = F.array_distinct(tokenize(of))
    return (1 + F.round(4.0 * F.size(F.array_intersect(tokens, F.array_distinct(tokenize(among)))) / F.size(tokens), 0)).cast("int")


def lexical_judge(prompt: Column) -> Column:
    """Stand-in for a judging model: shares of tokens found in the sources and in the answer; no JSON where the answer or question has no token."""
    pattern = "(?s)^" + _HEAD.replace(".", r"\.") + "(.*)" + _ASKED + "(.*)" + _SAID + "(.*)\n\nReply only with JSON: "
    context, question, answer = (F.regexp_extract(prompt, pattern, k) for k in (1, 2, 3))
    graded = F.to_json(F.struct(_share(answer, context).alias("groundedness"), _share(question, F.concat(answer, F.lit(" "), context)).alias("relevance")))
    return F.when((F.size(tokenize(answer)) > 0) & (F.size(tokenize(question)) > 0), graded).otherwise("nothing to grade")


def _first_passed(items: DataFrame, ranked: DataFrame, score_col: str, n: int) -> DataFrame:
    """(query_id, question, context, confidence) of those of the first n real items that pass the gate."""
    first = items.where(F.col("item_type") == "real").orderBy("ordinal").limit(n).select("query_id", "question")
    passed = answering.gate(first, ranked.join(first.select("query_id"), "query_id", "left_semi"), score_col).where(~F.col("refused"))
    return passed.join(first, "query_id").join(answering.context(ranked), "query_id").select("query_id", "question", "context", "confidence")


def judge_run(items: DataFrame, ranked: DataFrame, score_col: str, generate: Callable[[Column], Column] = answering.extractive, judge: Callable[[Column], Column] = lexical_judge, n: int = JUDGED) -> DataFrame:
    """(query_id, answer, confidence, groundedness, relevance, raw): answers of the first n real items past the gate, graded; raw holds the judge's words only where they can't be read.

    items: (query_id, ordinal, item_type, question). Items without rows or under the gate are skipped, not replaced.
    """
    made = _first_passed(items, ranked, score_col, n).withColumn("answer", generate(answering.prompt(F.col("context"), F.col("question"))))
    graded = made.withColumn("said", judge(judge_prompt(F.col("context"), F.col("question"), F.col("answer")))).withColumn("j", evaluation.parsed_judgement(F.col("said")))
    return graded.select("query_id", "answer", "confidence", "j.groundedness", "j.relevance", F.when(F.col("j.failed"), F.col("said")).alias("raw"))


def calibration(items: DataFrame, ranked: DataFrame, score_col: str, judge: Callable[[Column], Column] = lexical_judge, fabricated: str = FABRICATED, n: int = JUDGED) -> DataFrame:
    """(query_id, groundedness, calibrated): whether the judge gives a fabricated answer at most 2; a grade that can't be read fails."""
    asked = _first_passed(items, ranked, score_col, n)
    graded = asked.withColumn("j", evaluation.parsed_judgement(judge(judge_prompt(F.col("context"), F.col("question"), F.lit(fabricated)))))
    return graded.select("query_id", "j.groundedness", evaluation.calibrated(F.col("j.groundedness")).alias("calibrated"))


def probe(items: DataFrame, ranked: DataFrame, score_col: str) -> DataFrame:
    """(query_id, category, status, confidence, top_focus, top_preview): whether each question is answered, and its first match, null where there is none."""
    from tessella.functions.text import preview

    top = ranked.where(F.col("rank") == 1).select("query_id", F.col("focus").alias("top_focus"), preview(F.col("chunk_text"), 100).alias("top_preview"))
    status = F.when(F.col("refused"), "REFUSED").otherwise("ANSWERED")
    judged = answering.gate(items, ranked, score_col).join(items.select("query_id", F.col("item_type").alias("category")), "query_id").join(top, "query_id", "left")
    return judged.select("query_id", "category", status.alias("status"), "confidence", "top_focus", "top_preview")
