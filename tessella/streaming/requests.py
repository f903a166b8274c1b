"""Queries as a stream: each micro-batch is validated and answered by the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def reject_reason(question: Column, top_k: Column, ready: bool = True) -> Column:
    """Why a request is not accepted, null if it is: no retriever is ready, a question of fewer than 3 characters, or top_k (5 if null) outside 1 to 20."""
    if not ready:
        return F.lit("retriever_not_ready")
    return F.when(question.isNull() | (F.length(question) < 3), "question_too_short").when(~F.coalesce(top_k, F.lit(5)).between(1, 20), "top_k_out_of_range")


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame] | None, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that gives each micro-batch's accepted requests to ``answer`` and its result, with the batch's number, to ``sink``.

    A request that is delivered again within the watermark of an hour after it was asked is answered once. RuntimeError where there is nothing to answer with.
    """
    if answer is None:
        raise RuntimeError("no retriever is ready")
    once = requests.withWatermark("asked_at", "1 hour").dropDuplicatesWithinWatermark(["query_id"])
    accepted = once.where(reject_reason(F.col("question"), F.col("top_k")).isNull())
    return accepted.writeStream.foreachBatch(lambda batch, number: sink(answer(batch), number)).option("checkpointLocation", checkpoint).start()
