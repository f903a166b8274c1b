"""The queries pN_... over the tables of one data directory, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import broken, budget, encode, hidden_dups, near_dups, pack, quality, sentences, split
from tessella.session import shared_folder, spread, union_all
from tessella.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_answer_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = budget.estimates(spread(table(spark, folder, "qa_pairs")), "pair_uid", "answer", "lang", "source", "semantic_group", table(spark, folder, "sources"))
    return rows.withColumnsRenamed({"id": "pair_uid", "domain": "semantic_group"})


def p1_answers(spark: SparkSession, folder: str) -> DataFrame:
    return budget.token_budget(p1_answer_tokens(spark, folder).withColumnRenamed("semantic_group", "domain")).withColumnRenamed("domain", "semantic_group")


def p1_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = budget.estimates(spread(table(spark, folder, "documents")), "doc_id", "text", "lang", "source", "domain", table(spark, folder, "sources"))
    return rows.withColumnRenamed("id", "doc_id")


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    return budget.token_budget(p1_document_tokens(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = broken.broken_pairs(spread(table(spark, folder, "qa_pairs")), "pair_uid", "question", "answer", "lang")
    return found.select("pair_uid", "defect").distinct()


def _records(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "qa_pairs").select(F.lit("qa_pairs").alias("rec_set"), F.col("pair_uid").alias("id"), "question", "answer")
    lines = hidden_dups.parsed_lines(table(spark, folder, "qa_lines"), "line_id", "line").select(F.lit("qa_lines").alias("rec_set"), "id", "question", "answer")
    return union_all(pairs, lines)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = hidden_dups.copies(_records(spark, folder), "id", ["question", "answer"], group_cols=("rec_set",), least_words=("answer", 30))
    return found.select("rec_set", "keep_id", "copy_id")


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return hidden_dups.collapsed(_records(spark, folder), "id", ["question", "answer"], group_cols=("rec_set",), least_words=("answer", 30))


def _long_items(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "qa_pairs").select(F.lit("answer").alias("item_kind"), F.col("pair_uid").alias("item_id"), F.col("answer").alias("text"))
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    return union_all(answers, chunks).select(F.struct("item_kind", "item_id").alias("item"), "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = split.pieces(spread(_long_items(spark, folder)), "item", "text")
    return cut.where(F.col("piece_no") == 1).select("item.item_kind", "item.item_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    cut = split.pieces(spread(_long_items(spark, folder)), "item", "text")
    return cut.select("item.item_kind", "item.item_id", "piece_no", "start_char", "end_char", "piece").dropDuplicates(["item_kind", "item_id", "piece_no"])


def p4_file_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The long answers as text files in the shared folder, split by byte ranges."""
    long = table(spark, folder, "qa_pairs").where(F.length("answer") > split.SIZE)
    paths = split.written_files(long, "answer", f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}")
    return split.split_files(spark, paths)


def _near_items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    answers = table(spark, folder, "qa_pairs").select(F.lit("answer").alias("item_kind"), F.col("pair_uid").alias("item_id"), F.col("answer").alias("text"))
    chunks = table(spark, folder, "chunks").where(F.col("strategy") == "sentence").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    return near_dups.near_duplicates(spread(union_all(answers, chunks)), "item_kind", "item_id", "text", similarity=0.6, length=3, least=60)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.all_pairs(*_near_items(spark, folder)).withColumnRenamed("kind", "item_kind")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    members, links = _near_items(spark, folder)
    return near_dups.groups(members, links).select(F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), "class_id", "group_id", "n_links")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    scope = table(spark, folder, "sent_scope").select("pair_uid")
    answers = table(spark, folder, "qa_pairs").select("pair_uid", "answer").where(F.col("answer").isNotNull()).join(scope, "pair_uid", "left_semi")
    return sentences.sentence_units(answers, "pair_uid", "answer").select("pair_uid", "start_char").distinct()


def p6_sentences(spark: SparkSession, folder: str) -> DataFrame:
    units = sentences.sentence_units(spread(table(spark, folder, "qa_pairs")), "pair_uid", "answer")
    return units.dropDuplicates(["pair_uid", "sentence_no"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.token_ids(spread(table(spark, folder, "documents")), "doc_id", "text")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return encode.token_texts(p7_ids(spark, folder), "doc_id", "ids")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack.containers(spread(table(spark, folder, "documents")), "doc_id", "text")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return pack.fill(p8_containers(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = quality.text_statistics(spread(table(spark, folder, "documents")), "doc_id", "text")
    kind = F.when(F.col("kind") == quality.BOILERPLATE, quality.JUNK).otherwise(F.col("kind"))  # remnants of pages
    return facts.where(F.col("kind").isNotNull() & (F.col("kind") != quality.PROSE)).select("doc_id", kind.alias("kind"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_statistics(spread(table(spark, folder, "documents")), "doc_id", "text")


def queries() -> dict[str, Query]:
    found = (p1_answer_tokens, p1_answers, p1_document_tokens, p1_documents, p2_found, p3_found, p3_records, p4_found, p4_pieces, p4_file_pieces, p5_found, p5_groups, p6_found, p6_sentences, p7_ids, p7_texts, p8_containers, p8_fill, p9_found, p9_statistics)
    return {query.__name__: query for query in found}


_P3_WORDS = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')),
  '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(57344) || '\2', 'g'), '(\p{{Nd}})\.(\p{{Nd}})', '\1' || chr(57344) || '\2', 'g'),
  '(\p{{Nd}}),(\p{{Nd}})', '\1' || chr(57345) || '\2', 'g'), '(\p{{Nd}}),(\p{{Nd}})', '\1' || chr(57345) || '\2', 'g'),
  '[\p{{Z}}\p{{Cc}}\p{{Cf}}\p{{P}}]+', ' ', 'g'))"""


_P3_RECORDS = f"""
with lines as (
  select line_id, case when json_valid(line) then line end as line from qa_lines),
records as (
  select 'qa_pairs' as rec_set, pair_uid as id, question, answer from qa_pairs
  union all
  select 'qa_lines', line_id, json_extract_string(line, '$.question'), json_extract_string(line, '$.answer') from lines
  where json_type(line) = 'OBJECT' and json_type(line, '$.question') = 'VARCHAR' and json_type(line, '$.answer') = 'VARCHAR'),
words as (
  select distinct rec_set, id, {_P3_WORDS.format('question')} as q, {_P3_WORDS.format('answer')} as a from records),
kept as (
  select *, min(id) over (partition by rec_set, q, a) as keep_id from words
  where a <> '' and length(a) - length(replace(a, ' ', '')) + 1 >= 30)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""{_P3_RECORDS}
select rec_set, keep_id, id as copy_id from kept where id > keep_id""",
        "p3_records": f"""{_P3_RECORDS}
select rec_set, keep_id, count(*) as n_copies from kept group by rec_set, keep_id""",
        "p5_found": """
with items as (
  select distinct 'answer' as item_kind, pair_uid as item_id, answer as text from qa_pairs where answer is not null
  union all
  select distinct 'chunk', chunk_id, chunk_text from chunks where strategy = 'sentence' and chunk_text is not null),
listed as (select item_kind, item_id, regexp_extract_all(lower(text), '[^\\p{Z}\\p{Cc}\\p{Cf}\\p{P}]+') as w from items),
runs as (select item_kind, item_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as r from listed where len(w) >= 62),
sets as (select item_kind, item_id, len(r) as n, r from runs where len(r) >= 60),
each as (select item_kind, item_id, n, unnest(r) as run from sets),
often as (select item_kind, run from each group by all having count(*) > 1),
common as (
  select a.item_kind, a.item_id as id_a, b.item_id as id_b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as shared
  from (select * from each semi join often using (item_kind, run)) a join each b on a.item_kind = b.item_kind and a.run = b.run and a.item_id < b.item_id and a.n >= 0.6 * b.n - 1 and b.n >= 0.6 * a.n - 1
  group by a.item_kind, a.item_id, b.item_id)
select item_kind, id_a, id_b from common where shared >= 0.6 * (n_a + n_b - shared) - 1e-9""",
        "p7_texts": "select doc_id, coalesce(text, '') as text from documents",
        "p4_found": """
select distinct 'answer' as item_kind, pair_uid as item_id from qa_pairs where length(answer) > 800
union all
select distinct 'chunk', chunk_id from chunks where length(chunk_text) > 800""",
    }
