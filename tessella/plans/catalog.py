"""The queries of the reference's operators over the tables of one data directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import answering, chunking, dense, evaluation, fusion, judging, sparse
from tessella.plans import retrieval as R
from tessella.session import settle, shared_folder, spread, union_all
from tessella.sources import sinks, xml_pairs
from tessella.sources.tables import MissingInput, table
from tessella.streaming.requests import reject_reason

Query = Callable[[SparkSession, str], DataFrame]
NO_MATCH = "zzqxj vvkqz"


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair once, its answer cleaned; pairs without an answer left out."""
    rows = table(spark, folder, "qa_pairs").select("pair_uid", "answer").where(T.has_text(F.col("answer")))
    return spread(rows, "pair_uid").distinct().select("pair_uid", T.clean_text(F.col("answer")).alias("answer"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair once, whatever it was loaded."""
    return spread(table(spark, folder, "qa_pairs").drop("loaded_at", "fetched_at"), "pair_uid").distinct()


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_pairs").select("pair_uid", T.clean_text(F.col("question")).alias("question"), T.clean_text(F.col("answer")).alias("answer"))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    split = _answers(spark, folder).select("pair_uid", F.posexplode_outer(T.split_sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    return split.where(F.col("sentence").isNotNull())


def fixed_size_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.fixed_size(_answers(spark, folder), "pair_uid", "answer")


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sentence(_answers(spark, folder), "pair_uid", "answer")


def semantic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.semantic(_answers(spark, folder), "pair_uid", "answer", threshold=0.15)


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    words = T.word_count(F.col("chunk_text"))
    return spread(table(spark, folder, "chunks").select("strategy", "chunk_text")).groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.round(F.avg(words), 6).alias("avg_words"), F.max(words).cast("long").alias("max_words"))


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def word_stats(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    words = T.word_count(T.clean_text(F.col("answer")))
    shared = pairs.groupBy("qid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared"))
    facts = pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.round(F.avg(words), 6).alias("mean_words"), F.median(words).cast("double").alias("median_words"), F.max(words).cast("long").alias("max_words"))
    both = facts.crossJoin(F.broadcast(shared))
    return both.select("n_pairs", "n_docs", "n_sources", "mean_words", "median_words", "max_words", F.round(F.try_divide(100.0 * F.col("shared"), F.col("n_pairs")), 6).alias("shared_qid_percent"))


def qtype_top10(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("qtype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qtype").limit(10)


def duplicate_qids(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("qid").agg(F.count("*").alias("n")).where("n > 1")


def source_set(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).where(F.col("source").isNotNull()).groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"))


def pair_uid_assign(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).where(T.has_text(F.col("answer"))).select("source", "doc_id", "qid", F.col("pair_uid").alias("old_uid"))
    return xml_pairs.with_sequential_ids(rows.withColumn("source", F.coalesce("source", F.lit("unknown"))), ["source", "doc_id", "qid", "old_uid"]).select("old_uid", "pair_uid")


def extract_pair_uid(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", T.pair_uid_of(F.col("chunk_id")).alias("pair_uid"), T.preview(F.col("chunk_text")).alias("preview"))


def chunk_id_build(spark: SparkSession, folder: str) -> DataFrame:
    made = chunking.build_chunks(_pairs(spark, folder).where(T.has_text(F.col("answer"))).withColumn("answer", T.clean_text(F.col("answer"))), "fixed_size")
    return made.select("chunk_id", "pair_uid", "chunk_index", "qtype", "strategy")


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_texts(R.corpus(spark, folder)).select("chunk_id", "dense_text")


def hashed_embedding(spark: SparkSession, folder: str) -> DataFrame:
    vectors = R.stored(spark, folder).vectors
    return vectors.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).where("value != 0").select("chunk_id", "dim", F.round("value", 6).alias("value"))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    best = dense.top_k_cells(R.stored_vectors(spark, folder), rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return best.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score")


def label_recall(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    best = dense_topk(spark, folder).where("query_id != vec_id")
    named = best.join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id").join(rows, "vec_id")
    return named.groupBy("query_label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("same_label_share"))


def dense_chunk_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.dense_top_k(R.eval_queries(spark, folder), R.stored(spark, folder), R.TOP_K)


def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.postings(R.with_texts(R.stored(spark, folder).chunks), "chunk_id", "sparse_text").select("term", "chunk_id", "tf", F.col("dl").cast("long").alias("dl"))


def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    return R.stored(spark, folder).sparse.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.sparse_top_k(R.eval_queries(spark, folder), R.stored(spark, folder), R.TOP_K)


def bm25_no_match(spark: SparkSession, folder: str) -> DataFrame:
    asked = R.eval_queries(spark, folder).select("query_id", F.lit(NO_MATCH).alias("question"))
    return R.sparse_top_k(asked, R.stored(spark, folder), R.TOP_K)


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    return R.fused(R.eval_queries(spark, folder), R.stored(spark, folder))


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder), use_reranker=False).select("query_id", "rank", "chunk_id", "rrf_score")


def rerank_dedup(spark: SparkSession, folder: str) -> DataFrame:
    ranked = R.fused(R.eval_queries(spark, folder), R.stored(spark, folder)).join(R.stored(spark, folder).chunks.select("chunk_id", "chunk_text"), "chunk_id")
    return fusion.dedup(ranked).select("query_id", "rank", "chunk_id")


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder)).select("query_id", "rank", "chunk_id", "rerank_score")


def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    asked = R.eval_queries(spark, folder)
    return answering.gate(asked, R.hybrid(asked, R.stored(spark, folder)), "rerank_score")


def gate_without_reranker(spark: SparkSession, folder: str) -> DataFrame:
    asked = R.eval_queries(spark, folder)
    return answering.gate(asked, R.hybrid(asked, R.stored(spark, folder), use_reranker=False), "rrf_score")


def sources_struct(spark: SparkSession, folder: str) -> DataFrame:
    return answering.sources(R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder)), "rerank_score")


def sources_array(spark: SparkSession, folder: str) -> DataFrame:
    listed = answering.sources_array(R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder)), "rerank_score")
    line = F.transform("sources", lambda s: F.concat(s["rank"].cast("string"), F.lit(". "), F.coalesce(s["source"], F.lit("")), F.lit(" "), s["question"]))
    return listed.select("query_id", F.size("sources").cast("long").alias("n_sources"), F.array_join(line, "\n").alias("listed"))


def context_block(spark: SparkSession, folder: str) -> DataFrame:
    return answering.context(R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder)))


def generate_answer(spark: SparkSession, folder: str) -> DataFrame:
    asked = R.eval_queries(spark, folder)
    return answering.answers(asked, settle(R.hybrid(asked, R.stored(spark, folder))), "rerank_score")


def query_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "query_log").select("query_id", R.rewritten(F.col("question"), R.dictionary).alias("rewritten")).distinct()


def rewritten_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.hybrid(R.eval_queries(spark, folder), R.stored(spark, folder), rewrite=R.dictionary).select("query_id", "rank", "chunk_id", "rerank_score")


def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_log").select("query_id", "question", "top_k").distinct()
    return rows.select("query_id", F.coalesce("top_k", F.lit(5)).alias("top_k"), reject_reason(F.col("question"), F.col("top_k")).alias("reject_reason"))


def request_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "query_log").drop("logged_at").distinct()
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.col("refused").cast("double")), 6).alias("refused_share"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.round("retrieval_time_ms", 1)), 4).alias("mean_retrieval_ms"))


def jsonl_read(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines as records: null fields for lines that aren't objects or lack a field."""
    parsed = F.from_json("line", "question string, answer string, source string")
    return table(spark, folder, "qa_lines").where(F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull()).select("line_id", parsed["question"].alias("question"), parsed["answer"].alias("answer"))


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.stratified_sample(_pairs(spark, folder).withColumn("answer", T.clean_text(F.col("answer"))))


def eval_set_union(spark: SparkSession, folder: str) -> DataFrame:
    real = stratified_sample(spark, folder).select("question", F.lit("real").alias("item_type"), F.lit(False).alias("expects_refusal"), F.col("pair_uid").alias("gold_pair_uid"))
    rest = table(spark, folder, "eval_items").where("item_type != 'real'").select("question", "item_type", "expects_refusal")
    return union_all(real, rest, missing=True)


def eval_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").groupBy("item_type").agg(F.count("*").alias("n"), F.sum(F.col("expects_refusal").cast("long")).alias("n_refusal"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation items with their gold pair's ranks at each stage and the gate's decision."""
    items, store = R.eval_queries(spark, folder), R.stored(spark, folder)
    near = settle(R.dense_top_k(items, store, R.CANDIDATES))  # a few rows a query, as below
    fused = settle(fusion.reciprocal_rank_fusion([near, R.sparse_top_k(items, store, R.CANDIDATES)]))
    best = settle(R.best_of(fused, items, store.chunks))
    out = items
    for ranked, name in ((near.where(F.col("rank") <= R.TOP_K), "dense_rank"), (fused, "fused_rank"), (best, "hybrid_rank")):
        out = evaluation.gold_ranks(out, ranked, name)
    return out.join(answering.gate(items, best, "rerank_score"), "query_id")


def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    items = R.eval_queries(spark, folder).where(F.col("gold_pair_uid").isNotNull())
    near = evaluation.gold_ranks(items, R.dense_top_k(items, R.stored(spark, folder), R.TOP_K), "found")
    return near.select("query_id", F.col("found").isNotNull().alias("hit"))


def retrieval_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.report(_judged(spark, folder))


def find_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where(F.col("gold_pair_uid").isNotNull()).select("query_id", *(F.col(c).cast("double").alias(c) for c in ("dense_rank", "fused_rank", "hybrid_rank")))


def diagnose(spark: SparkSession, folder: str) -> DataFrame:
    gold = _judged(spark, folder).where(F.col("gold_pair_uid").isNotNull())
    return gold.select("query_id", evaluation.diagnosis(F.col("fused_rank"), F.col("hybrid_rank"), R.CANDIDATES).alias("diagnosis"))


def probe_summary(spark: SparkSession, folder: str) -> DataFrame:
    judged = _judged(spark, folder)
    return judged.groupBy("item_type").agg(F.count("*").alias("n"), F.sum(F.col("refused").cast("long")).alias("n_refused"))


def judge_parse(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("item_id") % 3
    raw = F.when(number == 0, F.concat(F.lit('{"groundedness": '), (F.col("item_id") % 5 + 1).cast("string"), F.lit(', "relevance": 4}'))).when(number == 1, F.lit("not json"))
    judged = table(spark, folder, "eval_items").select("item_id", evaluation.parsed_judgement(raw).alias("j"))
    return judged.select("item_id", F.col("j.groundedness").cast("double").alias("groundedness"), F.col("j.relevance").cast("double").alias("relevance"), "j.failed", evaluation.calibrated(F.col("j.groundedness")).alias("calibrated"))


def judge_averages(spark: SparkSession, folder: str) -> DataFrame:
    return judge_parse(spark, folder).where(F.col("groundedness").isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg("groundedness"), 6).alias("groundedness"), F.round(F.avg("relevance"), 6).alias("relevance"))


def xml_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder).withColumns({"question": T.clean_text(F.col("question")), "answer": T.clean_text(F.col("answer"))})
    parsed = xml_pairs.parse(xml_pairs.to_xml(pairs), "pair_uid", "content")
    return xml_pairs.qa_pairs(parsed).select(F.col("name").alias("pair_uid"), "doc_id", "qid", "qtype", "question", "answer", "url")


def _best(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The evaluation items and the reranked rows of each, written once."""
    asked = R.eval_queries(spark, folder)
    return asked, settle(R.hybrid(asked, R.stored(spark, folder)))


def judge_run(spark: SparkSession, folder: str) -> DataFrame:
    graded = judging.judge_run(*_best(spark, folder), "rerank_score")
    return graded.select("query_id", "answer", "confidence", F.col("groundedness").cast("double").alias("groundedness"), F.col("relevance").cast("double").alias("relevance"), "raw")


def judge_calibration(spark: SparkSession, folder: str) -> DataFrame:
    return judging.calibration(*_best(spark, folder), "rerank_score").select("query_id", F.col("groundedness").cast("double").alias("groundedness"), "calibrated")


def probe_status(spark: SparkSession, folder: str) -> DataFrame:
    return judging.probe(*_best(spark, folder), "rerank_score")


def dense_single(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    vector = rows.where("vec_id = 0").select("embedding").first()[0]
    return dense.nearest(rows, "vec_id", "embedding", vector, 10).select("rank", F.col("id").cast("long").alias("vec_id"), "score")


def index_build(spark: SparkSession, folder: str) -> DataFrame:
    """The vector index of one strategy, written, opened and read."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = sinks.build_index(R.with_texts(R.stored(spark, folder).chunks), path, "sentence")
    return index.select("chunk_id", F.size("embedding").cast("long").alias("n_dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared_length"), "focus", "source", "url", "question")


def index_count(spark: SparkSession, folder: str) -> DataFrame:
    counts = [(strategy, sinks.index_count(R.stored(spark, folder, strategy).vectors)) for strategy in chunking.STRATEGIES]
    return spark.createDataFrame(counts, "strategy string, n_vectors long")


def _error_of(make: Callable[[], object]) -> str:
    try:
        make()
    except (MissingInput, RuntimeError) as error:
        return f"{type(error).__name__}: {str(error).rsplit('; ', 1)[-1]}"
    return "none"


def missing_steps(spark: SparkSession, folder: str) -> DataFrame:
    """What a user is told who opens what was never made."""
    none = f"{shared_folder(spark)}/none"
    rows = [
        ("table", _error_of(lambda: table(spark, none, "chunks", "chunking"))),
        ("vector index", _error_of(lambda: sinks.open_index(spark, none, "sentence"))),
        ("sparse index", _error_of(lambda: sparse.open_index(spark, none))),
        ("cell index", _error_of(lambda: dense.open_cells(spark, none))),
    ]
    return spark.createDataFrame(rows, "step string, error string")


def xml_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs written as a tree of XML files, at most 1,000 pairs each, some cut off and some in excluded folders, then listed and parsed."""
    sources = table(spark, folder, "sources").select(F.col("source").alias("code"), "subset_dir", "excluded")
    excluded = tuple(row.subset_dir for row in sources.where("excluded").select("subset_dir").collect())  # the fixed list of sources
    pairs = _pairs(spark, folder).join(F.broadcast(sources), F.col("source") == F.col("code"), "left")
    pairs = pairs.select("pair_uid", "qid", "qtype", "question", "answer", F.coalesce("subset_dir", F.lit("0_Other_QA")).alias("subset"), F.substring("pair_uid", 1, 5).alias("bucket"))
    elements = pairs.select("subset", "bucket", F.struct("pair_uid", xml_pairs.pair_element().alias("x")).alias("e")).groupBy("subset", "bucket").agg(F.array_sort(F.collect_list("e")).alias("e"))
    none = F.lit(None).cast("string")
    whole = xml_pairs.document(F.array_join(F.transform("e", lambda e: e["x"]), ""), F.concat_ws("-", "subset", "bucket"), F.col("subset"), none, none, none)
    content = F.when(F.col("bucket").endswith("1"), F.substring(whole, 1, F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
    root = f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"
    sinks.write_files(elements.select(F.concat("subset", F.lit("/part/"), "bucket", F.lit(".xml")).alias("path"), content.alias("content")), "path", "content", root)
    parsed = xml_pairs.parse(xml_pairs.list_files(spark, root, excluded), "path", "content")
    return xml_pairs.qa_pairs(parsed).select("doc_id", F.col("source").alias("subset"), "qid", "qtype", "question", "answer", "url")


def _sink_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("pair_uid", "qid", "source", T.clean_text(F.col("question")).alias("question"), F.nullif(T.clean_text(F.col("answer")), F.lit("")).alias("answer"))


def jsonl_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_json_lines(_sink_rows(spark, folder), path)
    return sinks.read_json_lines(spark, path, "pair_uid string, qid string, source string, question string, answer string")


def csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = _sink_rows(spark, folder)
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


def report_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus statistics as an indented JSON file, read again."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}.json"
    report = word_stats(spark, folder)
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).option("multiLine", True).json(path)


QUERIES: tuple[Query, ...] = (
    clean_text, sentence_split, fixed_size_chunks, sentence_chunks, semantic_chunks, chunk_stats, tokenize, word_stats, qtype_top10, duplicate_qids, source_set, pair_uid_assign, extract_pair_uid, chunk_id_build,
    embed_text, hashed_embedding, dense_topk, label_recall, dense_chunk_topk, bm25_postings, bm25_idf, bm25_topk, bm25_no_match, rrf_fuse, hybrid_topk, rerank_dedup, rerank_topk, confidence_gate, gate_without_reranker,
    sources_struct, sources_array, context_block, generate_answer, query_rewrite, rewritten_topk, request_validation, request_stats, jsonl_read, stratified_sample, eval_set_union, eval_type_counts, recall_at_k, retrieval_report, find_rank,
    diagnose, probe_summary, judge_parse, judge_averages, xml_roundtrip, judge_run, judge_calibration, probe_status, dense_single, index_build, index_count, missing_steps, xml_folder, jsonl_sink, csv_sink, report_sink,
)


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in QUERIES}
