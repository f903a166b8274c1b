from __future__ import annotations

import json
import os

import pytest

from tessella.operators import evaluation
from tessella.plans import catalog
from tessella.sources import sinks, xml_pairs
from tessella.sources.tables import MissingInput, table

GOOD = '<Document id="0001" source="S" url="u"><Focus>Gout &amp; pain</Focus><FocusAnnotations><SemanticGroup>Disorders</SemanticGroup></FocusAnnotations><QAPairs><QAPair><Question qid="q1" qtype="t">What  is it?</Question><Answer>An\n illness.</Answer></QAPair><QAPair><Question>Why?</Question><Answer></Answer></QAPair><QAPair><Answer>No question.</Answer></QAPair><QAPair><Question>How?</Question><Answer>Slowly <b>bold</b> rest.</Answer></QAPair></QAPairs></Document>'


def test_xml_folder(spark, tmp_path):
    for path, content in {"1_A_QA/x/a.xml": GOOD, "1_A_QA/b.xml": GOOD[:80], "2_B_QA/c + d é.xml": "<Document><QAPairs/></Document>", "10_MPlus_ADAM_QA/d.xml": GOOD, "e.xml": GOOD, "2_B_QA/note.txt": "x"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(content)
    files = xml_pairs.list_files(spark, str(tmp_path))
    assert sorted("/".join(r.parts) for r in files.collect()) == ["1_A_QA/b.xml", "1_A_QA/x/a.xml", "2_B_QA/c + d é.xml"]
    pairs = xml_pairs.qa_pairs(xml_pairs.parse(files, "path", "content"))
    got = sorted((r.qid, r.qtype, r.question, r.answer, r.doc_id, r.focus, r.semantic_group) for r in pairs.collect())
    assert got == [("0001-1", "unknown", "How?", "Slowly", "0001", "Gout & pain", "Disorders"), ("q1", "t", "What is it?", "An illness.", "0001", "Gout & pain", "Disorders")]


def test_sequential_ids(spark):
    rows = spark.createDataFrame([(k,) for k in range(500, 0, -1)], "v int").repartition(7)
    got = sorted((r.v, r.pair_uid) for r in xml_pairs.with_sequential_ids(rows, ["v"]).collect())
    assert got == [(v, f"{v - 1:07d}") for v in range(1, 501)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 'say "hi"', "é")], "chunk_id string, dense_text string, note string")
    sinks.write_json_lines(rows, str(tmp_path / "j"))
    assert sinks.read_json_lines(spark, str(tmp_path / "j"), "chunk_id string, dense_text string, note string").collect() == rows.collect()
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect() == rows.collect()
    assert sinks.write_report(rows, str(tmp_path / "r.json")) == json.loads((tmp_path / "r.json").read_text())
    with pytest.raises(RuntimeError, match="not found"):
        sinks.open_index(spark, str(tmp_path), "sentence")
    assert sinks.build_index(rows, str(tmp_path / "i"), "sentence").count() == 1
    assert sinks.build_index(rows.union(rows.selectExpr("'c2'", "dense_text", "note")), str(tmp_path / "i"), "sentence", append=True).count() == 2


def test_missing_table(spark, tmp_path):
    with pytest.raises(MissingInput, match="run ingest first"):
        table(spark, str(tmp_path), "chunks", "ingest")


def test_stream(spark, tmp_path):
    from tessella.streaming.requests import answer_stream

    rows = spark.sql("select * from values (1L, timestamp'2025-01-01', 'Why so?', 5), (1L, timestamp'2025-01-01', 'Why so?', 5), (2L, timestamp'2025-01-01', 'no', 5), (3L, timestamp'2025-01-01', 'Why not?', 100) as t(query_id, asked_at, question, top_k)")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = answer_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda batch: batch, lambda batch, _: seen.extend(r.query_id for r in batch.collect()), str(tmp_path / "cp"))
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert seen == [1]


def test_sample_falls_back(spark):
    long = "w " * 50
    rows = spark.createDataFrame([("A", f"a{k}", "q", long if k < 6 else "short") for k in range(9)] + [("B", "b0", "q", "short"), (None, "n0", "q", "short")], "source string, pair_uid string, question string, answer string")
    got = evaluation.stratified_sample(rows).collect()
    assert sorted((r.source or "", r.pair_uid[0]) for r in got) == [("", "n")] + [("A", "a")] * 4 + [("B", "b")]
    assert all(int(r.pair_uid[1:]) < 6 for r in got if r.source == "A")


def test_report_without_items(spark):
    empty = spark.createDataFrame([], "item_type string, gold_pair_uid string, expects_refusal boolean, dense_rank int, hybrid_rank int, refused boolean")
    row = evaluation.report(empty).first()
    assert row.n_gold_items == 0 and row.dense_recall_at_k is None and row.false_refusal_rate_on_answerable is None


def test_judge(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([('{"groundedness": 1, "relevance": 2}',), ("oops",), (None,)], "raw string")
    got = [tuple(r.j) for r in rows.select(evaluation.parsed_judgement(F.col("raw")).alias("j")).collect()]
    assert got == [(1, 2, False), (None, None, True), (None, None, True)]


@pytest.mark.parametrize("fused,reranked,said", [(None, None, "retrieval_miss"), (3, None, "reranker_miss"), (21, 1, "beyond_candidate_k"), (2, 1, "success")])
def test_diagnosis(spark, fused, reranked, said):
    from pyspark.sql import functions as F

    assert spark.range(1).select(evaluation.diagnosis(F.lit(fused).cast("int"), F.lit(reranked).cast("int"), 20)).first()[0] == said


def test_catalog_names():
    assert len(catalog.queries()) == len(catalog.QUERIES)
