from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import models
from tessella.functions.vectors import embed, hashed_bag_of_words
from tessella.operators import answering, dense, fusion, judging, sparse
from tessella.plans import retrieval

CHUNKS = [("c1", "copper pipes carry warm water through old houses"), ("c2", "basalt cools from lava and basalt cracks into columns"), ("c3", "owls hunt mice at night"), ("c4", ""), ("c5", "warm lava and water meet at the coast")]


def bm25_model(chunks, query, k):
    tokens = {c: re.findall("[a-z0-9]+", t.lower()) for c, t in chunks}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    n, mean_length = len(chunks), sum(map(len, tokens.values())) / len(chunks)
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    scores = {}
    for c, ts in tokens.items():
        tf = Counter(ts)
        scores[c] = round(sum(idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / mean_length)) for t in re.findall("[a-z0-9]+", query.lower())), 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


QUERIES = [("q1", "lava water lava"), ("q2", "nothing here zzz"), ("q3", "an owl or owls at night"), ("q4", ""), ("q5", None)]


@pytest.mark.parametrize("shard,block", [(20_000, 256), (1, 2)])
def test_bm25_against_model(spark, monkeypatch, tmp_path, shard, block):
    monkeypatch.setattr(sparse, "QUERY_BLOCK", block)
    chunks = spark.createDataFrame(CHUNKS, "id string, t string")
    asked = spark.createDataFrame([*QUERIES, QUERIES[0]], "query_id string, question string")
    for index in (sparse.build_index(chunks, "id", "t", shard), sparse.write_index(chunks, "id", "t", str(tmp_path), shard), sparse.open_index(spark, str(tmp_path))):
        got = sparse.top_k(index, asked, 3).collect()
        assert len(got) == 3 * len(QUERIES)
        for q, text in QUERIES:
            mine = [(r.chunk_id, r.bm25_score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            model = bm25_model(CHUNKS, text or "", 3)
            assert [c for c, _ in mine] == [c for c, _ in model]
            assert np.allclose([s for _, s in mine], [s for _, s in model], atol=1e-6)


def test_bm25_without_chunks(spark):
    index = sparse.build_index(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert sparse.top_k(index, spark.createDataFrame(QUERIES, "query_id string, question string"), 3).count() == 0
    with pytest.raises(RuntimeError, match="not found"):
        sparse.open_index(spark, "/nonexistent")


def test_best_places():
    rng = np.random.default_rng(3)
    for k in (1, 5, 40, 60):
        scores = rng.integers(-3, 4, 50).astype(float)
        assert sparse._best(scores, k).tolist() == np.argsort(-scores, kind="stable")[:k].tolist()


@pytest.mark.parametrize("norms", [False, True])
def test_cells_lose_nothing(spark, tmp_path, monkeypatch, norms):
    rng = np.random.default_rng(4)
    groups = rng.normal(size=(6, 8))
    vectors = np.concatenate([g + 0.2 * rng.normal(size=(60, 8)) for g in groups])
    if not norms:
        vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    vectors[7] = vectors[8]  # a tie
    vectors[9] = 0.0
    monkeypatch.setattr(dense, "PROBES", 1)
    monkeypatch.setattr(dense, "CELL", 60)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(999, None)], "id int, v array<double>").repartition(3)
    index = dense.write_cells(rows, "id", "v", str(tmp_path), block=25)
    assert sum(len(r.ids) for r in index.blocks.collect()) == len(vectors) and index.bounds.count() > 4
    asked = rows.where("id % 9 = 0")
    for k in (1, 4, 70):
        key = lambda r: (r.query_id, r["rank"], r.id, r.score)
        assert sorted(map(key, dense.top_k_cells(index, asked, "id", "v", k).collect())) == sorted(map(key, dense.top_k(asked, "id", "v", rows, "id", "v", k).collect()))
    # most cells are spared
    table = index.bounds.orderBy("cell").collect()
    most = dense.most_scores(vectors[::9], np.array([r.center for r in table]), *(np.array([r[c] for r in table]) for c in ("least_cosine", "least_norm", "most_norm")))
    for n, k in enumerate(range(0, len(vectors), 9)):
        for r in index.blocks.collect():
            at = [x.cell for x in table].index(r.cell)
            assert (vectors[[int(i) for i in r.ids]] @ vectors[k]).max() <= most[n, at]


def test_cells_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, v array<double>")
    index = dense.write_cells(empty, "id", "v", str(tmp_path))
    assert dense.top_k_cells(index, empty, "id", "v", 3).count() == 0
    with pytest.raises(RuntimeError, match="not found"):
        dense.open_cells(spark, str(tmp_path / "none"))


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(30, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(99, None)], "id int, v array<double>")
    got = dense.nearest(rows, "id", "v", vectors[4].tolist(), 5).collect()
    norms = np.sqrt((vectors**2).sum(axis=1))
    want = sorted(range(30), key=lambda k: (-round(float(vectors[k] @ vectors[4] / (norms[k] * norms[4])), 6), str(k)))[:5]
    assert [(r["rank"], r.id) for r in got] == [(n + 1, str(k)) for n, k in enumerate(want)]


def test_dense_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(99, None)], "id int, v array<double>").repartition(3)
    got = dense.top_k(rows.where("id % 5 = 0"), "id", "v", rows, "id", "v", 4, block=7).collect()
    for q in range(0, 50, 5):
        best = sorted(range(50), key=lambda k: (-round(float(vectors[k] @ vectors[q]), 6), str(k)))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == str(q)), key=lambda r: r["rank"])] == [str(k) for k in best]


def test_embedder():
    vectors = hashed_bag_of_words(["a b", "", "a b"])
    assert np.allclose((vectors**2).sum(axis=1), [1, 0, 1]) and (vectors[0] == vectors[2]).all()


def test_embed_null(spark):
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    assert {r.id: sum(r.embedding) for r in embed(rows, "id", "t").collect()} == {1: 0.0, 2: 1.0}


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, chunk_text string")


def test_fusion_order(spark):
    one = ranked(spark, [("q", 1, "a", ""), ("q", 2, "b", "")])
    two = ranked(spark, [("q", 1, "b", ""), ("q", 2, "c", "")])
    got = {r.chunk_id: (r["rank"], r.rrf_score) for r in fusion.reciprocal_rank_fusion([one, two]).collect()}
    assert got["b"] == (1, round(1 / 62 + 1 / 61, 12)) and got["a"][0] == 2 and got["c"][0] == 3


def test_fusion_ties_go_to_the_first_list(spark):
    one, two = ranked(spark, [("q", 1, "a", "")]), ranked(spark, [("q", 1, "z", "")])
    assert {r.chunk_id: r["rank"] for r in fusion.reciprocal_rank_fusion([two, one]).collect()} == {"z": 1, "a": 2}


def test_dedup_and_rerank(spark):
    rows = ranked(spark, [("q", 1, "a", "same"), ("q", 2, "b", "same"), ("q", 3, "c", "other words")])
    assert sorted(r.chunk_id for r in fusion.dedup(rows).collect()) == ["a", "c"]
    best = fusion.rerank(rows, 1, fusion.lexical_logit(F.lit("other words"), F.col("chunk_text"))).collect()
    assert [(r.chunk_id, r.rerank_score, r["rank"], r.fused_rank) for r in best] == [("c", 4.0, 1, 3)]


def test_gate_and_answers(spark):
    queries = spark.createDataFrame([("q1", "one"), ("q2", "two"), ("q3", "three")], "query_id string, question string")
    rows = spark.createDataFrame([("q1", 1, "c", "Thirst", "s", "u", "q?", "Drink water.", 2.0), ("q1", 2, "d", None, "s", "u", "q?", "Rest.", 1.0), ("q2", 1, "e", "x", "s", "u", "q?", "No.", -0.5)], "query_id string, rank int, chunk_id string, focus string, source string, url string, question string, chunk_text string, score double")
    gate = {r.query_id: (r.confidence, r.refused) for r in answering.gate(queries, rows, "score").collect()}
    assert gate["q3"] == (0.0, True) and gate["q2"][1] and not gate["q1"][1]
    assert answering.context(rows).where("query_id = 'q1'").first().context == "[1] (Topic: Thirst) Drink water.\n\n[2] (Topic: unknown) Rest."
    said = {r.query_id: r.answer for r in answering.answers(queries, rows, "score").collect()}
    assert said == {"q1": "Drink water. [1]", "q2": answering.REFUSAL, "q3": answering.REFUSAL}
    array = answering.sources_array(rows, "score").where("query_id = 'q1'").first().sources
    assert [s["rank"] for s in array] == [1, 2]


def test_rewrite_fails_open(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    model = lambda c: F.when(c == "a", "new").when(c == "b", "  ")
    assert [r[0] for r in rows.select(retrieval.rewritten(F.col("q"), model)).collect()] == ["new", "b", "c"]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(c, "topic", "s", "u", f"What of {c}?", t) for c, t in CHUNKS if t]
    chunks = spark.createDataFrame(rows, "chunk_id string, focus string, source string, url string, question string, chunk_text string")
    return retrieval.write_store(chunks, str(tmp_path_factory.mktemp("store")))


def asked_of(spark):
    rows = [("q1", "lava and water", "real", 1), ("q2", "owls", "real", 2), ("q3", "zzz qqq", "real", 3), ("q4", "copper", "borderline", 4)]
    return spark.createDataFrame(rows, "query_id string, question string, item_type string, ordinal int")


def test_models_reach_every_stage(spark, store, tmp_path):
    """An embedder, a reranker, a rewriter and a generator from outside, each loaded in the workers."""
    asked = asked_of(spark)
    embedder = models.embedder("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    last = models.pair_scorer("last", lambda: lambda queries, texts: [float(ord(t[-1])) for t in texts])
    got = retrieval.hybrid(asked, store, k=2, reranker=last).collect()
    best = {r.query_id: r.chunk_id for r in got if r["rank"] == 1}
    assert all(dict(CHUNKS)[c][-1] == "t" for c in best.values())  # the last letter that scores most
    assert all(r.rerank_score == float(ord(r.chunk_text[-1])) for r in got)
    assert retrieval.dense_top_k(asked, retrieval.write_store(store.chunks, str(tmp_path), embedder), 1, embedder).count() == 4
    rewrite = models.text_model("rewrite", lambda: lambda texts: [t.replace("owls", "lava") for t in texts])
    broken = models.text_model("broken", models.with_key("NO_SUCH_KEY_HERE", lambda key: None), fails_open=True)
    plain, again, failed = (retrieval.hybrid(asked, store, k=1, rewrite=r) for r in (None, rewrite, broken))
    of = lambda rows: {r.query_id: r.chunk_id for r in rows.collect()}
    assert of(failed) == of(plain) and of(again)["q2"] != of(plain)["q2"]
    shout = models.text_model("shout", lambda: lambda prompts: [p.upper()[:7] for p in prompts])
    said = answering.answers(asked, retrieval.hybrid(asked, store), "rerank_score", shout).collect()
    assert {r.answer for r in said if not r.refused} == {"SOURCES"} and {r.answer for r in said if r.refused} == {answering.REFUSAL}


def test_client_needs_a_key(spark, monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY_HERE", raising=False)
    with pytest.raises(RuntimeError, match="NO_SUCH_KEY_HERE"):
        models.with_key("NO_SUCH_KEY_HERE", str)()
    monkeypatch.setenv("NO_SUCH_KEY_HERE", "k")
    made = []
    load = models.with_key("NO_SUCH_KEY_HERE", lambda key: made.append(key) or key)
    assert [models.once_a_worker("client", load) for _ in range(3)] == ["k"] * 3 and made == ["k"]


def test_judge_run(spark, store):
    asked, ranked = asked_of(spark), retrieval.hybrid(asked_of(spark), store).cache()
    got = {r.query_id: r for r in judging.judge_run(asked, ranked, "rerank_score", n=3).collect()}
    assert "q4" not in got and "q3" not in got and got["q1"].groundedness == 5 and got["q1"].raw is None  # q3 is refused
    odd = judging.judge_run(asked, ranked, "rerank_score", judge=lambda prompt: F.lit("no grade")).collect()
    assert all(r.raw == "no grade" and r.groundedness is None for r in odd) and odd
    assert judging.judge_run(asked, ranked, "rerank_score", n=0).count() == 0


def test_calibration(spark, store):
    asked, ranked = asked_of(spark), retrieval.hybrid(asked_of(spark), store).cache()
    good = judging.calibration(asked, ranked, "rerank_score").collect()
    assert good and all(r.calibrated and r.groundedness <= 2 for r in good)
    lenient = judging.calibration(asked, ranked, "rerank_score", judge=lambda p: F.lit('{"groundedness": 5, "relevance": 5}')).collect()
    silent = judging.calibration(asked, ranked, "rerank_score", judge=lambda p: F.lit(None).cast("string")).collect()
    assert not any(r.calibrated for r in lenient + silent)


def test_probe(spark, store):
    asked = asked_of(spark)
    got = {r.query_id: r for r in judging.probe(asked, retrieval.hybrid(asked, store), "rerank_score").collect()}
    assert got["q1"].status == "ANSWERED" and got["q3"].status == "REFUSED" and got["q1"].top_focus == "topic" and len(got) == 4
    none = judging.probe(asked, retrieval.hybrid(asked, store).limit(0), "rerank_score").collect()
    assert all(r.status == "REFUSED" and r.top_focus is None and r.confidence == 0.0 for r in none)


def test_timing_and_warm_up(spark, store):
    retrieval.warm_up(store)
    rows, took = retrieval.timed_hybrid(asked_of(spark), store)
    assert set(took) == {"dense", "sparse", "fusion", "rerank"} and all(v > 0 for v in took.values())
    key = lambda r: (r.query_id, r["rank"], r.chunk_id)
    assert sorted(map(key, rows.collect())) == sorted(map(key, retrieval.hybrid(asked_of(spark), store).collect()))


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace as Fake

    from tessella.session import shared_folder

    context = Fake(getCheckpointDir=lambda: None, getConf=lambda: Fake(get=lambda key: None), master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Fake(sparkContext=context))
