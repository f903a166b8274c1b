from __future__ import annotations

import os

import numpy as np
import pytest

from tessella.llm import budget, queries
from tessella.llm.tokenizer import VOCABULARIES, load

pytestmark = pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="no vocabulary files")
LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no larger tables")
@pytest.mark.parametrize("query,table,key,text", [(queries.p1_answer_tokens, "qa_pairs", "pair_uid", "answer"), (queries.p1_document_tokens, "documents", "doc_id", "text")])
def test_slices_against_all_tokens(spark, query, table, key, text):
    got = query(spark, LARGER).toPandas()
    rows = spark.read.parquet(f"{LARGER}/{table}.parquet").select(key, text).toPandas().drop_duplicates(key)
    encoder, _ = load()
    rows["true"] = [len(ids) for ids in encoder.encode_ordinary_batch(rows[text].fillna("").tolist())]
    both = got.merge(rows.assign(**{key: rows[key].astype(str)}), on=key)
    assert len(both) == len(rows) == len(got)
    langs = both.groupby("lang")[["est_tokens", "true"]].sum()
    assert (abs(langs.est_tokens / langs.true - 1) < 0.02).all()
    domain = "semantic_group" if "semantic_group" in got else "domain"
    slices = both.groupby(["lang", domain]).agg(est=("est_tokens", "sum"), true=("true", "sum"), n=("true", "size"))
    slices = slices[slices.n >= 10]
    assert (abs(slices.est / slices.true - 1)).quantile(0.9) < 0.03


def test_totals(spark, data):
    rows, totals = queries.p1_answer_tokens(spark, data).toPandas(), queries.p1_answers(spark, data).toPandas()
    assert totals.n_texts.sum() == len(rows) and abs(totals.est_tokens.sum() - rows.est_tokens.sum()) < 1
    known = set(spark.read.parquet(f"{data}/sources.parquet").toPandas().source) | {"unknown"}
    assert set(totals.source) <= known


def test_edges(spark):
    sources = spark.createDataFrame([("A", "The A")], "source string, title string")
    rows = spark.createDataFrame([(1, None, "en", " a ", None), (1, None, "en", "a", None), (2, "", None, "the a", "d"), (3, "some words here", "EN_us", None, "d"), (None, "x", "zz", "B", "d"), (None, "x", "zz", "B", "d")], "id int, text string, lang string, source string, domain string")

    def totals(df):
        return budget.token_budget(budget.estimates(df.withColumn("n_bytes", df.id), "id", "text", "lang", "source", "domain", sources))

    got = {(r.source, r.lang, r.domain): (r.n_texts, r.est_tokens) for r in totals(rows).collect()}
    assert got[("A", "en", "unknown")] == (1, 0.0) and got[("A", "und", "d")] == (1, 0.0) and got[("unknown", "en", "d")][0] == 1 and got[("unknown", "und", "d")][0] == 2
    assert totals(rows.limit(0)).count() == 0


def test_features():
    table = budget.features(["Ab 12, é", "", "数a"])
    names = budget.FEATURES
    assert table[0, names.index("bytes")] == 9 and table[0, names.index("words")] == 3 and table[0, names.index("digits")] == 2 and table[0, names.index("punctuation")] == 1
    assert (table[1, 1:] == 0).all() and table[2, names.index("han")] == 1 and np.isfinite(table).all()
    one, two = budget.features(["abcdefghijkl 1234 aBc,x1y"]), budget.features(["zz. " * 3, "abcdefghijkl 1234 aBc,x1y"])[1:]
    assert (one == two).all()  # no text changes another's counts
    assert one[0, names.index("beyond_4")] == 8 and one[0, names.index("beyond_9")] == 3 and one[0, names.index("digit_thirds")] == 3 and one[0, names.index("rises")] == 1
