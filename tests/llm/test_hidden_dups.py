from __future__ import annotations

import json
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessella.llm import common, hidden_dups
from tessella.llm.common import words_of


def words_model(text):
    out, word = [], ""
    low = (text or "").lower()
    for k, c in enumerate(low):
        kind = unicodedata.category(c)
        inner = c in ".," and 0 < k < len(low) - 1 and low[k - 1].isdecimal() and low[k + 1].isdecimal()
        if inner or not (kind[0] in "ZP" or kind in ("Cc", "Cf")):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def found(frame, **options):
    return sorted((r.keep_id, r.copy_id, r.n_copies) for r in hidden_dups.copies(frame, "id", ["q", "a"], **options).collect())


def test_formatting_only(spark):
    rows = [("1", "Why?", "It is 2.5 mg."), ("2", " WHY ", "it, is 2.5 MG"), ("3", "why", "It is 2,5 mg"), ("4", "why", "it is 25 mg"), ("5", "is it", "2.5 mg why"), ("6", None, "x"), ("7", "", "X!"), (None, "why", "it is 2.5 mg"), ("2", "Why?", "It is 2.5 mg.")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id string, q string, a string, invariant string, mark string")
    assert found(frame) == [("1", "2", 2), ("6", "7", 2)]


def test_groups_and_least_words(spark):
    frame = spark.createDataFrame([("x", "1", "q", "a b c"), ("x", "2", "Q", "A b, c"), ("y", "3", "q", "a b c"), ("x", "4", "q", "a"), ("x", "5", "q", "A")], "s string, id string, q string, a string")
    got = hidden_dups.copies(frame, "id", ["q", "a"], group_cols=("s",), least_words=("a", 3)).collect()
    assert [(r.s, r.keep_id, r.copy_id) for r in got] == [("x", "1", "2")]


def test_collapsed(spark):
    frame = spark.createDataFrame([("x", "1", "q", "a b c"), ("x", "2", "Q", "A b, c"), ("x", "2", "Q", "A b, c"), (None, "3", "q", "a b c"), (None, "9", "Q", "a b  c"), ("x", "4", "q", "c b a"), ("x", "5", None, None), ("x", None, "q", "a b c")], "s string, id string, q string, a string").withColumn("n_copies", F.lit(7))
    got = {(r.s, r.keep_id, r.n_copies) for r in hidden_dups.collapsed(frame, "id", ["q", "a"], group_cols=("s",)).collect()}
    assert got == {("x", "1", 2), (None, "3", 2), ("x", "4", 1), ("x", "5", 1)}
    assert hidden_dups.collapsed(frame.limit(0), "id", ["q", "a"]).count() == 0


def test_prefilter_loses_nothing(spark):
    rows, wanted = spark.range(20_000).select("id", (F.col("id") % 7).alias("k")), spark.range(0, 20_000, 40).select("id", (F.col("id") % 7).alias("k"))
    for most in (1 << 15, 1 << 29):
        passed = common.may_be_in(rows, ["id", "k"], wanted, most)
        assert passed.join(wanted, ["id", "k"], "left_semi").count() == 500 and passed.count() < 2600
    assert common.may_be_in(rows, ["id", "k"], wanted.limit(0)).count() == 0


def test_empty(spark):
    assert found(spark.createDataFrame([], "id string, q string, a string")) == []


def test_hot_class(spark):
    frame = spark.range(3000).selectExpr("cast(id as string) as id", "'Q' as q", "case when id % 3 = 0 then upper('same text') else concat('own ', id) end as a")
    got = found(frame)
    assert len(got) == 999 and {g[0] for g in got} == {"0"} and {g[2] for g in got} == {1000}
    # the rows of the hot class are spread over tasks
    marked = frame.select(F.lit(1).alias("k"), "id")
    spread = common.salted_join(marked, spark.createDataFrame([(1, 5)], "k int, v int"), ["k"], F.col("id"))
    assert spread.count() == 3000 and spread.groupBy(F.pmod(F.xxhash64("id"), F.lit(16))).count().count() == 16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB. ,1-2\tÉσΣ​", max_size=12), min_size=1, max_size=8))
def test_invariants_follow_words(texts):
    lengths, letters, counts = hidden_dups.invariants(texts)
    for k, text in enumerate(texts):
        words = words_model(text)
        assert counts[k] == len(words) and lengths[k] == sum(map(len, words))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if words_model(a) == words_model(b):
                assert (lengths[i], letters[i]) == (lengths[j], letters[j])


def test_lines(spark):
    good = json.dumps({"answer": "a", "question": "q", "z": [1]})
    lines = [good, '{"question": "\\u00e9", "answer": ""}', "", None, "[1]", '{"question": 1, "answer": "a"}', good[:-2], good + " x", '{"question": "q", "answer": null}', "'{}'", '{"question": "q", "answer": "a", "n": NaN}']
    frame = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    assert sorted((r.id, r.question, r.answer) for r in hidden_dups.parsed_lines(frame, "id", "line").collect()) == [("0", "q", "a"), ("1", "é", "")]


def test_words():
    assert words_of("Don't—STOP now") == ["don", "t", "stop", "now"]
