from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking

PLAIN = ["", "  ", None, "Rain fell. Did it stop? Yes! then sun. 7 days on", "one\ttwo\x1cthree\u3000four\n\nfive ", "Only this.", "K. Brown left. Ärger blieb. 3 came.", "川です。山です。", "no end"]
LONG = [" ".join(f"Item {k} of the list has {'many ' * (k % 9)}parts." for k in range(120)), "z" * 2100 + ". After it comes more.", "Mixed " * 400, "Short one. " + "y" * 900 + ". Then a tail."]
SAMPLES = PLAIN + LONG


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id int, text string")


def column(frame, expression):
    return {r.id: r.v for r in frame.select("id", expression.alias("v")).collect()}


def squeezed(text):
    return "".join((text or "").split())


def test_clean_text(frame):
    got = column(frame, T.clean_text(F.col("text")))
    assert got == {k: " ".join((t or "").split()) for k, t in enumerate(SAMPLES)}


def test_sentences(frame):
    got = column(frame, T.split_sentences(F.col("text")))
    assert got[3] == ["Rain fell.", "Did it stop?", "Yes! then sun.", "7 days on"]  # only before a capital or a digit
    assert got[6] == ["K.", "Brown left. Ärger blieb.", "3 came."]  # initials split, capitals beyond ASCII don't
    assert got[0] == got[1] == got[2] == [] and got[7] == ["川です。山です。"]
    for k, text in enumerate(SAMPLES):
        assert squeezed("".join(got[k])) == squeezed(text) and all(s == s.strip() and s for s in got[k])


def test_packing(frame):
    """What holds for packed sentences: order and characters are kept, budgets too, and no sentence is divided that fits."""
    budget = 800
    split, packed = column(frame, T.split_sentences(F.col("text"))), column(frame, T.sentence_chunks(T.split_sentences(F.col("text"))))
    for k, text in enumerate(SAMPLES):
        assert squeezed("".join(packed[k])) == squeezed(text)
        rest = list(split[k])
        for number, chunk in enumerate(packed[k]):
            inside = []
            if rest and len(rest[0]) > budget:  # windows of a sentence that is over the budget, without overlap
                assert len(chunk) <= budget and rest[0].startswith(chunk)
                rest[0] = rest[0][len(chunk) :].lstrip()
                rest = rest[1:] if not rest[0] else rest
                continue
            if rest and chunk == rest[0] and number and packed[k][number - 1] + rest[0] in "".join(split[k]):
                rest = rest[1:]  # the last window
                continue
            while rest and len(rest[0]) <= budget and len(" ".join([*inside, rest[0]])) <= len(chunk):
                inside.append(rest.pop(0))
            assert " ".join(inside) == chunk and sum(map(len, inside)) <= budget
            if rest and len(rest[0]) <= budget:  # the next sentence would not have gone in
                assert sum(map(len, inside)) + len(rest[0]) > budget
        assert not rest


def test_budget_leaves_out_joining_spaces(spark):
    parts = ["A" * 398 + "b.", "C" * 399 + "."]  # 799 characters without the space between them, 800 with it
    rows = spark.createDataFrame([(" ".join(parts),), (" ".join(["A" * 399 + "b.", parts[1]]),)], "text string")
    got = [r[0] for r in rows.select(T.sentence_chunks(T.split_sentences(F.col("text")))).collect()]
    assert [len(x) for x in got] == [1, 2]


@pytest.mark.parametrize("size,overlap", [(800, 100), (90, 0), (50, 49)])
def test_windows(spark, size, overlap):
    random.seed(5)
    texts = ["".join(random.choice(string.ascii_letters) for _ in range(n)) for n in (0, 1, size - 1, size, size + 1, 3 * size, 3 * size + overlap + 1)] + ["  pad  ", " " * (2 * size) + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = column(rows, T.fixed_size_chunks(F.col("text"), size, overlap))
    for k, text in enumerate(texts):
        if len(text) <= size:
            assert got[k] == [text]  # as it is, not stripped
        elif " " not in text:
            assert got[k][0] == text[:size] and text.endswith(got[k][-1]) and all(len(c) == size or text.endswith(c) for c in got[k])
            assert all(text[n * (size - overlap) :].startswith(c) for n, c in enumerate(got[k]))
            assert (len(got[k]) - 1) * (size - overlap) < len(text) <= len(got[k]) * (size - overlap)  # one begins every size - overlap
        else:
            assert "".join(got[k]).strip() and all(c == c.strip() and c for c in got[k])


def test_windows_need_progress():
    for size, overlap in ((100, 100), (100, 200), (10, -1)):
        with pytest.raises(ValueError):
            T.fixed_size_chunks(F.col("text"), size, overlap)


def test_tokens_words_ids(spark, frame):
    assert column(frame, T.tokenize(F.col("text"))) == {k: re.findall("[a-z0-9]+", (t or "").lower()) for k, t in enumerate(SAMPLES)}
    assert column(frame, T.word_count(F.col("text"))) == {k: len((t or "").split()) for k, t in enumerate(SAMPLES)}
    row = spark.range(1).select(T.padded_id(F.lit(12345678)), T.padded_id(F.lit(7)), T.pair_uid_of(F.lit("a::b::0")), T.preview(F.lit("a\nb"))).first()
    assert tuple(row) == ("12345678", "0000007", "a", "a b")


def test_semantic_breaks(spark):
    text = "Cats sleep all day. Cats sleep all night. Rockets burn fuel. Rockets burn more fuel."
    rows = spark.createDataFrame([("a", text), ("b", "One only."), ("c", None)], "id string, text string")
    got = sorted((r.id, r.chunk_index, r.chunk_text) for r in chunking.semantic(rows, "id", "text", threshold=0.3).collect())
    assert got == [("a", 0, "Cats sleep all day. Cats sleep all night."), ("a", 1, "Rockets burn fuel. Rockets burn more fuel."), ("b", 0, "One only.")]


def test_strategies(spark):
    pairs = spark.createDataFrame([("p", "A short answer.", "f")], "pair_uid string, answer string, focus string")
    assert [r.chunk_id for r in chunking.build_chunks(pairs, "sentence").collect()] == ["p::sentence::0"]
    with pytest.raises(ValueError):
        chunking.build_chunks(pairs, "unknown")
    with pytest.raises(ValueError):
        chunking.build_chunks(pairs, "semantic")
