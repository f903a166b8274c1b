from __future__ import annotations

import random

import numpy as np
import pytest

from tessella.llm import queries, split


def texts():
    random.seed(3)
    word = lambda: random.choice(["alpha", "Beta,", "gamma.", "delta!\n", "é́x", "数据。", "：x", "\n\n", "  ", "👩‍👩‍👧", "ก็"])
    return [" ".join(word() for _ in range(n)) for n in (200, 900, 5000)] + ["x" * 5000, "a" + "́" * 3000, " " * 3000, "数" * 2500, "word " * 700]


@pytest.mark.parametrize("reach", [97, 1000])
def test_ranges_give_the_whole_tables_boundaries(reach):
    for text in texts():
        assert np.array_equal(split.stitched(text, reach), split.strengths(text, 0, len(text)))


@pytest.mark.parametrize("size,overlap", [(800, 100), (50, 0), (60, 29)])
def test_pieces_cover_and_fit(size, overlap):
    for text in texts():
        spans = list(split.spans(split.stitched(text), size, overlap))
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b < d and b - c <= overlap
        assert all(0 < b - a <= size for a, b in spans)


def test_natural_cuts():
    text = ("Sentence one is here. " * 30).strip() + "\n\n" + "More text follows. " * 30
    first = next(split.spans(split.stitched(text)))
    assert text[: first[1]].endswith("\n\n")


def test_rows(spark):
    rows = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "x" * 800, "u"), (4, "word " * 200, "u"), (4, "word " * 200, "u"), (None, "y" * 801, "u")], "k int, t string, piece string")
    got = split.pieces(rows, "k", "t").collect()
    assert sorted({r.k or 0 for r in got}) == [0, 4] and len([r for r in got if r.k == 4]) == 4
    assert all(len(r.piece) <= 800 for r in got)
    assert split.pieces(rows.limit(0), "k", "t").count() == 0
    with pytest.raises(ValueError):
        split.pieces(rows, "k", "t", size=100, overlap=50)


def test_very_long(spark):
    text = "A sentence of some words. " * 40_000
    got = sorted((r.start_char, r.end_char, r.piece) for r in split.pieces(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect())
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(text[a:b] == p for a, b, p in got)


def expected(text, **options):
    return [(a, b, text[a:b]) for a, b in split.spans(split.stitched(text), **options)] if text else []


@pytest.mark.parametrize("range_bytes", [700, 4_000, 150_000, 1 << 22])
def test_files_by_ranges(spark, tmp_path, range_bytes):
    size = {"size": 120, "overlap": 30} if range_bytes < 4_000 else {}
    lines = 250 if range_bytes < 4_000 else 3_000
    whole = ["".join(f"Línea número {k} 数据。 Second part, here.\n" + "\n" * (k % 7 == 0) for k in range(lines)), "", "short", "x" * 9_000 + " " * 5_000 + ")" * 400 + "数" * 4_000, "👩‍👩‍👧 e\u0301 " * 900]
    for k, text in enumerate(whole):
        (tmp_path / f"{k}.txt").write_text(text, encoding="utf-8")
    rows = split.split_files(spark, [str(tmp_path / f"{k}.txt") for k in range(len(whole))], range_bytes=range_bytes, **size).collect()
    for k, text in enumerate(whole):
        got = sorted((r.piece_no, r.start_char, r.end_char, r.piece) for r in rows if r.file_no == k)
        assert [r[0] for r in got] == list(range(len(got))) and [r[1:] for r in got] == expected(text, **size)


def test_no_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert split.split_files(spark, [str(tmp_path / "empty.txt")]).count() == 0 and split.split_files(spark, []).count() == 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.txt").write_bytes(b"ok \xff\xfe here " * 200)
    rows = split.split_files(spark, [str(tmp_path / "odd.txt")], range_bytes=100).orderBy("piece_no").collect()
    text = "ok \ufffd\ufffd here " * 200
    assert rows[-1].end_char == len(text) and all(r.piece == text[r.start_char : r.end_char] for r in rows)


def test_written_from_a_table(spark, data):
    got = queries.p4_file_pieces(spark, data).toPandas().sort_values(["file_no", "piece_no"])
    table = spark.read.parquet(f"{data}/qa_pairs.parquet").where("length(answer) > 800").toPandas()
    assert len(got) > 0 and (got.piece.str.len() <= 800).all()
    everything = "".join(t + "\n" for t in table.answer)
    first = got[got.file_no == 0]
    assert first.end_char.max() <= len(everything) and got.groupby("file_no").end_char.max().sum() == len(everything)
