from __future__ import annotations

import pytest

from tessella.llm import quality, sentences

CASES = [
    ("Dr. Ray saw 2.5 mg in Fig. 3. Then he left.", ["Dr. Ray saw 2.5 mg in Fig. 3.", "Then he left."]),
    ('He said, "Stop. Do not go." and left. "Why?" she asked.', ['He said, "Stop. Do not go." and left.', '"Why?" she asked.']),
    ("It ended.Another began. Take it before 3 p.m. The rest waits.", ["It ended.", "Another began.", "Take it before 3 p.m.", "The rest waits."]),
    ("Rest helps, e.g. at night. Vitamin B. Blood is red.", ["Rest helps, e.g. at night.", "Vitamin B.", "Blood is red."]),
    ("Am 3. Mai kam er. Die 2. Auflage nennt z. B. Salz.", ["Am 3. Mai kam er.", "Die 2. Auflage nennt z. B. Salz."]),
    ("他说：“请坐。喝水。”并离开。为什么？因为累。", ["他说：“请坐。喝水。”并离开。", "为什么？", "因为累。"]),
    ("これは「行く。来る。」と言う。次です！終わり", ["これは「行く。来る。」と言う。", "次です！", "終わり"]),
    ("डॉ. राम आए। वे 5 मि.ग्रा. लेते हैं।", ["डॉ. राम आए।", "वे 5 मि.ग्रा. लेते हैं।"]),
    ("يطلب د. Ali التحليل. هل يزول؟ نعم.", ["يطلب د. Ali التحليل.", "هل يزول؟", "نعم."]),
    ("กินยา abc วันละ 5 มก. เป็นเวลา สองวัน แล้วพัก", ["กินยา abc วันละ 5 มก. เป็นเวลา", "สองวัน", "แล้วพัก"]),
    ("¿Cómo está? ¡Bien! «No sé. Quizá.» dijo él.", ["¿Cómo está?", "¡Bien!", "«No sé. Quizá.» dijo él."]),
    ("", []),
    (" \n ", []),
]


@pytest.mark.parametrize("text,units", CASES)
def test_sentence_units(text, units):
    cuts = sentences.boundaries(text)
    assert [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=False)] == units


def _candidates(text, monkeypatch):
    seen = {}

    def spy(*given):
        seen["given"] = given
        return best(*given)

    best = sentences._best_spans
    monkeypatch.setattr(sentences, "_best_spans", spy)
    cuts = sentences.boundaries(text)
    return seen["given"], cuts


@pytest.mark.parametrize("text,cut", [("¿Qué dijo el Lcdo. Pérez sobre la dosis? Nada nuevo.", [0, 41]), ("Sie sagte (laut Lab. Meier) nichts dazu. Danach ging sie.", [0, 41]), ('"Drink. Rest. Sleep," said the nurse on duty. Then she left.', [0, 46])])
def test_programme_overrules_local_scores(text, cut, monkeypatch):
    (_, starts, _, closes, opens), got = _candidates(text, monkeypatch)
    greedy = [starts[0]] + [at for at, a, b in zip(starts[1:-1], closes[1:], opens[1:], strict=False) if a + b > 0]
    assert got == cut and greedy != cut


@pytest.mark.parametrize("text", ["¿Qué dijo el Lcdo. Pérez? \"Nada. No sé,\" dijo. Luego (más tarde. Tal vez.) salió. ¡Ay! no. Sí.", "One (two. three. Four) five. \"Six. Seven. Eight\" nine.\nTen\neleven. A. B. C. dr. No. 5 is it... Or not? Yes"])
def test_programme_against_all_sequences(text, monkeypatch):
    import math
    from itertools import combinations

    (_, starts, ends, closes, opens), got = _candidates(text, monkeypatch)
    last = len(starts) - 1
    weights = [sum(w for a, b, w in sentences.enclosed(text) if a < at < b) if 0 < k < last else 0.0 for k, at in enumerate(starts)]

    def worth(cuts):
        total = 0.0
        for i, k in zip(cuts, [*cuts[1:], last], strict=True):
            part = text[starts[i] : starts[k]]
            lost = sum(part.count(a) - part.count(b) for a, b in ("¿?", "¡!")) > 0 and "¿" in text
            total += opens[i] + closes[k] - max(weights[i], weights[k]) - sentences.UNANSWERED * lost - sentences.STRETCH * (math.log(ends[k] - starts[i]) - math.log(sentences.USUAL)) ** 2
        return total

    every = [(0, *more) for n in range(last) for more in combinations(range(1, last), n)]
    assert abs(worth([starts.index(at) for at in got]) - max(map(worth, every))) < 1e-9


def test_scope_is_broadcast_only_below_the_threshold(spark, data):
    from tessella.llm import queries

    def joins():
        plan = queries.p6_found(spark, data)._jdf.queryExecution().sparkPlan().toString()
        return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan

    assert joins() == (True, False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = queries.p6_found(spark, data).count()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert joins() == (False, True) and queries.p6_found(spark, data).count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sentence_rows(spark):
    rows = spark.createDataFrame([(1, "One. Two.", "c"), (1, "One. Two.", "c"), (2, None, "c"), (3, "", "c"), (4, " ", "c"), (None, "It was so. " * 20_000, "c")], "k int, t string, start_char string")
    got = sentences.sentence_units(rows, "k", "t").collect()
    assert len([r for r in got if r.k == 1]) == 4 and len([r for r in got if r.k is None]) == 20_000 and not {2, 3, 4} & {r.k for r in got}
    assert sentences.sentence_units(rows.limit(0), "k", "t").count() == 0


KINDS = [
    ("The kidney filters blood all day. It also keeps salt in balance. Some people never notice.", "prose"),
    ("\n".join(f"{k}. item {k}" for k in range(9)), "list"),
    ("salt, cold air, dust, a blood count, coffee, late meals", "list"),
    ("Ray K, Bo L. Pain and salt. Town Bulletin 4(4):240-627.\nOx M, Ur P. Rash. Town Bulletin 5(1):20-27.", "list"),
    ("Rate|Dose|Note\nrash|5|\ncough||<3", "table"),
    ("- a blood count\n- dry cough\n- 2 eggs\n- salt", "list"),
    ("如果甲无效，可以改用乙，但学龄儿童要注意突然的心悸（见某地，2006年，第120例）。", "prose"),
    ("最も多い原因は管の詰まりですが、高齢者では古い傷も報告されています（某、2018年、第2例）。Ratio 1/2, 37.5 °C, x². AB13遺伝子の変化は肺と皮膚を傷つけます。", "prose"),
    (" ".join(f"Ruhe und Schlaf helfen im Haus {k} i. d. R. binnen zwei Wochen, so der Arzt in Ort {k * 7} am Meer." for k in range(40)), "prose"),
    ("| a | b |\n| 1 | 2 |\n| 3 | 4 |", "table"),
    ("Rate\tDose\tRange\nrash\t5\t1-2\ncough\t7\t3-4", "table"),
    ("ABC1: 5.2 mg/dL (ref 1-9)\nDEF2: 7 U/L (ref 2-8)", "table"),
    ("<table><tr><td>a</td><td>1</td></tr></table>", "table"),
    ("click here " * 40, "junk"),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Qgb2YgYmFzZTY0IGVuY29kaW5nIG91dHB1dA==", "junk"),
    ("===== " * 30, "junk"),
    ("DOCTORS ORDER A SCAN FIRST. THE REST CAN WAIT UNTIL LATER IN THE YEAR.", "prose"),
    ("Q: Does it hurt when the weather is cold?\nA: It may, but rest and warm water help most people.", "prose"),
    ("The first line of a paragraph that was\nwrapped by hand ends without a mark, and\nthe next one goes on. It ends here.", "prose"),
    ("Some longer text explains the matter in a full sentence that goes on for a while. It has another one.\n- salt\n- dust", "prose"),
]


@pytest.mark.parametrize("text,kind", KINDS)
def test_kinds(spark, text, kind):
    assert quality.kind_of(text) == kind


PROSE = "The kidney filters blood all day. It also keeps the salt of the body in balance, as doctors know. Some people never notice that it fails."


def test_each_statistic_moves_a_verdict():
    names = quality.STATISTICS
    facts = quality.statistics([PROSE])[0]
    assert quality.kind_of(PROSE, facts) == "prose"

    def moved(text=PROSE, **values):
        given = list(quality.statistics([text])[0])
        for name, value in values.items():
            given[names.index(name)] = value
        return quality.kind_of(text, tuple(given))

    assert moved(top_ngram_share=0.5) == "junk" and moved(distinct_word_share=0.05) == "junk" and moved(symbol_ratio=0.7) == "junk"
    assert moved(common_word_share=0.0, ended_line_share=0.0) == "junk" and moved(common_word_share=0.0) == "prose" and moved(ended_line_share=0.0) == "prose"
    assert moved(common_word_share=0.0, ended_line_share=0.0, mean_word_length=9.0) == "prose"  # a script without spaces
    assert moved(common_word_share=0.0, ended_line_share=0.0, n_words=5) == "prose"
    lines = "\n".join([PROSE] * 6)
    assert quality.kind_of(lines) == "junk" and moved(lines, duplicate_line_share=0.0, duplicate_paragraph_share=0.0, top_ngram_share=0.0, distinct_word_share=0.5) == "prose"
    assert moved(lines, duplicate_line_share=0.0, duplicate_paragraph_share=0.8, top_ngram_share=0.0, distinct_word_share=0.5) == "junk"


def test_boilerplate(spark):
    page = "Home and sign in to your account\nShare this page with friends\nSubscribe to our newsletter today\nRest helps.\nPrivacy policy and terms of use\n© 2020 All rights reserved"
    assert quality.kind_of(page) == "boilerplate" and quality.kind_of(PROSE + "\nPrivacy policy") == "prose"


def test_line_ends_after_many_marks():
    assert quality.is_ended("It ends." + '"' * 30) and not quality.is_ended("no end" + '"' * 30)


def test_statistics_against_plain_counts():
    from collections import Counter

    from tessella.llm.common import words_of

    texts = [text for text, _ in KINDS] + ["a b a b a b a b a b", "x", "é È é", "the cat. The end, the cat"]
    for text, facts in zip(texts, quality.statistics(texts), strict=True):
        words = words_of(text)
        share = 0.0
        for n in (2, 3, 4):
            for gram, times in Counter(zip(*(words[k:] for k in range(n)))).items():
                if times > 2 and len(words) >= 8:
                    share = max(share, min(1.0, times * sum(map(len, gram)) / sum(map(len, words))))
        assert facts[0] == len(words) and abs(facts[7] - share) < 1e-12
        assert abs(facts[1] * len(words) - sum(map(len, words))) < 1e-9 and abs(facts[8] * len(words) - len(set(words))) < 1e-9
        assert abs(facts[4] * len(words) - sum(w in quality.COMMON_WORDS for w in words)) < 1e-9


def test_statistics_rows(spark):
    rows = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, " \n", "c"), (4, "One two. Two one.", "c"), (4, "One two. Two one.", "c"), (None, "x " * 50_000, "c")], "k int, t string, kind string")
    got = quality.text_statistics(rows, "k", "t").collect()
    assert len(got) == 6 and all(r.kind is None and r.n_words == 0 for r in got if r.k in (1, 2, 3))
    four = next(r for r in got if r.k == 4)
    assert (four.n_words, four.mean_word_length, four.ended_line_share, four.distinct_word_share) == (4, 3.0, 1.0, 0.5)
    assert next(r for r in got if r.k is None).kind == "junk"
    assert quality.text_statistics(rows.limit(0), "k", "t").count() == 0
