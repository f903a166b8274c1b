from __future__ import annotations

import os

import numpy as np
import pytest

from tessella.llm import broken, declining, endings, queries

SUBJECTS = ("salt", "the kidney", "a cough", "cold air", "the heart", "a rash", "iron", "the liver", "dust", "sleep")
PEOPLE = ("athletes", "older adults", "children", "smokers", "travellers", "farm workers")
PROSE = [f"Doctors link {x} to {y} in {k + 20}% of {p} (see Ray, {1990 + k}). Most {p} get well within {k % 9 + 2} weeks, e.g. after rest and water. The dose of {k + 1}.5 mg can be taken twice a day." for k, (x, y, p) in enumerate((a, b, c) for a in SUBJECTS for b in SUBJECTS[:4] for c in PEOPLE[:3])]


@pytest.fixture(scope="module")
def models(spark, data):
    larger = data.replace("sf0.001", "sf0.01")
    table = spark.read.parquet(f"{larger if os.path.isdir(larger) else data}/qa_pairs.parquet").select("lang", "question", "answer").toPandas()
    rows = {(lang[:2].lower(), q, a) for lang, q, a in table.itertuples(index=False) if lang and lang[:2].lower() in broken.fit_grams.__globals__["LANGS"]}
    return broken.fit(sorted(rows, key=str))


def defect(models, question, answer):
    return broken.defects([question], [answer], models)[0]


@pytest.mark.parametrize("text", [None, "", " \n", "N/A", "<p></p>", "&nbsp;", "[answer removed]", "--", "?", "(no answer)", "keine Angabe", "暂无"])
def test_missing_answers(models, text):
    assert defect(models, "What is gout?", text) == "empty"


def test_unseen_placeholders(models):
    texts = ["(to follow)", "[deleted]", "no data yet", "answer pending", "данных пока нет", "noch keine Antwort", "pas encore de réponse", "回答待ち", "<!-- empty -->", "NOT YET AVAILABLE", "Text removed"]
    assert np.mean([defect(models, "What is gout?", t) == "empty" for t in texts]) >= 0.9
    for text in ("Yes.", "Aspirin", "None of them works in the long run.", "Salt.", "Twice a day."):
        assert defect(models, "What is gout?", text) != "empty"


#: None of these is among the seeds.
UNSEEN = ["I would rather leave that one to your GP", "We can't get into this here.", "That is something I'd rather not go into.", "Apologies, but this isn't something I can get into.", "I'm not comfortable answering that.", "Ask your pharmacist; I'm not going to comment.", "Sobre eso me abstengo", "No quiero contestar a eso.", "Ich möchte das lieber nicht kommentieren.", "Darauf gehe ich nicht ein.", "Je laisse cette question à un spécialiste.", "Об этом я говорить не буду.", "这个我不好说，请去问医生。", "この質問には回答できません。", "मैं इस बारे में सलाह नहीं दे सकती।", "لا أستطيع مساعدتك في هذا الأمر", "ขอโทษ เราตอบเรื่องนี้ไม่ได้"]


def test_refusals(models):
    found = [defect(models, None, text) == "refusal" for text in UNSEEN]
    assert np.mean(found) >= 0.9
    assert not set(UNSEEN) & set(declining.DECLINING)
    # a long refusal is one, too; an answer that begins with one and goes on isn't
    assert defect(models, None, "I cannot answer this. " * 60) == "refusal"
    assert defect(models, None, "I cannot answer this for every case. " + " ".join(PROSE[:3])) is None
    for text in ("People who are unable to take salt may use sugar for three weeks, as athletes often do.", "Doctors cannot say for certain why it starts.", "Twice a day with food.", "No, within two weeks.", "Mostly farm workers."):
        assert defect(models, None, text) is None


def test_copied(models):
    for text in ("What is gout?", "**WHAT  IS GOUT**", "“what is​ gout”", "Q: What is gout?", "What is gout? What is gout?", "<b>What is gout?</b>", "What is gout? " * 50):
        assert defect(models, "What is gout?", text) == "copied"
    assert not broken.is_copied("What is gout?", "What is gout? An illness of the joints.") and not broken.is_copied(None, "x") and not broken.is_copied("", "x")


def test_short_answers_in_another_language(models):
    for question, answer in (("Which tests confirm gout?", "Un análisis de sangre y una ecografía."), ("How is gout treated?", "治疗从每天两次开始，持续三年。"), ("Was hilft gegen Gicht?", "Most people get well within two weeks.")):
        assert defect(models, question, answer) == "language"
    assert defect(models, "Which tests confirm gout?", "A blood count and a bone scan.") is None


def test_ends_by_likelihood():
    counts = endings.fit(PROSE)
    whole = [t for t in PROSE[:40]]
    cut = [t[: len(t) - k % 37 - 6] for k, t in enumerate(PROSE[:40])]
    marked = [t + "…" for t in cut]
    assert not any(endings.breaks_off(t, counts) for t in whole)
    assert np.mean([endings.breaks_off(t, counts) for t in cut]) >= 0.95 and np.mean([endings.breaks_off(t, counts) for t in marked]) >= 0.95
    # a full stop is no verdict: after an abbreviation it is no end; nor is its absence alone
    assert endings.end_probability(PROSE[0] + " Most smokers get well within 3 weeks, e.g.", counts) < endings.end_probability(PROSE[0], counts)
    # the odds decide: without a model nothing breaks off
    none = endings.fit([])
    assert not any(endings.breaks_off(t, none) for t in cut + marked)
    lists = endings.fit(PROSE + [t + "\n- salt\n- cold air" for t in PROSE])
    assert not endings.breaks_off(PROSE[0] + "\n- dust\n- the heart", lists) and not endings.breaks_off("See www.example.org", lists)


def test_pairs(spark, data):
    found = {r.pair_uid: r.defect for r in queries.p2_found(spark, data).collect()}
    assert set(found.values()) <= {"empty", "truncated", "refusal", "copied", "language"}
    table = spark.read.parquet(f"{data}/qa_pairs.parquet").select("pair_uid", "question", "answer", "lang")
    extra = [("x1", None, None, None), ("x2", "What is gout and who gets it?", "Die Therapie beginnt mit einem Bluttest und dauert bei den meisten Menschen drei Wochen, danach folgt eine Kontrolle.", "en"), ("x3", None, "Doctors usually order a scan. The next st", None), ("x4", "What is gout?", "Gout is an illness of the joints that lasts three weeks.", "en"), ("x4", "What is gout?", "Gout is an illness of the joints that lasts three weeks.", "en")]
    both = table.unionByName(spark.createDataFrame(extra, table.schema))
    got = {r.pair_uid: r.defect for r in broken.broken_pairs(both.withColumn("defect", both.pair_uid), "pair_uid", "question", "answer", "lang").collect() if r.pair_uid[0] == "x"}
    assert got == {"x1": "empty", "x2": "language", "x3": "truncated"}
    assert broken.broken_pairs(table.limit(0), "pair_uid", "question", "answer", "lang").count() == 0


def test_models_from_all_rows(spark):
    # of 700 Spanish rows the 400 whose ids have the smallest hashes hold no Spanish word: models of a bounded sample by hash would see no other
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(700).select(F.col("id").cast("string").alias("id")).orderBy(F.xxhash64("id"), "id").collect()]
    spanish = [f"Los médicos relacionan la dosis {k} con los riñones y muchas personas mejoran en {k % 9 + 2} semanas con reposo y agua." for k in range(300)]
    rows = [(i, f"{k}?", f"{k}, {k + 1}.", "es") for k, i in enumerate(ids[:400])] + [(i, "¿Qué es la gota y cómo se trata?", a, "es") for i, a in zip(ids[400:], spanish, strict=True)]
    rows += [(f"e{k}", "What is gout and how do doctors treat it?", text, "en") for k, text in enumerate(PROSE)]
    rows += [("x1", "What is gout and how do doctors treat it?", "Muchas personas mejoran en tres semanas con reposo y agua, y los médicos relacionan la dosis con los riñones.", "en"), (None, "What is gout?", PROSE[0][:-6], "en")]
    table = spark.createDataFrame(rows, "id string, question string, answer string, lang string").repartition(5)
    got = {r.id: r.defect for r in broken.broken_pairs(table, "id", "question", "answer", "lang").collect()}
    assert got["x1"] == "language" and got[None] == "truncated" and len(got) < 30
    # the sums of the tasks give the models of the rows at hand, however the rows are cut
    local = broken.defects([r[1] for r in rows], [r[2] for r in rows], broken.fit([(r[3], r[1], r[2]) for r in rows]))
    assert {r[0]: defect for r, defect in zip(rows, local, strict=True) if defect} == got
    again = broken.broken_pairs(table.coalesce(1), "id", "question", "answer", "lang")
    assert {r.id: r.defect for r in again.collect()} == got


def test_costs_grow_with_the_text():
    # before, ends of texts without spaces cost the square of their length, and a row of dots doubled the time of its sentence with each
    import time

    from tessella.llm import sentences

    began = time.process_time()
    long = "尿酸过高会引起关节发炎，" * 4_000
    assert endings.chains([long + "并且"])[1][0] and not endings._line(long) and endings._line(long + "a@b.org") == "link"
    assert sentences.boundaries("See chapter" + "." * 24 + "5 for it. Yes.") == [0, 45]
    assert time.process_time() - began < 5
    assert sentences.boundaries("See chapter" + "." * 5_000 + "5 for it. Yes.") == [0, 5_021]


def test_faster_steps_give_the_same():
    assert [endings._is_link(t) for t in ("https://a", "x(www.a", "a@b.org", "@a@b.c", "www.", "@b.org", "a@.org", "a@b.", "a@b.o-g", "a.b")] == [True] * 4 + [False] * 6
    # several names, one in another: the longest goes first; one alone; none
    assert broken.without_names("Is ABC or ABCDEF bad?", "No ABCDEF and ABC.") == "No   and  ."
    assert broken.without_names("Is Aspirin bad?", "No, Aspirin helps.") == "No,   helps." and broken.without_names("Is it?", "No.") == "No."
    # a letter that stands only behind the beginning, and markup and marks that are joined there
    assert broken.has_letters("- " * 150 + "a") and not broken.has_letters("- " * 150) and not broken.has_letters("<b> " * 100) and not broken.has_letters("&nbsp; " * 60)
    question = "Why did the café close its doors to its guests in winter? " * 5
    assert broken.is_copied(question, question.replace("\u00e9", "e\u0301")) and not broken.is_copied(question, question + " Because.")
