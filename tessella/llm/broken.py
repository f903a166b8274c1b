"""Problem 2: broken prompt and response pairs, each with its one defect.

Languages of prompt and response are compared by posteriors of a naive Bayes over hashed character trigrams; truncation is
found by the n-gram likelihood of the last characters as an end of text; refusals and stand-ins for a missing answer by the likelihood of
all their characters under models fitted on seeds. All are fitted on the whole texts of all rows, counted in the tasks and summed; all
rows are then judged by whole texts of any length.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import declining, endings
from tessella.llm.common import LANGS, arrow_rows, clean_lang, settle, union_all
from tessella.llm.language import NB_BITS, counted_grams, fit_grams, grams_of, language_scores  # noqa: F401

#: Counts of a language's texts are scaled to so many rows if it has more, so that languages weigh alike and smoothing and seeds hold at any size.
WEIGHED_ROWS = 300
#: Weighted counts are kept in whole units, so that sums don't depend on their order.
UNIT = 1 << 30
#: Elements of a part of an array that a task sends, contexts or chains that a task holds before it sends them, and most bits of the map of wanted contexts.
PART, HELD, MAP_BITS = 1 << 16, 1 << 18, 1 << 29
#: Least advantage in nats of the response's language over the prompt's, in total and a character, and of the prompt's own.
LEAST_ANSWER, LEAST_QUESTION, LEAST_RATE = 15.0, 4.0, 0.03

# Words that label a question or stand beside it in an answer that only repeats it.
LABELS = frozenset("q question questions the asked you your was is pregunta frage la die question вопрос 问题 質問 प्रश्न سؤال คำถาม re fwd a answer".split())
_LABEL_LETTERS = frozenset("".join(LABELS))
_TAG = re.compile(r"<[^<>]*>")
_ASIDE = re.compile(r"[(（][^()（）]*[)）]")
_NAME = re.compile(r"[^\W_]{3,}")


def plain(text: str | None) -> str:
    """A text without markup, width and case."""
    text = text or ""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return unicodedata.normalize("NFKC", text).casefold()


def letters(text: str | None) -> str:
    """Letters and digits of a text without markup, width and case."""
    return "".join(c for c in plain(text) if c.isalnum() or unicodedata.category(c)[0] == "M")


def _begins(text: str) -> str | None:
    """``plain`` of a text's beginning up to a space, which no character before it is joined with; None if that isn't what ``plain`` of the text begins with."""
    cut = text.find(" ", 200)
    return plain(text[:cut]) if cut > 0 and "&" not in text and "<" not in text else None


def has_letters(text: str | None) -> bool:
    """Whether a text has a letter or digit besides markup."""
    return any(c.isalnum() for c in _begins(text or "") or "") or any(c.isalnum() for c in plain(text))


def is_copied(question: str | None, answer: str) -> bool:
    """Whether an answer only gives the question back, in any case, markup, spacing, with a label or several times; a question of fewer than four letters isn't compared."""
    if not question:
        return False
    known = set(plain(question)) | _LABEL_LETTERS
    begins = _begins(answer)
    if begins and any(c.isalnum() for c in set(begins) - known) or any(c.isalnum() for c in set(plain(answer)) - known):
        return False
    asked, given = letters(question), letters(answer)
    if len(asked) < 4 or asked not in given:
        return False
    rest = given.replace(asked, " ").split()
    words = {letters(w) for w in re.findall(r"[^\W_]+", plain(question))} | LABELS
    return all(any(part == word for word in words) for part in rest)


def asked_for(question: str | None) -> str:
    """A question without asides in brackets, which hold terms of any language."""
    question = question or ""
    left = _ASIDE.sub(" ", question)
    return left if left.strip() else question


def without_names(question: str | None, answer: str) -> str:
    """An answer without the words of Latin letters and digits that its question has, too, so that a subject's name says nothing of how it is treated."""
    words = [w for w in _NAME.findall(question or "") if w.isascii()]
    foreign = not (question or "").isascii() and any(ord(c) >= 0x370 and c.isalpha() for c in question)  # then every Latin word is a name
    names = {w for w in words if foreign or not w.islower()}
    names = [n for n in names if n in answer]
    if not names:
        return answer
    if len(names) == 1:
        left = answer.replace(names[0], " ")
    else:
        left = re.sub("|".join(sorted(map(re.escape, names), key=len, reverse=True)), " ", answer)
    return left if has_letters(left) else answer


@dataclass
class Models:
    """Trigrams of languages in prompts and in responses, 5-grams of declining and missing answers, contexts of ends."""

    prompts: np.ndarray
    grams: np.ndarray
    odds: np.ndarray
    ends: endings.Counts | None


def weights(rows: dict[str, int]) -> dict[str, int]:
    """Units that a row of each language counts, from its number of rows."""
    return {lang: round(UNIT * min(1.0, WEIGHED_ROWS / count)) for lang, count in rows.items() if count}


def _by_language(langs: list[str], texts: list[str | None]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, text in zip(langs, texts, strict=True):
        if text and text.strip():
            out.setdefault(lang, []).append(text)
    return out


def _weighed(langs: list[str], answers: list[str | None], units: dict[str, int]) -> np.ndarray:
    """``declining.counted`` of answers, in units."""
    out = np.zeros(2 << declining.BITS, dtype=np.int64)
    for lang, texts in _by_language(langs, answers).items():
        out += declining.counted(texts).astype(np.int64) * units[lang]
    return out


def _grams(counts: np.ndarray, units: dict[str, int]) -> np.ndarray:
    return grams_of(counts * np.array([[units.get(lang, UNIT) / UNIT] for lang in LANGS]))


def counted(langs: list[str], questions: list[str | None], answers: list[str | None], units: dict[str, int]) -> np.ndarray:
    """Counts of trigrams of questions and of answers by language, then of n-grams of answers in units, one after another."""
    asked, given = (_by_language(langs, texts) for texts in ([asked_for(q) for q in questions], answers))
    parts = [counted_grams(texts.get(lang, [])) for texts in (asked, given) for lang in LANGS]
    return np.concatenate([*parts, _weighed(langs, answers, units)])


def found_counts(langs: list[str], answers: list[str | None], odds: np.ndarray, units: dict[str, int]) -> np.ndarray:
    """Counts in units of n-grams of the answers that odds show to be of each of the classes of ``declining``, one after another."""
    of = declining.classes(declining.class_scores([a if a and a.strip() else "" for a in answers], odds))
    own = ([k for k, c in enumerate(of) if c == n + 1] for n in range(len(declining.CLASSES)))
    return np.concatenate([_weighed([langs[k] for k in rows], [answers[k] for k in rows], units) for rows in own])


def _split(counts: np.ndarray, units: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Models of prompts and answers, and counts of the n-grams of answers, from ``counted``."""
    size = len(LANGS) << NB_BITS
    prompts, grams = (_grams(part.reshape(len(LANGS), -1), units) for part in (counts[:size], counts[size : 2 * size]))
    return prompts, grams, counts[2 * size :] / UNIT


def fit(rows: list[tuple[str, str | None, str | None]]) -> Models:
    """Models from (language, question, answer) rows."""
    langs, questions, answers = ([r[k] for r in rows] for k in range(3))
    units = weights({lang: langs.count(lang) for lang in set(langs)})
    prompts, grams, content = _split(counted(langs, questions, answers, units), units)
    found = found_counts(langs, answers, declining.fit(content), units) / UNIT
    ends = endings.merged([(*of(texts), units[lang] / UNIT) for lang, texts in _by_language(langs, answers).items() for of in (endings.counted, endings.own_ends)])
    return Models(prompts, grams, declining.fit(content, found.reshape(len(declining.CLASSES), -1)), ends)


def other_language(asked: np.ndarray, given: np.ndarray, length: int) -> bool:
    """Whether the posteriors of prompt and response put them in different languages."""
    a, q = int(given.argmax()), int(asked.argmax())
    if a == q:
        return False
    gap = given[a] - given[q]
    return bool(gap >= LEAST_ANSWER and gap >= LEAST_RATE * length and asked[q] - asked[a] >= LEAST_QUESTION)


def judged(questions: list[str | None], answers: list[str | None], models: Models) -> list[str | None]:
    """The defect of each pair as ``defects`` gives it, but for truncation."""
    asked = language_scores([asked_for(q) for q in questions], models.prompts)
    given = language_scores([a or "" for a in answers], models.grams)
    said = declining.classes(declining.class_scores([without_names(q, a) if a else "" for q, a in zip(questions, answers, strict=True)], models.odds))
    out: list[str | None] = []
    for k, (question, answer) in enumerate(zip(questions, answers, strict=True)):
        if not answer or not has_letters(answer):
            out.append("empty")
        elif is_copied(question, answer):
            out.append("copied")
        elif said[k]:
            out.append("refusal" if said[k] == 1 else "empty")
        elif question and question.strip() and other_language(asked[k], given[k], len(answer)):
            out.append("language")
        else:
            out.append(None)
    return out


def defects(questions: list[str | None], answers: list[str | None], models: Models) -> list[str | None]:
    """The defect of each pair, or None: empty, copied, refusal, language or truncated, the first that holds."""
    return [defect or ("truncated" if endings.breaks_off(answer, models.ends) else None) for defect, answer in zip(judged(questions, answers, models), answers, strict=True)]


_COUNTS = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("ends", pa.int64()), ("places", pa.int64()), ("keys", pa.list_(pa.int64())), ("part", pa.int32()), ("data", pa.binary())])
_COUNTS_DDL = "lang string, key long, ends long, places long, keys array<long>, part int, data binary"


def _batch(size: int, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _COUNTS], schema=_COUNTS)


def _sent(counts: np.ndarray) -> pa.RecordBatch:
    """The parts of an array that aren't all 0."""
    parts = [(k, counts[low : low + PART]) for k, low in enumerate(range(0, len(counts), PART))]
    parts = [(k, zlib.compress(part.tobytes(), 1)) for k, part in parts if part.any()]
    return _batch(len(parts), part=[k for k, _ in parts], data=[data for _, data in parts])


def _received(counts: DataFrame, size: int) -> np.ndarray:
    """The sum of the arrays that the tasks sent; parts are summed in tasks, so that the driver gets each once."""

    def total(rows: pa.Table) -> pa.Table:
        out = np.zeros(PART, dtype=np.int64)
        for data in rows.column("data"):
            part = np.frombuffer(zlib.decompress(data.as_py()), dtype=np.int64)
            out[: len(part)] += part
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "data": [zlib.compress(out.tobytes(), 1)]})

    out = np.zeros(-(-size // PART) * PART, dtype=np.int64)
    for row in counts.where("part is not null").select("part", "data").groupBy("part").applyInArrow(total, "part int, data binary").collect():
        out[row.part * PART : (row.part + 1) * PART] = np.frombuffer(zlib.decompress(bytes(row.data)), dtype=np.int64)
    return out[:size]


def _signed(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.int64)


def _first_scan(units: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (lang, question, answer): arrays of ``counted``, and the chains of the answers' ends with how many answers and closed answers of a language have each."""

    def send(held: dict[tuple[str, int], list]) -> pa.RecordBatch:
        return _batch(len(held), lang=[lang for lang, _ in held], key=[chain for _, chain in held], keys=[own[0] for own in held.values()], places=[own[1] for own in held.values()], ends=[own[2] for own in held.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            langs, questions, answers = (batch.column(k).to_pylist() for k in range(3))
            part = counted(langs, questions, answers, units)
            sums = part if sums is None else sums + part
            keys, whole = endings.chains([a or "" for a in answers])
            for lang, answer, chain, row in zip(langs, answers, _signed(whole).tolist(), _signed(keys), strict=True):
                if chain:
                    own = held.get((lang, chain))
                    if own is None:
                        own = held[lang, chain] = [row.tolist(), 0, 0]
                    own[1] += 1
                    own[2] += endings.closed(answer)
            if len(held) > HELD:
                yield send(held)
                held = {}
        if sums is not None:
            yield _sent(sums)
            yield send(held)

    return run


def _second_scan(units: dict[str, int], odds, wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Of (lang, question, answer): arrays of ``found_counts``, and the units of each wanted context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        bits = wanted.value
        last = np.uint64(len(bits) * 8 - 1)

        def is_wanted(keys: np.ndarray) -> np.ndarray:
            at = (keys & last).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        def send(lang: str, keys: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            return _batch(len(keys), lang=[lang] * len(keys), key=_signed(keys), ends=of[:, 0], places=of[:, 1])

        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, answers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            own = found_counts(langs, answers, odds.value, units)
            sums = own if sums is None else sums + own
            for lang, texts in _by_language(langs, answers).items():
                held[lang] = endings.joined([endings.counted(texts, is_wanted), *([held[lang]] if lang in held else [])])
                if len(held[lang][0]) > HELD:
                    yield send(lang, *held.pop(lang))
        if sums is not None:
            yield _sent(sums)
        for lang, (keys, of) in held.items():
            yield send(lang, keys, of)

    return run


def _map(chains: DataFrame) -> np.ndarray:
    """A bitmap of the contexts of ends: 16 bits for each, at most MAP_BITS, beyond which it lets more others pass."""
    keys = chains.select(F.explode("keys").alias("k")).distinct()
    bits = 1 << max(15, min(MAP_BITS, 16 * max(1, keys.count())).bit_length() - 1)
    place = F.col("k").bitwiseAND(F.lit(bits - 1))
    maps = keys.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place % 32768).alias("map"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in maps.collect():
        out[row.bucket * 4096 : (row.bucket + 1) * 4096] = np.frombuffer(bytes(row.map), dtype=np.uint8)
    return out


def _breaking(first: DataFrame, chains: DataFrame, second: DataFrame, units: dict[str, int]) -> DataFrame:
    """The chains (chain) whose contexts are no end of a text, by the counts of both scans; as ``endings.breaks_off``."""
    own = first.where("keys is not null").select("lang", "ends", "places", F.posexplode("keys").alias("level", "k"))
    number = F.when(F.col("level") < endings.FIRST, F.col("places")).otherwise(F.col("ends")) * F.lit(endings.UNIT)
    counts = union_all(second.where("key is not null").select("lang", F.col("key").alias("k"), "ends", "places"), own.select("lang", "k", number.alias("ends"), number.alias("places")))
    sums = counts.groupBy("lang", "k").agg(F.sum("ends").alias("ends"), F.sum("places").alias("places"))
    weight = F.create_map(*(F.lit(x) for lang, own in units.items() for x in (lang, own / UNIT / endings.UNIT)))[F.col("lang")] if units else F.lit(1.0)
    weights = sums.groupBy("k").agg(F.sum(F.col("ends") * weight).alias("ends"), F.sum(F.col("places") * weight).alias("places"))
    levels = chains.select("chain", F.posexplode("keys").alias("level", "k")).join(weights, "k")
    known = levels.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("level", "ends", "places"))).alias("known"))
    value = F.aggregate("known", F.lit(endings.LEAST), lambda v, c: (c["ends"] + endings.SMOOTH * v) / (c["places"] + endings.SMOOTH))
    return known.where(value < endings.LEAST).select("chain")


def broken_pairs(df: DataFrame, id_col: str, question_col: str, answer_col: str, lang_col: str) -> DataFrame:
    """(id, defect) of each defective pair: empty, copied, refusal, language or truncated, the first that holds.

    A null or blank question has no language and is not copied; a null id is kept; repeated rows give repeated
    results; without rows of a known declared language no language is told from another. Other columns are not
    read. Texts are read three times: once for the counts of n-grams and the contexts of ends, once for the counts of these
    contexts and of the answers that seeds show, once to judge each row. No text is shuffled: only sums, contexts and ids.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind, context = df.schema[id_col].dataType, df.sparkSession.sparkContext
    lean = df.select(F.col(id_col).alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"), clean_lang(F.col(lang_col)).alias("lang"))
    units = weights({r["lang"]: r["count"] for r in lean.groupBy("lang").count().collect()})
    texts = lean.select("lang", "question", "answer")

    first = settle(texts.mapInArrow(_first_scan(units), _COUNTS_DDL))
    prompts, grams, content = _split(_received(first, (2 * len(LANGS) << NB_BITS) + (2 << declining.BITS)), units)
    chains = first.where("keys is not null").groupBy(F.col("key").alias("chain")).agg(F.first("keys").alias("keys"))
    odds, wanted = context.broadcast(declining.fit(content)), context.broadcast(_map(chains))
    second = settle(texts.mapInArrow(_second_scan(units, odds, wanted), _COUNTS_DDL))
    found = _received(second, len(declining.CLASSES) * (2 << declining.BITS)) / UNIT
    breaking = settle(_breaking(first, chains, second, units))
    models = context.broadcast(Models(prompts, grams, declining.fit(content, found.reshape(len(declining.CLASSES), -1)), None))
    schema = pa.schema([("id", to_arrow_type(kind)), ("defect", pa.string()), ("chain", pa.int64())])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        questions, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = judged(questions, answers, models.value)
        _, chain = endings.chains([a if not defect else "" for a, defect in zip(answers, found, strict=True)])
        yield {"id": batch.column(0).to_pylist(), "defect": found, "chain": _signed(chain)}

    rows = lean.select("id", "question", "answer").mapInArrow(arrow_rows(make, schema), f"id {kind.simpleString()}, defect string, chain long")
    ends = breaking.withColumn("breaks", F.lit("truncated"))
    return rows.join(ends, "chain", "left").select(F.col("id").alias(id_col), F.coalesce("defect", "breaks").alias("defect")).where("defect is not null")
