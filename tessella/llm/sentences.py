"""Problem 6: sentence boundaries by semi-Markov dynamic programming over whole spans.

Candidate cuts are found by one pattern. Each span between two candidates is scored as a whole: how it opens and closes, whether
quotations and brackets are whole in it, whether a question or exclamation that it opens is closed in it, and how usual its length is
in its script. The best sequence of spans wins, so that a cut that looks good by itself falls if the spans it makes are bad, and a weak
one stands if they are good. All spans are considered; those a bound shows to lose are not scored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows

#: What a span loses for a quotation or bracket that isn't whole in it; half of that where the quotation has HALF characters.
BROKEN, HALF = 8.0, 3000
#: What a span loses for a question or exclamation that it opens and doesn't close.
UNANSWERED = 7.0
#: Usual length of a sentence in characters, in scripts with and without spaces, and what a factor of e beyond it costs, squared.
USUAL, USUAL_DENSE, STRETCH = 85.0, 40.0, 0.12

_CLOSE = "\"'”’“»)\\]」』）】》"
_DOTS, _FULL = ".!?…؟", "。！？｡।॥۔"
# Patterns begin with one class, so that other characters are passed fast, and a run of marks is taken whole, so that none is tried in parts.
_MARKED = (
    rf"(?<=[{_DOTS}])[{_DOTS}]*+[{_CLOSE}]*(?:[{_DOTS}]++[{_CLOSE}]*)*(?:[   ]»)?(?:\s+|(?=[^\W\d_])|(?=[\"“„«(¿¡\[])|$)"
    rf"|(?<=[{_FULL}])[{_FULL}]*+[{_CLOSE}]*(?:[{_FULL}]++[{_CLOSE}]*)*\s*"
)
#: Without Thai characters white space is a candidate only by a line break; what stands before the break belongs to it.
_CANDIDATE = re.compile(rf"[{_DOTS}{_FULL}\n](?:{_MARKED}|(?<=\n)\s*)")
_THAI_CANDIDATE = re.compile(rf"[{_DOTS}{_FULL}\s](?:{_MARKED}|(?<=[฀-๿]\s)\s*(?=[฀-๿])|(?<=\n)\s*|(?<=[^\S\n])[^\S\n]*+\n\s*)")
_THAI = re.compile("[฀-๿]")
_TOKEN = re.compile(r"[^\s\"'“”„«»(\[（「]*$")
_BREAK = re.compile(r"[\s\"'“”„«»(\[（「]")

# Abbreviations after which a sentence goes on, in lower case and without their last full stop.
ABBREVIATIONS = frozenset(
    "e.g i.e cf vs viz approx est fig figs suppl sect dr prof mr mrs ms st mt rev gen col sgt capt "
    "sra sr srta dra dña ud uds pág págs ej ed éd vol cap núm art mme mlle pr ex env av bd "
    "bzw vgl ca z.b z d.h u.a i.d hr fr nr dipl ing abs "
    "г гг т.е т см им ул рис стр д проф акад напр руб тыс млн "
    "डॉ क्र मि.ग्रा मि ग्रा सं श्री प्रो मिली किग्रा "
    "د أ ص م ج رقم "
    "มก ดร นพ พญ กก มล".split()
)
#: Abbreviations that belong to a number after them.
BEFORE_NUMBERS = frozenset("no nos nr n p pp s pág fig figs suppl sect ch vol art núm abb tab st № с т стр ch kap ref".split())
#: Abbreviations that may end a sentence: it ends where the next word opens one.
MAY_END = frozenset("etc usw a.m p.m f ff al jr inc co ltd u.s и.др т.д т.п п др др. г.г".split())
#: Words before a single capital letter that isn't an initial.
BEFORE_LETTERS = frozenset("vitamin vitamine vitamina vitamins type typ tipo hepatitis hépatite group groupe gruppe grupo grade stage factor class plan stadium stade".split())

_MARKS = re.compile(r"[()\[\]（）「」『』«»„“”\"《》【】\n](?:(?<!\n)|\s*\n)")
_LETTERS_STOPPED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_ABBREVIATED = ABBREVIATIONS | BEFORE_NUMBERS | MAY_END
_DENSE = re.compile("[぀-ヿ㐀-鿿฀-๿]+")
_OPEN_PAIRS = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "«": "»", "„": "“", "“": "”", "《": "》", "【": "】"}


def enclosed(text: str) -> list[tuple[int, int, float]]:
    """Begin, end (after the closing mark) and weight of quotations and brackets; a mark without its partner in the paragraph counts for nothing.

    The weight falls with the length, as two far marks are hardly partners.
    """
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[str, int]] = []
    for found in _MARKS.finditer(text):
        mark, at = found.group(), found.start()
        if mark[0] == "\n":
            stack.clear()
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == mark or (stack[k][0] == "“" and mark == "“"):
                length = at - stack[k][1]
                out.append((stack[k][1], at + 1, BROKEN / (1.0 + (length / HALF) ** 2)))
                del stack[k:]
                break
        else:
            if mark == "\"":
                stack.append(("\"", at))
            elif mark in _OPEN_PAIRS:
                stack.append((_OPEN_PAIRS[mark], at))
    return out


def _opening(text: str, at: int) -> float:
    """How well a sentence opens at a character."""
    char = text[at]
    k = at
    while k < len(text) - 1 and text[k] in "\"'“„«([（「『¿¡»‹ " :
        k += 1
    word = text[k]
    if char in "»”’)]」』）,;:、，；，":
        return -6.0
    if word.isupper() or word.istitle():
        return 2.0
    if word.islower():
        if text[k + 1 : k + 2].isupper():
            return 1.5  # as in "pH"
        return -5.0 if char not in "¿¡" else 1.0
    if word.isdigit():
        return 0.8
    if word.isalpha():  # scripts without case
        return 1.0
    return 0.5 if char in "-–—•*·" else 0.0


def _closing(text: str, start: int, end: int, opens: str) -> float:
    """How well a sentence closes with text[start:end], the candidate's marks without white space; opens: the next character that is no mark, or ''."""
    marks = text[start:end]
    if marks == ".":
        return _stopped(text, start, opens)
    if not marks:
        return 0.0
    if marks[0] in "。！？｡।॥۔":
        return 3.0 if marks[-1] not in "”」』’»\"" or not opens else -3.0
    if any(c in "!?؟" for c in marks):
        return 3.0 if marks[-1] not in "”」』" or not ("぀" <= opens <= "鿿") else -3.0
    if "..." in marks or "…" in marks:
        return 1.2
    if len(marks) > 1 and marks[0] == "." and marks[1:2] not in ("\"", "'", "”", "“", "»", "") and "." in marks[1:]:
        return 3.0  # as in "ff.)."
    return _stopped(text, start, opens)


def _stopped(text: str, start: int, opens: str) -> float:
    """``_closing`` of a full stop."""
    if text[start - 1 : start] == "\n":
        token = _TOKEN.search(text, max(0, start - 40), start)
        word = token.group() if token else ""
    else:
        window = text[max(0, start - 40) : start]
        word = "" if not window or window[-1].isspace() else window.rsplit(None, 1)[-1]
        if word.isalpha():
            if len(word) > 1 and word.isascii() and word.lower() not in _ABBREVIATED:
                return 3.0
        else:
            word = _BREAK.split(word)[-1]
    low = word.lower().lstrip("¿¡-–—")
    if low in MAY_END:
        return 1.5
    if low in BEFORE_NUMBERS and opens.isdigit():
        return -6.0
    if low in ABBREVIATIONS:
        return -6.0
    if low in BEFORE_NUMBERS and low != "no":
        return -4.0
    if len(word) == 1 and word.isalpha():
        if word.isupper() or not word.islower():
            before = text[max(0, start - 24) : start - 1].split()
            return 3.0 if before and before[-1].lower().strip("(\"“„«") in BEFORE_LETTERS else -6.0
        return -4.0
    if "." in word and _LETTERS_STOPPED.fullmatch(word):
        return -2.5
    if word.isdigit() and len(word) <= 2 and opens.isupper():
        return _ordinal(text, start - len(word))
    if word and "ऀ" <= word[-1] <= "ॿ":
        return -3.0
    if word and "฀" <= word[-1] <= "๿":
        return -6.0
    return 3.0


def _ordinal(text: str, at: int) -> float:
    """A number of at most two digits and a full stop before a capital: an ordinal after these words, else an end."""
    before = text[max(0, at - 14) : at].split()
    # Words before ordinal numbers in German
    ordinal = {"am", "der", "die", "das", "dem", "den", "des", "vom", "zum", "im", "beim", "ab", "bis", "seit"}
    return -6.0 if not before or before[-1].lower().strip("(„\"") in ordinal else 2.0


def boundaries(text: str) -> list[int]:
    """Offset of the first character of each sentence of a text."""
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if first >= last:
        return []
    starts, ends, closes, opens = [first], [first], [0.0], [0.0]
    thai = not text.isascii() and _THAI.search(text)
    for found in (_THAI_CANDIDATE if thai else _CANDIDATE).finditer(text, first, last):
        start, at = found.span()
        if at >= last or at <= starts[-1]:
            continue
        if text[start] == "\n":
            while text[start - 1].isspace():
                start -= 1
        raw = text[start:at]
        core = raw.rstrip()
        blank = raw[len(core) :]
        after = text[at]
        k = at
        while k < last - 1 and not text[k].isalnum():
            k += 1
        opening = 0.0
        if not core:
            if "\n" in blank:
                prior = text[start - 1]
                score = 4.0 if blank.count("\n") > 1 else 1.5 if _opening(text, at) > 0.4 and not prior.isalnum() and prior not in ",;、，" else -1.0
                if "฀" <= prior <= "๿" and "฀" <= after <= "๿":
                    score = 4.0
                elif blank.count("\n") == 1 and after in "-–—•*·" and blank:
                    score = 3.0
            else:
                score = 4.0  # white space alone between two Thai characters
        else:
            if not blank and core[-1] not in "。！？｡।॥۔" and core[0] not in "。！？｡।॥۔":
                # a full stop without white space: only between a word and a capital
                prior = text[start - 1 : start]
                if not (text[k].isupper() or text[k].isalpha() and not text[k].islower()) or not (prior.islower() or prior.isdigit() or prior in ")%”\"»" or prior.isalpha() and not prior.isupper()) or (len(core) == 1 and core == "." and prior.isdigit() and text[k].isdigit()):
                    continue
                if "." in text[at : at + 3] and text[at : at + 1].isupper():
                    continue
            opening = 2.0 if after.isupper() else min(_opening(text, at), 2.0)
            if core[0] in "。！？｡।॥۔" and after.isalnum():
                opening = max(opening, 0.0)
            score = _closing(text, start, start + len(core), text[k])
            if "\n" in blank and blank.count("\n") > 1:
                score += 4.0  # a new paragraph
        starts.append(at)
        ends.append(start + len(core))
        closes.append(score)
        opens.append(opening)
    if len(starts) == 1:
        return starts
    starts.append(last)
    ends.append(last)
    closes.append(0.0)
    return _best_spans(text, starts, ends, closes, opens)


def _best_spans(text: str, starts: list[int], ends: list[int], closes: list[float], opens: list[float]) -> list[int]:
    """The starts of the best sequence of spans; closes and opens: how well the span before and the one after each candidate end and begin there."""
    count = len(starts) - 1
    cut = [0.0] * (count + 1)  # weight of the quotations and brackets that go on at a candidate
    for low, high, weight in enclosed(text):
        for k in range(bisect_right(starts, low), bisect_left(starts, high)):
            cut[k] += weight
    cut[count] = 0.0
    # questions and exclamations opened less those closed, up to each candidate
    asked = [0] * (count + 1)
    if "¿" in text or "¡" in text:
        for k in range(count):
            part = text[starts[k] : starts[k + 1]]
            asked[k + 1] = part.count("¿") - part.count("?") + part.count("¡") - part.count("!")
        for k in range(count):
            asked[k + 1] += asked[k]
    usual = math.log(USUAL_DENSE if not text.isascii() and sum(map(len, _DENSE.findall(text))) * 3 > len(text) else USUAL)
    logs: dict[int, float] = {}
    best, origin = [0.0] * (count + 1), [0] * (count + 1)
    # the most that a span from a candidate or one before can bring
    reach = [0.0] * (count + 1)
    for k in range(1, count + 1):
        top, of, close, end, open_marks, turn = -math.inf, k - 1, closes[k], ends[k], cut[k], asked[k]
        for j in range(k - 1, -1, -1):
            if reach[j] + close <= top:
                break
            length = end - starts[j]
            penalty = logs.get(length)
            if penalty is None:
                penalty = logs[length] = STRETCH * (math.log(length) - usual) ** 2 if length > 0 else 4.0
            broken = cut[j] if cut[j] > open_marks else open_marks
            score = best[j] + opens[j] + close - penalty - broken
            if turn > asked[j]:
                score -= UNANSWERED
            if score > top:
                top, of = score, j
        best[k], origin[k] = top, of
        if k < count:
            reach[k] = max(reach[k - 1], top + opens[k])
    cuts = []
    k = count
    while k > 0:
        k = origin[k]
        cuts.append(starts[k])
    return cuts[::-1]


def sentence_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence_no, start_char, sentence) of each text, in order; sentences have no white space around them.

    Null, empty and blank texts give no row; a null id is kept; repeated rows give repeated units; other columns
    are not read. Rows are independent: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("sentence_no", pa.int32()), ("start_char", pa.int32()), ("sentence", pa.string())])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        ids, numbers, starts, texts = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cuts = boundaries(text) if text else []
            for number, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text or "")], strict=False)):
                ids.append(key)
                numbers.append(number)
                starts.append(a)
                texts.append(text[a:b].rstrip())
            if len(ids) > 50_000:
                yield {"id": ids, "sentence_no": numbers, "start_char": starts, "sentence": texts}
                ids, numbers, starts, texts = [], [], [], []
        yield {"id": ids, "sentence_no": numbers, "start_char": starts, "sentence": texts}

    lean = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return lean.mapInArrow(arrow_rows(make, schema), f"id {kind.simpleString()}, sentence_no int, start_char int, sentence string").withColumnRenamed("id", id_col)
