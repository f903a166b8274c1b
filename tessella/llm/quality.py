"""Problem 9: text statistics of each document, and the kind of those that are mostly not natural prose.

Statistics count words, symbols, line ends, common words and repetition. The kind comes from combined rules: line patterns say how
many characters look like prose, items, cells or junk; the statistics then take from what looks like prose: repeated lines, paragraphs
and n-grams become junk, prose with hardly a common word and no ended lines or full of symbols counts less, stock lines and lines repeated through the document
are boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows
from tessella.llm.shingles import mixed, steps, word_hashes, word_spans

# Frequent function words of the languages written with spaces.
COMMON_WORDS = frozenset(
    "the of and in a to is that for with or not as by from at be are it "
    "el la los las de en y un una por con del se que no "
    "le les et des du au dans est pour qui ne "
    "der die das und den von mit im ist bei ein eine nicht auf "
    "и в на не с при у что из по для "
    "और में के है का की से पर को "
    "في من على إلى لا أو عن مع".split()
)
#: Frequent function characters and syllables of scripts without spaces.
COMMON_SIGNS = re.compile("[的了在是会の、をはがにで]|ที่|และ|มัก|ให้|เป็น|จาก|ใน|ได้|ไม่")

_STOPPED, _CLOSED = frozenset(".!?。！？।؟…:"), "\"'”’»)]」』"
_STOPS = re.compile(r"[.!?।؟…][\"'”’»)\]]*(?=\s|$)|[。！？]")
_BULLET = re.compile(r"(?:[-*•·‣▪◦–—+]|\[[ xX]?\]|\[\d+\]|\(?\d{1,3}[.)\]]|\(?[a-zA-Z][.)])\s+(?=\S)")
_DASH = re.compile(r"[-–—]\s")
_CELL_TAG = re.compile(r"</?t(?:able|r|d|h|body|head)\b", re.I)
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|\{\{.*?\}\}|&#?\w+;|function\s*\([^)]*\)\s*\{[^}]*\}|\{[^{}]*[:=][^{}]*\}")
_LOG = re.compile(r"\d\d:\d\d:\d\d\S*\s.*(?:\[[A-Z]+\]|\b(?:DEBUG|INFO|WARN|ERROR|TRACE)\b|0x[0-9a-f]{4,})|0x[0-9a-f]{6,}.*[{=]")
_CELL = re.compile(r"[<>≤≥]?\d[\d.,/]*%?|n/a|\+/-|±|-|–|%")
_MOJIBAKE = re.compile(r"[\x80-\x9f]|[ÃÂÐÑØÙàáâãäåæçèé][\xa0-\xbf]")
_SYMBOLS = re.compile("[←-⏿─-➿⬀-⯿\U0001f000-\U0001faff]")
_BROKEN = re.compile(r"\S*(?:[^\W\d_][#$~°|¤¿�§¬^\\?]+[^\W_]|[#$~°|¤¿�§¬^\\][^\W\d_]|[^\W\d_][#$~°|¤¿�§¬^\\]|[^\W\d_]\d[^\W\d_])\S*")
_BLANK_LINE = re.compile(r"\n\s*\n")
_SIGNS = re.compile(r"[^\w\s]|_")
_ODD = re.compile(r"[#$~°|¤¿�§¬^\\]|\?\w|[^\W\d_]\d[^\W\d_]")
_LONG_ASCII = re.compile(r"[!-~]{40,}")
_GAP = re.compile(r"\s*\t\s*| {2,}")
_DELIMITED = re.compile(r"(?:(?<=[^\s\d])[;,](?=\S))|(?:(?<=\S)[;,](?=[^\s\d]))|;(?=;)|(?<=\d);(?=\d)")
_NAME_VALUE = re.compile(r"[^:=.!?。]{1,48}?\s?[:=：]\s*[^.!?。]?(?:[^!?。]){0,60}$")
_ITEMS = re.compile(r"\s*[,;/|•·、，；]\s+|[、，；]|\s+[-–—•·]\s+")
_REFERENCE = re.compile(r"\b\d{1,4}\s?(?:\(\d{1,3}\))?\s?[:;,]\s?(?:e|pp?\.\s?)?\d{1,5}\s?[-–]\s?\d{1,5}\b|\bet al\b|\bdoi:|\b10\.\d{4,}/", re.I)
_MAYBE_REFERENCE = re.compile(r"\d\s?[-–]\s?\d|et al|doi:|10\.\d{4}", re.I)
_AUTHORS = re.compile(r"[^\W\d_][\w'’-]+,? (?:[^\W\d_]{1,3}\.?[ -]?){1,3}(?:[,;.&]| and )")

PROSE, LIST, TABLE, JUNK, BOILERPLATE = "prose", "list", "table", "junk", "boilerplate"


def is_ended(line: str) -> bool:
    """Whether a line ends with a stop or colon, closing marks after it or not."""
    return line.rstrip(_CLOSED)[-1:] in _STOPPED


def is_junk(text: str) -> bool:
    """Whether a stretch of text is not readable as language."""
    solid = len(text) - text.count(" ") - text.count("\t")
    if not solid:
        return False
    if (":" in text or "0x" in text) and _LOG.search(text):
        return True
    if "<" in text and _CELL_TAG.search(text):
        return False
    if not text.isascii() and (sum(len(m) for m in _MOJIBAKE.findall(text)) > 0.1 * solid or len(_SYMBOLS.findall(text)) > 0.3 * solid):
        return True
    if ("<" in text or "{" in text or "&" in text) and sum(len(m) for m in _MARKUP.findall(text)) > 0.4 * solid:
        return True
    tokens = text.split()
    longest = max(map(len, tokens))
    if longest >= 40 and sum(len(m) for m in _LONG_ASCII.findall(text) if "://" not in m) > 0.5 * solid:
        return True
    if solid >= 12 and solid - len(_SIGNS.findall(text)) < 0.35 * solid and "|" not in text and not any(_CELL.fullmatch(t) for t in tokens):
        return True
    if not _ODD.search(text):
        return False
    # words of scripts without spaces come as overlong tokens, which say nothing of single words
    broken = [t for t in tokens if 2 < len(t) <= 30 and ("�" in t or _BROKEN.fullmatch(t) and not t.isalnum() and not t.startswith("°"))]
    return len(tokens) > 5 and len(broken) > 0.18 * len(tokens) and sum(map(len, broken)) > 0.12 * solid


def is_table(line: str) -> bool:
    """Whether a line is a row of cells or of a name with its value."""
    if "<" in line and _CELL_TAG.search(line):
        return True
    if line.count("|") >= 2 and (line[0] == "|" or " | " in line or not re.search("[°~¤�]", line) and max(map(len, line.split("|"))) <= 60):
        return True
    cells = [c for c in _GAP.split(line.strip()) if c] if "\t" in line or "  " in line else []
    if len(cells) > 1 and ("\t" in line.strip() or len(cells) > 2 or "    " in line.strip()) and max(map(len, cells)) <= 60 and not any(_STOPS.search(c[:-1]) for c in cells):
        return True
    if is_ended(line) and not line.endswith(":"):
        return False
    if (";" in line or "," in line) and len(_DELIMITED.findall(line)) >= 2 and not re.search(r"[.!?] ", line):
        return True
    item = _BULLET.sub("", line.strip(), count=1)
    tokens = item.split()
    least = 2 if len(item) < len(line.strip()) else 1
    if len(tokens) >= 2 and sum(1 for t in tokens if _CELL.fullmatch(t)) >= max(least, 0.22 * len(tokens)) and not re.search(r"[^\W\d][.!?।؟] ", line):
        return True
    return len(line) < 100 and (":" in line or "=" in line or "：" in line) and bool(_NAME_VALUE.match(line)) and not _STOPS.search(line)


def is_list(line: str) -> bool:
    """Whether a line is an item of a list, or several items one after another."""
    if _BULLET.match(line):
        spoken = _DASH.match(line) and is_ended(line) and (len(line.split()) >= 6 or len(line) > 40)
        return not spoken
    references = len(_REFERENCE.findall(line)) if ("-" in line or "–" in line or "et al" in line or "doi:" in line or "10." in line) and _MAYBE_REFERENCE.search(line) else 0
    if references and _AUTHORS.match(line) or references >= 2 and references * 160 >= len(line):
        return True
    if line[-1] in "。！？!?।؟" or sum(map(line.count, ",;/|•·、，；-–—")) < 4 or _STOPS.search(line[:-1]):
        return False
    parts = [p for p in _ITEMS.split(line) if p.strip()]
    if len(parts) >= 5:
        return max(sorted(map(len, parts))[: max(1, len(parts) * 9 // 10)]) <= 48
    return False


def is_prose_block(lines: list[str]) -> bool:
    """Whether lines without marks, taken together, read as sentences."""
    text = " ".join(lines)
    stops = len(_STOPS.findall(text))
    if len(lines) == 1:
        return stops > 0 or len(text) > 60 or len(text.split()) > 5 or len(COMMON_SIGNS.findall(text)) * 25 >= len(text)
    if stops * 260 >= len(text):
        return True
    thai = len(re.findall("[\u0e00-\u0e7f]", text))
    if thai > 0.4 * len(text):
        return len(COMMON_SIGNS.findall(text)) * 40 >= len(text)
    return False


#: Begins the rest of a divided line, so that its first word isn't taken for the mark of an item.
_ON = "\u2060"


def _units(text: str) -> list[str]:
    """Lines; very long ones in stretches."""
    out = []
    for line in text.splitlines():
        line = line.strip("  　")
        while len(line) > 900:
            cut = line.rfind(" ", 300, 600)
            cut = cut if cut > 0 else 600
            out.append(line[:cut])
            line = _ON + line[cut:].strip()
        if line.strip():
            out.append(line)
    return out


#: Stock phrases of pages around their texts, in lower case.
_STOCK = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie|copyright|© ?\d{4}|subscribe|newsletter|sign (?:in|up)|log ?in\b|share (?:this|on)|follow us|back to top|skip to|click here|read more|contact us|about us|site ?map|advertis"
    r"|política de privacidad|derechos reservados|suscríb|mentions légales|tous droits|s['’]abonner|datenschutz|impressum|alle rechte|anmelden|политика конфиденциальности|все права|подпис|版权所有|隐私|登录|订阅|利用規約|プライバシー|ログイン"
)


def line_shares(text: str) -> dict[str, float]:
    """Shares of a text's characters that look like prose, list, table and junk by their lines; and those of prose lines and paragraphs seen before in it (``again``) and of stock lines (``stock``)."""
    weights: Counter[str] = Counter()
    block: list[str] = []
    last = ""
    seen: set[str] = set()
    lines = _units(text)

    def settle_block() -> None:
        nonlocal last
        if block:
            size = sum(map(len, block))
            if is_prose_block(block):
                weights[PROSE] += size
                last = PROSE
                for line in block:
                    if line in seen:
                        weights["again"] += len(line)
                    seen.add(line)
            else:
                kind = last if last in (TABLE, JUNK) and len(block) < 3 else LIST
                weights[kind] += size
            block.clear()

    for line in lines:
        stripped = line.strip()
        kind = TABLE if stripped[0] == "|" and stripped[-1] == "|" and stripped.count("|") > 2 and not re.search("[°~�]", stripped) else JUNK if is_junk(stripped) else TABLE if is_table(line) else LIST if is_list(stripped) else ""
        if kind != JUNK and len(lines) > 1 and _STOCK.search(stripped.lower()) and not _STOPS.search(stripped[:-1]):
            weights["stock"] += len(stripped)
        if not kind:
            block.append(stripped)
            continue
        if block and kind == TABLE and len(block[-1]) < 80 and not is_ended(block[-1]) and (len(block) == 1 or is_ended(block[-2])):
            weights[TABLE] += len(block.pop())  # a head line
        settle_block()
        weights[kind] += len(stripped)
        last = kind
    settle_block()
    total = sum(weights[kind] for kind in (PROSE, LIST, TABLE, JUNK))
    return {kind: weights[kind] / total if total else 0.0 for kind in (PROSE, LIST, TABLE, JUNK, "again", "stock")}


#: Words from which on statistics say something of a text; shares of n-grams and of lines from which on it is repetitive.
LEAST_WORDS, REPEATED = 12, 0.4
#: Common words and distinct words natural prose has at least; symbols it has at most, as shares; what lacking them takes from prose.
LEAST_COMMON, LEAST_DISTINCT, MOST_SYMBOLS, LACKING = 0.04, 0.08, 0.4, 0.7
#: Mean length of words in letters from which on a text isn't written with spaces.
LONG_WORDS = 7.5


def kind_of(text: str, facts: tuple | None = None) -> str:
    """prose, list, table, junk or boilerplate: what most of a text is, by its lines and its statistics."""
    facts = statistics([text])[0] if facts is None else facts
    n_words, length, symbols, ended, common, same_lines, same_paragraphs, top_ngram, distinct = facts
    shares = line_shares(text)
    prose, junk = shares[PROSE], shares[JUNK]
    if n_words >= LEAST_WORDS:
        # a few words over and over, whatever the lines look like
        if top_ngram > REPEATED or distinct < LEAST_DISTINCT:
            return JUNK
        # prose lines said before, if lines or paragraphs as a whole are repeated, are junk
        again = min(prose, shares["again"]) if max(same_lines, same_paragraphs) > REPEATED else 0.0
        prose, junk = prose - again, junk + again
        # without common words and without ended lines, or full of symbols, what looks like prose counts less
        spaced = length < LONG_WORDS  # else a script without spaces, whose common words aren't seen
        lack = (1.0 - min(1.0, common / LEAST_COMMON)) * (1.0 - ended) if spaced else 0.0
        lack = max(lack, min(1.0, max(0.0, symbols - MOST_SYMBOLS) * 5.0))
        taken = LACKING * lack * prose
        prose, junk = prose - taken, junk + taken
    if shares["stock"] > 0.5:
        return BOILERPLATE
    rest = {LIST: shares[LIST], TABLE: shares[TABLE], JUNK: junk}
    if not any(rest.values()) or prose * 2 >= prose + sum(rest.values()):
        return PROSE
    return max(rest, key=rest.get)


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    return np.sort(word_hashes(sorted(COMMON_WORDS))[0])


def _word_statistics(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of each text: words, letters of words, common words, distinct words, and the largest share of letters in a run of two to four words that occurs more than twice."""
    hashes, lengths, bounds = word_spans(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    letters = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
    common = _common_hashes()
    places = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    often = np.bincount(owner, weights=common[places] == hashes, minlength=len(texts)).astype(np.int64)
    mark = owner.astype(np.uint64) << np.uint64(48)
    distinct = np.bincount((np.unique(mark | (hashes >> np.uint64(16))) >> np.uint64(48)).astype(np.int64), minlength=len(texts))
    share = np.zeros(len(texts))
    runs, size = hashes, lengths
    for more in (1, 2, 3):
        if len(runs) < 2:
            break
        runs, size = mixed(runs[:-1] * np.uint64(3) + hashes[more:]), size[:-1] + lengths[more:]
        whole = owner[: len(runs)] == owner[more:]
        keys, first, times = np.unique(mark[: len(runs)][whole] | (runs[whole] >> np.uint64(16)), return_index=True, return_counts=True)
        again = times > 2
        if not again.any():
            break  # longer runs are no more frequent than those within them
        of = (keys[again] >> np.uint64(48)).astype(np.int64)
        np.maximum.at(share, of, times[again] * size[whole][first[again]] / np.maximum(letters[of], 1))
    share[counts < 8] = 0.0
    return counts, letters, often, distinct, np.minimum(share, 1.0)


def statistics(texts: list[str]) -> list[tuple]:
    """The statistics of each text, in the order of STATISTICS, without its kind. At most 65,536 texts."""
    out = []
    for low, high in steps(texts):
        part = texts[low:high]
        for text, count, letters, common, distinct, share in zip(part, *(x.tolist() for x in _word_statistics(part)), strict=True):
            lines = [line for line in map(str.strip, text.splitlines()) if line]
            paragraphs = [p.strip() for p in _BLANK_LINE.split(text) if p.strip()] if "\n" in text else lines
            solid = len(text) - sum(map(text.count, (" ", "\n", "\t")))
            out.append((
                count,
                letters / count if count else 0.0,
                1.0 - letters / solid if solid > 0 else 0.0,
                sum(1 for line in lines if is_ended(line)) / len(lines) if lines else 0.0,
                common / count if count else 0.0,
                1.0 - len(set(lines)) / len(lines) if lines else 0.0,
                1.0 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
                share,
                distinct / count if count else 0.0,
            ))
    return out


STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", "duplicate_line_share", "duplicate_paragraph_share", "top_ngram_share", "distinct_word_share")
def text_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, the STATISTICS, kind) of each row; kind is ``prose``, ``list``, ``table``, ``junk`` or ``boilerplate``.

    Null, empty and blank texts have zeros and a null kind; a null id is kept; repeated rows give
    repeated results; other columns are not read. Each row stands alone: no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), *((n, pa.float64()) for n in STATISTICS[1:]), ("kind", pa.string())])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        texts = batch.column(1).to_pylist()
        rows = [(0, *[0.0] * (len(STATISTICS) - 1), None)] * len(texts)
        filled = [k for k, text in enumerate(texts) if text and text.strip()]
        for low in range(0, len(filled), 10_000):
            part = filled[low : low + 10_000]
            for k, facts in zip(part, statistics([texts[k] for k in part]), strict=True):
                rows[k] = (*facts, kind_of(texts[k], facts))
        columns = list(zip(*rows, strict=True))
        yield {"id": batch.column(0)} | {name: list(c) for name, c in zip((*STATISTICS, "kind"), columns, strict=True)}

    lean = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"id {kind.simpleString()}, n_words long, " + ", ".join(f"{n} double" for n in STATISTICS[1:]) + ", kind string"
    return lean.mapInArrow(arrow_rows(make, schema), ddl).withColumnRenamed("id", id_col)
