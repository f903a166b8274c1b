"""Whether a text breaks off: likelihood of its last characters as an end of text against any other place.

The model is an interpolated n-gram likelihood. Contexts go from the general to the special: what kind of line the text ends in and
the class of its last character, then an open bracket and, for short texts, their length, then the last 1, 2, 3, 4, 6 and 8 characters; each
level's estimate is smoothed by the one before. Ends are those of all texts and of their sentences, other places are all those
inside these sentences, some with a mark of omission added. Nothing else decides: without counts no text breaks off.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tessella.llm.common import code_points
from tessella.llm.quality import is_list, is_table
from tessella.llm.sentences import boundaries
from tessella.llm.shingles import mixed, steps

#: Lengths of the suffixes; weight of the level before in each estimate.
SUFFIXES, SMOOTH = (1, 2, 3, 4, 6, 8), 2.0
#: Total weight of the places within a sentence beside its end's, of each abbreviation's besides, and of the sentence's end without the closing mark and with a mark of omission.
CUT_WEIGHT, STOP_WEIGHT, UNMARKED, OMITTED = 1.0, 0.125, 0.005, 0.05
#: Weights are counted in whole units, so that sums don't depend on their order.
UNIT = 1 << 20
#: Texts whose last characters are an end with less than this probability break off.
LEAST = 0.5

_WRAP = "*_\"'”’“»«`> \t\r\n﻿​‌‍⁠\xa0"
_TERMINAL = ".!?。！？।॥؟۔｡"
_OPENERS, _CLOSERS = "([（「『【{<", ")]）」』】}>"
#: Marks of omission, those added to cuts first.
MARKS = ("...", "…", " (more)", " [...]", " […]")
_MARK = re.compile(r"\s*(?:\.{3,}|…+|[\[(](?:\.{2,}|…|more|cont(?:inued|\.|'d)?|cut|truncated|read more|mehr|suite|más|ещё|更多|続き)[\])]|read more|>>+|»»)\s*$", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S")
_WORD = re.compile(r"\w+")
_BULLET = re.compile(r"\s*(?:[-*•·‣▪◦–—+]|\[[ xX]?\]|\(?\d{1,3}[.)\]]|\(?[a-zA-Z][.)])\s+\S")
_CELL = re.compile(r"[<>≤≥]?\d[\d.,/]*%?|n/a|\+/-|±|rare|rares|raro|selten|редко|罕见|まれ|दुर्लभ|نادر")


#: Kinds of lines, and of last characters besides letters, whose kind goes by their script.
LINES = ("prose", "list", "cells", "item", "link", "row")
_KINDS = {"T": 1, "D": 2, "C": 3, "S": 4, "B": 5, "U": 6, "Lx": 7, "L": 8}
#: Levels of contexts, and those before the last characters.
FIRST, LEVELS = 2, 2 + len(SUFFIXES)


@dataclass
class Counts:
    """Hashes of contexts, in order, and of each the weight of ends and of all places."""

    keys: np.ndarray
    weights: np.ndarray


def _char_class(char: str) -> str:
    if char in _TERMINAL:
        return "T"
    if char.isdigit():
        return "D"
    if char.isalpha() or unicodedata.category(char)[0] == "M":
        return "L" if ord(char) < 0x250 else f"L{ord(char) >> 8:x}" if ord(char) < 0x3000 else "Lx"
    return "C" if char in ",;:、，；：،؛-–—" else "S"


def _cells(tail: str) -> bool:
    """Whether text is cells of a flattened table: short names, each with a value."""
    tokens = tail.split()
    cells = sum(1 for t in tokens if _CELL.fullmatch(t.lower()))
    return cells >= 3 and len(tokens) <= 6 * cells and bool(_CELL.fullmatch(tokens[-1].lower()))


def _is_link(token: str) -> bool:
    """Whether a token ends in a link or an address; in one pass, as in scripts without spaces a token may be a long text."""
    if "@" in token:
        stop = token.rfind(".")
        if _WORD.fullmatch(token, stop + 1) and token.find("@", 1, max(0, stop - 1)) > 0:
            return True
    return ("://" in token or "www." in token) and bool(_LINK.search(token))


def _line(text: str) -> str:
    """The kind of line a text ends in, as far as its last line shows it: item, link, row, or ''."""
    text = text.rstrip()
    cut = text.rfind("\n") + 1
    last = text[cut:].strip()
    if _is_link(last.rsplit(None, 1)[-1]):
        return "link"
    if not text[:cut].strip():
        return ""
    return "item" if _BULLET.match(last) else "row" if is_table(last) else ""


def _kind(char: str) -> int:
    name = _char_class(char)
    return _KINDS.get(name) or 8 + (ord(char) >> 8)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its kind, its small letter (digits alike) and whether it wraps texts."""
    kinds, low = np.full(0x110000, _KINDS["S"], dtype=np.int64), np.arange(0x110000, dtype=np.uint64)
    for start in range(0, 0x32000, 256):  # the planes after that hold no letters
        chars = [chr(point) for point in range(start, start + 256)]
        block = "".join(chars)
        if start >= 0x3000 and block.isalpha():
            kinds[start : start + 256] = _KINDS["Lx"]
        else:
            kinds[start : start + 256] = list(map(_kind, chars))
        if block.lower() != block:
            low[start : start + 256] = [ord(c) if len(c) == 1 else start + k for k, c in enumerate(map(str.lower, chars))]
    low[48:58] = 48
    wraps = np.zeros(0x110000, dtype=bool)
    wraps[[ord(c) for c in _WRAP]] = True
    return kinds, low, wraps


@dataclass
class Places:
    """Places in texts: what is known of each (see ``_general``), whether a bracket is open with the text's length up to it, where it and the text's first character are among the points."""

    general: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _general(line: int, kind, marked):  # noqa: ANN001, ANN202
    """One number of the kind of line, the class of the last character and a mark of omission."""
    return (line << 7 | kind) << 1 | marked


def _second(kind, opened, size):  # noqa: ANN001, ANN202
    """One number of an open bracket and, but for closed texts, the length."""
    bits = np.minimum(np.frexp(np.asarray(size, dtype=np.float64))[1], 7)
    return np.where(np.asarray(kind) == _KINDS["T"], 0, bits + 1) << 1 | opened


def _codes(places: Places) -> np.ndarray:
    return places.general << 5 | places.second


def _first_keys(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and second level of each of ``_codes``."""
    codes = np.arange(1 + most)
    first = mixed((codes >> 5).astype(np.uint64) + np.uint64(1))
    return first, mixed(first ^ mixed((codes & 31).astype(np.uint64) + np.uint64(1 << 32)))


def _suffixes(places: Places, of: np.ndarray, points: np.ndarray, first: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None):  # noqa: ANN202
    """Of each level of last characters, which places have a wanted context and its hash; a place without a wanted one at some level, the first included, has none after it. of: ``_codes``, first: the hashes of their first level."""
    keys, done = mixed(first ^ np.uint64(0x5A17)), 0
    starts, ends = places.starts, places.ends
    if wanted is None:
        at, keys = np.arange(len(of)), keys[of]
    else:
        at = np.flatnonzero(wanted(first)[of])
        keys = keys.take(of.take(at))
        starts, ends = starts.take(at), ends.take(at)
    low = _tables()[1].take(points)
    for size in SUFFIXES:
        for back in range(done + 1, size + 1):
            place = ends - back
            inside = place >= starts
            if inside.all():
                keys = mixed(keys * np.uint64(31) + low.take(place) + np.uint64(7))
            else:
                inside = np.flatnonzero(inside)
                own = mixed(keys.take(inside) * np.uint64(31) + low.take(place.take(inside)) + np.uint64(7))
                keys = keys.copy()
                keys[inside] = own
        done = size
        if wanted is not None:
            kept = np.flatnonzero(wanted(keys))
            at, keys, starts, ends = at.take(kept), keys.take(kept), starts.take(kept), ends.take(kept)
        yield at, keys


def _levels(places: Places, points: np.ndarray):  # noqa: ANN202
    """Of each level, from the most general one on, the hashes of the contexts of places."""
    of = _codes(places)
    first, second = _first_keys(of.max(initial=0))
    yield first[of]
    yield second[of]
    for _, keys in _suffixes(places, of, points, first):
        yield keys


def _open(tail: str) -> bool:
    return any(tail.count(a) > tail.count(b) for a, b in zip(_OPENERS[:3], _CLOSERS[:3], strict=True))


def _mark(text: str) -> re.Match[str] | None:
    """The mark of omission at the end of a stripped text."""
    if text[-1] not in ".…])>»eE" or text[-1] == "." and text[-3:] != "...":  # no mark ends so
        return None
    return _MARK.search(text, max(0, len(text) - 60))


def closed(text: str) -> bool:
    text = text.strip(_WRAP)
    return text[-1:] in tuple(_TERMINAL + _CLOSERS) and not _mark(text)


def _end(text: str) -> tuple[int, int, bool, int, str] | None:
    """Of the end of a text what ``_general`` takes, an open bracket, its length and its last characters; None if there is no text."""
    text = text.strip(_WRAP)
    if not text:
        return None
    marked = _mark(text)
    if marked and marked.start():
        text = text[: marked.start()].rstrip(_WRAP) or text
    kind, line, opened = _kind(text[-1]), _line(text), False
    if kind == _KINDS["T"]:
        line = line or "prose"
    elif not line:
        cuts = boundaries(text)
        tail = text[cuts[-1] :].strip() if cuts else text
        line = "cells" if _cells(tail) else "list" if is_list(tail) and len(tail) > 40 else "prose"
        if text[-1] in _CLOSERS:
            kind = _KINDS["B" if tail.count(_OPENERS[_CLOSERS.index(text[-1])]) >= tail.count(text[-1]) else "U"]
        else:
            opened = _open(tail)
    return _general(LINES.index(line), kind, bool(marked)), kind, opened, len(text), text[-SUFFIXES[-1] :]


def chains(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts of the end of each text, from the most general one on, and one of them together; all 0 for a text without characters."""
    keys, whole = np.zeros((len(texts), LEVELS), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
    found = [(k, end) for k, end in enumerate(map(_end, texts)) if end]
    if found:
        rows = np.array([k for k, _ in found])
        general, kind, opened, size = (np.array([end[n] for _, end in found], dtype=np.int64) for n in range(4))
        points, ends = code_points([end[4] for _, end in found])
        for level, own in enumerate(_levels(Places(general, _second(kind, opened, size), ends[:-1], ends[1:]), points)):
            keys[rows, level] = own
            whole[rows] = mixed(whole[rows] * np.uint64(31) + own)
    return keys, whole


def _sentences(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Sentences that say where texts end, and of each its offset, its length without closing marks, and whether its text goes on."""
    found: list[str] = []
    rows: list[tuple[int, int, bool]] = []
    marks = _TERMINAL + _WRAP + _CLOSERS
    for text in texts:
        cuts = boundaries(text)
        for a, b in zip(cuts, [*cuts, len(text)][1:], strict=True) if cuts else ():
            sentence = text[a:b].strip(_WRAP)
            size = len(sentence.rstrip(marks))
            if size < 8 or _BULLET.match(text, a, b):
                continue
            if size == len(sentence) and not "฀" <= sentence[-1] <= "๿":
                continue  # a head line or an item
            found.append(sentence)
            rows.append((a, size, b < len(text)))
    return found, np.array(rows, dtype=np.int64).reshape(-1, 3)


def _within(found: list[str], rows: np.ndarray) -> tuple[Places, np.ndarray, np.ndarray, np.ndarray]:
    """The places in ``_sentences``, their units, whether each is an end, and the code points."""
    kinds, _, wraps = _tables()
    points, ends = code_points(found)
    offsets, sizes, goes_on = rows.T
    starts, whole = ends[:-1], np.diff(ends)
    closers, terminal = np.array([ord(c) for c in _CLOSERS]), _KINDS["T"]
    depth, opens = np.zeros((3, len(points) + 1), dtype=np.int32), np.zeros(len(points) + 1, dtype=np.int32)
    for k, (a, b) in enumerate(zip(_OPENERS[:3], _CLOSERS[:3], strict=True)):
        opening = points == ord(a)
        opens[1:] += opening
        np.cumsum(opening.view(np.int8) - (points == ord(b)).view(np.int8), out=depth[k, 1:], dtype=np.int32)
    np.cumsum(opens, out=opens)
    # the last character before each place that doesn't wrap
    solid = np.r_[0, np.maximum.accumulate(np.where(wraps.take(points), 0, np.arange(1, len(points) + 1)))] if len(points) else np.zeros(1, dtype=np.int64)

    # ends of sentences whose text goes on; of closed ones also without the closing mark and with a mark of omission
    on, shut = np.flatnonzero(goes_on), np.flatnonzero(whole > sizes)
    last, bare = points[ends[1:][on] - 1], kinds[points[starts[shut] + sizes[shut] - 1]]
    of_on = np.where(np.isin(last, closers), _KINDS["B"], kinds[last])
    bare_end = starts[shut] + sizes[shut]
    bare_open = (depth[:, bare_end] > depth[:, starts[shut]]).any(axis=0)
    # all places within sentences from their third character on
    many = np.maximum(sizes - 3, 0)
    of = np.repeat(np.arange(len(sizes)), many)
    after = np.arange(2, len(of) + 2) - np.repeat(np.cumsum(many) - many, many)
    before = np.repeat(starts, many)
    at = before + after
    place = solid.take(at)
    units = np.repeat(np.rint(CUT_WEIGHT * UNIT / np.maximum(many, 1)).astype(np.int64), many)
    stops = np.flatnonzero(points.take(at - 1) == 46)
    stops = stops[(kinds[points[at[stops]]] != _KINDS["D"]) & (after[stops] > 2)]
    units[stops] += int(STOP_WEIGHT * UNIT)
    char = points.take(place - 1)
    bracket = np.isin(np.arange(0x10000), closers).take(np.minimum(char, 0xFFFF))  # an answer may end with a bracket
    kind = kinds.take(char)
    kind[bracket] = _KINDS["B"]
    opened = np.zeros(len(of), dtype=bool)
    some = np.flatnonzero(np.repeat(opens[ends[1:]] > opens[starts], many) & ~bracket & (kind != terminal))
    opened[some] = (depth[:, place[some]] > depth[:, before[some]]).any(axis=0)

    no, yes = np.zeros(len(shut), dtype=np.int64), np.ones(len(shut), dtype=np.int64)
    all_of = Places(
        np.concatenate([_general(0, of_on, 0), _general(0, bare, 0), _general(0, yes * terminal, 1), _general(0, kind, (after % 3 == 0) & ~bracket)]).astype(np.int64),
        np.concatenate([_second(of_on, 0, (offsets + whole)[on]), _second(bare, bare_open, (offsets + sizes)[shut]), _second(yes * terminal, no, (offsets + whole)[shut]), _second(kind, opened, np.repeat(offsets, many) + after)]).astype(np.int64),
        np.concatenate([starts[on], starts[shut], starts[shut], before]),
        np.concatenate([ends[1:][on], bare_end, ends[1:][shut], place]),
    )
    weights = np.concatenate([np.full(len(on), UNIT), yes * int(UNMARKED * UNIT), yes * int(OMITTED * UNIT), units])
    is_end = np.concatenate([np.ones(len(on) + 2 * len(shut), dtype=bool), bracket])
    return all_of, weights, is_end, points


def summed(keys: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each once, and the sums of their units of ends and of all places."""
    # a slot of a key's highest bits holds one key; the few rows of other keys of a slot are sorted
    slots = (keys >> np.uint64(48)).astype(np.int64)
    held = np.zeros(1 << 16, dtype=np.uint64)
    held[slots] = keys
    own = held[slots] == keys
    other = np.flatnonzero(~own)
    if len(other):
        rest = keys[other], ends[other], places[other]
        slots, ends, places = slots[own], ends[own], places[own]
    used = np.flatnonzero(np.bincount(slots, minlength=1 << 16))
    sums = np.stack([np.bincount(slots, weights=units, minlength=1 << 16)[used] for units in (ends, places)], axis=1)  # whole numbers below 2^53
    out, totals = held[used], sums.astype(np.int64)
    if len(other):
        order = np.argsort(rest[0])
        keys, units = rest[0][order], np.stack(rest[1:], axis=1)[order]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out, totals = np.r_[out, keys[firsts]], np.r_[totals, np.add.reduceat(units, firsts, axis=0)]
    return out, totals


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of several of ``summed``."""
    units = np.concatenate([u for _, u in parts])
    return summed(np.concatenate([k for k, _ in parts]), units[:, 0], units[:, 1])


def counted(answers: list[str], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the (wanted) contexts of the places in the sentences of texts, and units of ends and of all places of each."""
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros((0, 2), dtype=np.int64))]
    found, rows = _sentences(answers)
    for low, high in steps(found, 250_000):
        places, weights, is_end, points = _within(found[low:high], rows[low:high])
        ends, codes = np.where(is_end, weights, 0), _codes(places)
        sums = [np.bincount(codes, weights=units).astype(np.int64) for units in (ends, weights)]
        used, firsts = np.flatnonzero(sums[1]), _first_keys(len(sums[1]) - 1)
        parts += [summed(keys[used], sums[0][used], sums[1][used]) for keys in firsts]
        for at, keys in _suffixes(places, codes, points, firsts[0], wanted):
            parts.append(summed(keys, ends.take(at), weights.take(at)))
    return joined(parts)


def own_ends(answers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``counted``, of the ends of texts."""
    own, whole = chains(answers)
    # a text may itself break off: without a closing mark it says what lines texts end in, not which characters
    ended = np.array([bool(chain) and closed(a) for a, chain in zip(answers, whole, strict=True)], dtype=bool)
    keys = np.concatenate([own[whole != 0][:, :FIRST].ravel(), own[ended][:, FIRST:].ravel()])
    units = np.full(len(keys), UNIT, dtype=np.int64)
    return summed(keys, units, units)


def merged(parts: list[tuple[np.ndarray, np.ndarray, float]]) -> Counts:
    """Counts of what ``counted`` gives for some groups of texts and what a text of each weighs."""
    keys, at = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(k for k, _, _ in parts)]), return_inverse=True)
    weights = np.concatenate([np.zeros((0, 2)), *(u * (weight / UNIT) for _, u, weight in parts)])
    return Counts(keys, np.stack([np.bincount(at, weights=weights[:, k], minlength=len(keys)) for k in range(2)], axis=1))


def fit(answers: list[str]) -> Counts:
    """Weights of ends and of all places by context, from texts."""
    return merged([(*counted(answers), 1.0), (*own_ends(answers), 1.0)])


def end_probability(text: str, counts: Counts) -> float:
    """The probability that a text ends where it does; LEAST without any counts."""
    keys, whole = chains([text])
    value = LEAST
    if not whole[0] or not len(counts.keys):
        return value
    places = np.minimum(np.searchsorted(counts.keys, keys[0]), len(counts.keys) - 1)
    for known, (end, total) in zip((counts.keys[places] == keys[0]).tolist(), counts.weights[places].tolist(), strict=True):
        if known:
            value = (end + SMOOTH * value) / (total + SMOOTH)
    return value


def breaks_off(text: str, counts: Counts) -> bool:
    return end_probability(text, counts) < LEAST
