"""Language of a text: naive Bayes over hashed character trigrams, fitted on labelled rows."""

from __future__ import annotations

import re

import numpy as np

from tessella.llm.common import LANGS, code_points
from tessella.llm.shingles import steps

#: Hash buckets of the n-grams.
NB_BITS = 16
_NO_LANGUAGE = re.compile(r"[!-~]{31,}|(\S)\1{4,}(?:\1|[̀-ͯ])*")


def hashes(points: np.ndarray) -> np.ndarray:
    """Hash buckets of the three characters that end at each character, in lower case, digits alike."""
    low = np.where(((points >= 65) & (points <= 90)) | ((points >= 0x410) & (points <= 0x42F)), points + 32, points)
    low = np.where((low >= 48) & (low <= 57), 48, low).astype(np.uint32)
    mixed = low * np.uint32(2654435761)
    mixed[1:] += low[:-1] * np.uint32(2246822519)
    mixed[2:] += low[:-2] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x846CA68B)
    return mixed >> np.uint32(32 - NB_BITS)


def _padded(texts: list[str]) -> list[str]:
    """Texts that begin as if after two line breaks, without overlong tokens and runs of one character."""
    points, ends = code_points(texts)
    # the pattern finds nothing but in texts with five characters alike or 31 of ASCII without white space
    alike = points[1:] == points[:-1]
    for _ in range(3):
        alike = alike[1:] & alike[:-1]
    breaks = np.flatnonzero(np.r_[True, (points < 33) | (points > 126), True])
    odd = np.zeros(len(texts), dtype=bool)
    odd[np.searchsorted(ends, np.flatnonzero(alike), side="right") - 1] = True
    for k in np.flatnonzero(np.diff(breaks) > 31):
        odd[np.searchsorted(ends, breaks[k], side="right") - 1 : np.searchsorted(ends, breaks[k + 1], side="left")] = True
    return ["\n\n" + (_NO_LANGUAGE.sub(" ", text) if odd[k] else text) for k, text in enumerate(texts)]


def counted_grams(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    out = np.zeros(1 << NB_BITS, dtype=np.int64)
    own = _padded([text for text in texts if text])
    for low, high in steps(own):
        out += np.bincount(hashes(code_points(own[low:high])[0]), minlength=1 << NB_BITS)
    return out


def grams_of(counts: np.ndarray) -> np.ndarray:
    """Log likelihood of each bucket under each of LANGS, from its counts in each; relative to the likeliest language and clipped."""
    counts = counts + 0.2
    grams = np.log(counts / counts.sum(axis=1, keepdims=True))
    return np.ascontiguousarray(np.clip(grams - grams.max(axis=0, keepdims=True), -6.0, 0.0).T, dtype=np.float32)


def fit_grams(rows: list[tuple[str, str]]) -> np.ndarray:
    """``grams_of`` (language, text) rows."""
    return grams_of(np.stack([counted_grams([text for of, text in rows if of == lang]) for lang in LANGS]))


def language_scores(texts: list[str], grams: np.ndarray, block: int = 250_000) -> np.ndarray:
    """Log likelihood of each text under each language; overlong tokens and runs of one character say nothing."""
    texts = _padded(texts)
    out = np.zeros((len(texts), grams.shape[1]), dtype=np.float64)
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= block):
            held += len(texts[end])
            end += 1
        points, ends = code_points(texts[start:end])
        for low in range(0, len(points), block):  # one text may be longer than a block
            part = points[low : low + block]
            marks = np.clip(ends, low, low + len(part)) - low
            filled = np.flatnonzero(marks[1:] > marks[:-1])
            if len(filled):
                values = grams[hashes(part)]
                for at in (marks[filled], marks[filled] + 1):  # their trigrams reach into the text before
                    values[np.minimum(at, len(part) - 1)] = 0.0
                out[start + filled] += np.add.reduceat(values, marks[filled], axis=0)
        start = end
    return out
