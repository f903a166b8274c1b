"""Sets of word runs of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tessella.llm.common import code_points, separator_table

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters that are taken in one step; a longer text is a step of its own.
STEP = 120_000


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=1)
def _weights() -> np.ndarray:
    """A scrambled value of each code point of the basic plane."""
    return mixed(np.arange(1, 0x10001, dtype=np.uint64))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, base, dtype=np.uint64)], dtype=np.uint64) for base in (_BASE, _INVERSE))


def steps(texts: list[str], step: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``step`` characters together."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > step:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts in order, and at which word each text begins (one more entry: the end)."""
    hashes, _, bounds = word_spans(texts)
    return hashes, bounds


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each word of all texts in order, and at which word each text begins (one more entry: the end)."""
    points, ends = code_points([t.lower() + "\n" for t in texts])
    if not len(points):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    part = ~separator_table()[points]
    edge = np.diff(part.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverses = _powers(1 << max(18, int(len(points) + 1).bit_length()))
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    weights = _weights()[np.minimum(points, 0xFFFF)]
    beyond = points > 0xFFFF
    if beyond.any():
        weights[beyond] = mixed(points[beyond].astype(np.uint64) + np.uint64(1))
    np.cumsum(weights * powers[: len(points)], out=total[1:])
    hashes = mixed((total[stops] - total[starts]) * inverses[starts])
    return hashes, stops - starts, np.searchsorted(starts, ends)


def run_sets(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``length`` consecutive words of each text, as sorted hashes of 48 bits, and where each text's begin.

    At most 65,536 texts.
    """
    sizes, parts = np.zeros(len(texts), dtype=np.int64), []
    for low, high in steps(texts):
        hashes, bounds = word_hashes(texts[low:high])
        if len(hashes) < length:
            continue
        runs = hashes[: len(hashes) - length + 1].copy()
        for k in range(1, length):
            runs = mixed(runs * np.uint64(3) + hashes[k : len(hashes) - length + 1 + k])
        owner = np.repeat(np.arange(high - low), np.diff(bounds))[: len(runs)]
        runs = runs[np.arange(len(runs)) + length <= bounds[1:][owner]] if len(runs) else runs
        counts = np.maximum(np.diff(bounds) - length + 1, 0)
        owner = np.repeat(np.arange(high - low, dtype=np.uint64), counts)
        keys = np.unique((owner << np.uint64(48)) | (runs >> np.uint64(16)))
        sizes[low:high] = np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=high - low)
        parts.append(keys & np.uint64((1 << 48) - 1))
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), bounds
