"""Problem 1: tokens of each text, and totals of each slice of a corpus, from a regression on cheap counts.

For each language a least-squares model predicts tokens from bytes, words, digits, punctuation and characters of scripts, and from
what costs unlike others: lengths of runs of letters and digits, runs glued together, changes of case, repeats. Its
coefficients are drawn towards those of all languages together, so that foreign or garbled texts are priced well where a
language has few rows. It is fitted on a bounded sample of tokenized rows, of which each third is held out in turn; the
held-out ratios of true to predicted tokens, by language and, as far as there are tokens, by domain, correct the estimates.
Texts without a known language take the model of the language their trigrams show.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LANGS, bounded_sample, clean_lang, clean_source, code_points, separator_table
from tessella.llm.language import fit_grams, language_scores
from tessella.llm.shingles import steps
from tessella.llm.tokenizer import BYTE_BPE, VOCABULARIES, load

#: Bound of the tokenized rows of each language, and the parts that are held out in turn.
PER_LANGUAGE, FOLDS = 900, 3
#: How strongly a language's coefficients are drawn to those of all, in rows; tokens a domain must show to count half.
PRIOR_ROWS, DOMAIN_TOKENS = 10.0, 100_000.0
#: First code points of the blocks the script counts tell apart.
_BLOCKS = {"latin": ((0x41, 0x250),), "cyrillic": ((0x400, 0x530),), "arabic": ((0x600, 0x700),), "devanagari": ((0x900, 0x980),), "thai": ((0xE00, 0xE80),), "kana": ((0x3040, 0x3100),), "han": ((0x3400, 0xA000),)}
_KINDS = ("one", "bytes", "words", "upper", "digits", "punctuation", "spaces", "other", *_BLOCKS)
#: Of runs of one kind: Latin runs, their letters beyond the 4th and the 9th, thirds of digits, runs of marks, glued letters, rises of case, runs of other scripts.
_RUNS = ("long", "repeats", "latin_runs", "beyond_4", "beyond_9", "digit_thirds", "mark_runs", "glued", "rises", "other_runs")
FEATURES = (*_KINDS, *_RUNS)
_LATIN, _DIGIT, _SPACE, _MARK = range(4)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane its kind (a place in _KINDS), and the coarse kind runs are made of."""
    out = np.full(0x10000, _KINDS.index("other"), dtype=np.uint8)
    for name, ranges in _BLOCKS.items():
        for low, high in ranges:
            out[low:high] = _KINDS.index(name)
    out[separator_table()[:0x10000]] = _KINDS.index("punctuation")
    for point in range(0x10000):
        char = chr(point)
        if char.isspace():
            out[point] = _KINDS.index("spaces")
        elif char.isdecimal():
            out[point] = _KINDS.index("digits")
        elif char.isupper() and point < 0x530:
            out[point] = _KINDS.index("upper")
    coarse = np.arange(len(_KINDS), dtype=np.uint8)
    for name, kind in (("latin", _LATIN), ("upper", _LATIN), ("digits", _DIGIT), ("spaces", _SPACE), ("punctuation", _MARK), ("other", _MARK)):
        coarse[_KINDS.index(name)] = kind
    return out, coarse[out]


def features(texts: list[str]) -> np.ndarray:
    """The FEATURES of each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = 1.0
    kinds_of, coarse_of = _classes()
    at = {name: k for k, name in enumerate(FEATURES)}
    for low, high in steps(texts):
        points, ends = code_points(texts[low:high])
        if not len(points):
            continue
        size = high - low
        owner = np.repeat(np.arange(size), np.diff(ends))
        plane = np.minimum(points, 0xFFFF)
        kinds, coarse = kinds_of[plane], coarse_of[plane]
        counts = np.bincount(owner * len(_KINDS) + kinds, minlength=size * len(_KINDS)).reshape(size, -1)
        out[low:high, 3 : len(_KINDS)] = counts[:, 3:]

        def total(name: str, of: np.ndarray, weights: np.ndarray | None = None, low: int = low, high: int = high, size: int = size) -> None:
            out[low:high, at[name]] = np.bincount(of, weights=weights, minlength=size)

        same = np.r_[False, owner[1:] == owner[:-1]]
        part = ~separator_table()[points]
        total("words", owner, part & ~(np.r_[False, part[:-1]] & same))
        total("bytes", owner, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        total("repeats", owner[1:], (points[1:] == points[:-1]) & same[1:])
        edge = np.diff((part & (points < 0x250)).astype(np.int8), prepend=0, append=0)
        starts, lengths = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        total("long", owner[starts[lengths > 20]], lengths[lengths > 20])
        first = np.flatnonzero(np.r_[True, coarse[1:] != coarse[:-1]] | ~same)
        length, kind, of = np.diff(np.r_[first, len(points)]), coarse[first], owner[first]
        latin, digit = kind == _LATIN, kind == _DIGIT
        total("latin_runs", of[latin])
        total("beyond_4", of[latin], np.maximum(length[latin] - 4, 0))
        total("beyond_9", of[latin], np.maximum(length[latin] - 9, 0))
        total("digit_thirds", of[digit], (length[digit] + 2) // 3)
        total("mark_runs", of[kind == _MARK])
        total("other_runs", of[kind > _MARK])
        glued = latin & (np.r_[_SPACE, kind[:-1]] != _SPACE) & (np.r_[kind[1:], _SPACE] != _SPACE)
        total("glued", of[glued], length[glued])
        upper = kinds == _KINDS.index("upper")
        total("rises", owner, np.r_[False, upper[1:] & ~upper[:-1] & (coarse[:-1] == _LATIN)] & same)
    return out


@dataclass
class Models:
    """Coefficients by language (``und``: of all), held-out ratios by language and by (language, domain), and trigrams of languages."""

    solved: dict[str, np.ndarray] = field(default_factory=dict)
    ratios: dict[str, float] = field(default_factory=dict)
    by_domain: dict[tuple[str, str], float] = field(default_factory=dict)
    grams: np.ndarray | None = None


def _solve(table: np.ndarray, true: np.ndarray, prior: np.ndarray, rows: float) -> np.ndarray:
    """Least squares weighted by size, drawn to ``prior`` with the weight of so many rows."""
    weight = 1.0 / np.sqrt(np.maximum(true, 8.0))  # longer texts vary more
    matrix = table * weight[:, None]
    pull = np.diag(rows * (matrix * matrix).mean(axis=0) + 1e-3)
    return np.linalg.solve(matrix.T @ matrix + pull, matrix.T @ (true * weight) + pull @ prior)


def _spoken(texts: list[str], langs: list[str], grams: np.ndarray) -> np.ndarray:
    """The languages, with those that aren't known taken from the trigrams."""
    out = np.array(langs, dtype=object)
    unknown = np.flatnonzero(~np.isin(out.astype(str), LANGS))
    if len(unknown):
        out[unknown] = np.array(LANGS, dtype=object)[language_scores([texts[k] for k in unknown], grams).argmax(axis=1)]
    return out


def fit(rows: list[tuple[str, str, str]], folder: str = VOCABULARIES, name: str = BYTE_BPE) -> Models:
    """Models from (language, domain, text) rows."""
    encoder, _ = load(folder, name)
    rows = sorted(rows)
    texts = [text for _, _, text in rows]
    table, true = features(texts), np.array([len(encoder.encode_ordinary(t)) for t in texts], dtype=float)
    declared = np.array([lang for lang, _, _ in rows], dtype=object)
    models = Models(grams=fit_grams([(lang, text) for lang, _, text in rows]))
    spoken = _spoken(texts, list(declared), models.grams)
    held, guess = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    zero = np.zeros(len(FEATURES))
    models.solved["und"] = _solve(table, true, zero, 0.0) if len(rows) else zero
    for lang in sorted(set(spoken)):
        own = spoken == lang
        models.solved[lang] = _solve(table[own], true[own], models.solved["und"], PRIOR_ROWS)
    for fold in range(FOLDS):
        rest = held != fold
        pooled = _solve(table[rest], true[rest], zero, 0.0) if rest.any() else zero
        for lang in sorted(set(spoken)):
            train, test = (spoken == lang) & rest, (spoken == lang) & ~rest
            solved = _solve(table[train], true[train], pooled, PRIOR_ROWS) if train.any() else pooled
            guess[test] = np.maximum(table[test] @ solved, 0.0)
    for lang in sorted(set(declared)):
        own = declared == lang
        ratio = models.ratios[lang] = float(true[own].sum() / guess[own].sum()) if guess[own].sum() > 0 else 1.0
        for domain in sorted({d for (o, d, _) in rows if o == lang}):
            at = own & np.array([d == domain for _, d, _ in rows])
            models.by_domain[lang, domain] = float((true[at].sum() + DOMAIN_TOKENS * ratio) / (guess[at].sum() + DOMAIN_TOKENS))
    return models


def predict(texts: list[str], langs: list[str], domains: list[str], models: Models) -> np.ndarray:
    """Estimated tokens of each text, 0 for empty ones."""
    table, spoken = features(texts), _spoken(texts, langs, models.grams)
    out = np.zeros(len(texts))
    for lang in set(spoken):
        rows = spoken == lang
        out[rows] = np.maximum(table[rows] @ models.solved.get(lang, models.solved["und"]), 0.0)
    ratio = [models.by_domain.get((lang, domain), models.ratios.get(lang, 1.0)) for lang, domain in zip(langs, domains, strict=True)]
    out *= np.array(ratio)
    out[table[:, 1] == 0] = 0.0
    return out


_SCHEMA = pa.schema([("id", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("domain", pa.string()), ("n_bytes", pa.int64()), ("est_tokens", pa.float64())])


def estimates(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, domain_col: str, sources: DataFrame, *, per_language: int = PER_LANGUAGE, folder: str = VOCABULARIES, name: str = BYTE_BPE) -> DataFrame:
    """(id, source, lang, domain, n_bytes, est_tokens) of each text, with cleaned source and language; ids as strings.

    Each id comes once, however often its row occurs; rows with a null id come each, with ids ``null-…``. Null and empty texts have no
    tokens. Unknown sources are ``unknown``, unknown languages ``und``, null domains ``unknown``. An empty table gives no row; other columns
    are not read. Texts aren't shuffled, only a small row for each.
    """
    text, domain, lang = F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(domain_col), F.lit("unknown")).alias("domain"), clean_lang(F.col(lang_col)).alias("lang")
    sample = bounded_sample(df.select(F.col(id_col).cast("string").alias("id"), text, lang, domain), "id", F.col("lang"), per_language)
    rows = {(r.lang, r.domain, r.text) for r in sample.where(F.col("text") != "").select("lang", "domain", "text").collect()}
    models = df.sparkSession.sparkContext.broadcast(fit(sorted(rows), folder, name))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts, langs, domains = (batch.column(k).to_pylist() for k in (1, 2, 4))
            if texts:
                guess = predict(texts, langs, domains, models.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(guess)], schema=_SCHEMA)

    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), F.monotonically_increasing_id().cast("string")))
    picked = df.select(key.alias("id"), text, lang, F.col(source_col).alias("source"), domain)
    counted = picked.mapInArrow(run, "id string, lang string, source string, domain string, n_bytes long, est_tokens double").dropDuplicates(["id"])
    return clean_source(counted, "source", sources).select("id", "source", "lang", "domain", "n_bytes", F.round("est_tokens", 1).alias("est_tokens"))


def token_budget(estimated: DataFrame) -> DataFrame:
    """(source, lang, domain, n_texts, n_bytes, est_tokens) of each slice, from the rows of ``estimates``; null and empty texts count as texts without tokens."""
    return estimated.groupBy("source", "lang", "domain").agg(F.count("*").alias("n_texts"), F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("est_tokens"), 1).alias("est_tokens"))
