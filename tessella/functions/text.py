"""Text expressions of the retrieval pipeline, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space and the separators U+001C to U+001F.
WHITE_SPACE = r"(?U:[\s\x1c-\x1f]+)"
NOT_WHITE_SPACE = r"(?U:[^\s\x1c-\x1f]+)"
#: Fixed value: a sentence ends at white space between one of .!? and an ASCII capital or digit.
SENTENCE_GAP = "(?<=[.!?])" + WHITE_SPACE + "(?=[A-Z0-9])"
#: Fixed value: characters a token is taken for.
CHARS_PER_TOKEN = 4


def clean_text(col: Column) -> Column:
    """White space runs as one space, none at the ends; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(col, WHITE_SPACE, " ")), F.lit(""))


def has_text(col: Column) -> Column:
    """Whether a text has anything but white space; a cheaper test than cleaning it."""
    return F.coalesce(col.rlike(NOT_WHITE_SPACE), F.lit(False))


def strip(col: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(col, "^" + WHITE_SPACE, ""), WHITE_SPACE + "$", "")


def split_sentences(col: Column) -> Column:
    """Array of the sentences of a text; empty for null and blank ones."""
    parts = F.transform(F.split(strip(F.coalesce(col, F.lit(""))), SENTENCE_GAP), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def fixed_size_chunks(col: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of windows of ``size`` characters that begin every ``size - overlap``; a text within the size comes as it is."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length(col) - 1, F.lit(0)), F.lit(size - overlap))
    windows = F.filter(F.transform(starts, lambda at: strip(F.substring(col, at + 1, F.lit(size)))), lambda c: F.length(c) > 0)
    return F.when(F.length(col) <= size, F.array(col)).otherwise(windows)


def _packed(sentences: Column, max_chars: int, breaks: Column | None, split_long: bool) -> Column:
    """Greedy packing: a fold over the sentences; ``breaks`` holds for each sentence whether a chunk must begin with it."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
    joined = lambda acc: F.array_join(acc["cur"], " ")
    flushed = lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(joined(acc)))).otherwise(acc["out"])

    def step(acc: Column, item: Column) -> Column:
        text = item["s"]
        length = F.length(text)
        full = (F.size(acc["cur"]) > 0) & ((acc["n"] + length > max_chars) | item["b"])
        kept = F.struct(
            F.when(full, flushed(acc)).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(text)).otherwise(F.concat(acc["cur"], F.array(text))).alias("cur"),
            F.when(full, length).otherwise(acc["n"] + length).alias("n"),
        )
        if not split_long:
            return kept
        cut = F.struct(F.concat(flushed(acc), fixed_size_chunks(text, max_chars, 0)).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
        return F.when(length > max_chars, cut).otherwise(kept)

    none = F.transform(sentences, lambda _: F.lit(False))
    items = F.arrays_zip(sentences.alias("s"), (none if breaks is None else breaks).alias("b"))
    items = F.transform(items, lambda z: F.struct(z["s"].alias("s"), z["b"].alias("b")))
    return F.aggregate(items, start, step, flushed)


def sentence_chunks(sentences: Column, max_tokens: int = 200) -> Column:
    """Sentences packed greedily; the budget counts sentences' lengths without the spaces that join them. A sentence over the budget is cut into windows without overlap."""
    return _packed(sentences, max_tokens * CHARS_PER_TOKEN, None, split_long=True)


def semantic_chunks(sentences: Column, breaks: Column, max_tokens: int = 250) -> Column:
    """Sentences packed until one breaks from its predecessor or the budget is full; long sentences stay whole."""
    return _packed(sentences, max_tokens * CHARS_PER_TOKEN, breaks, split_long=False)


def tokenize(col: Column) -> Column:
    """Array of runs of ASCII letters and digits in lower case; empty for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(col: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.size(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(NOT_WHITE_SPACE), F.lit(0)))


def embed_text(question: Column, focus: Column, chunk_text: Column) -> Column:
    """The text that is embedded and reranked."""
    return F.concat(F.lit("Question: "), question, F.lit("\nFocus: "), focus, F.lit("\n\n"), chunk_text)


def pair_uid_of(chunk_id: Column) -> Column:
    """The pair a chunk id belongs to: what stands before the first ``::``."""
    return F.substring_index(chunk_id, "::", 1)


def padded_id(number: Column, width: int = 7) -> Column:
    """A number with leading zeros; longer ones stay whole."""
    return F.format_string(f"%0{width}d", number)


def preview(col: Column, length: int = 80) -> Column:
    """The first characters with line breaks as spaces."""
    return F.replace(F.substring(col, 1, length), F.lit("\n"), F.lit(" "))


def sigmoid(col: Column) -> Column:
    """1 / (1 + e^-x); 0 for very negative values."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))
