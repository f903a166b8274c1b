"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import settle, union_all  # noqa: F401  (re-exported for the operators)

#: Characters that separate words: white space, control, format and punctuation characters.
JVM_SEPARATORS = r"[\p{Z}\p{Cc}\p{Cf}\p{P}]+"

#: Codes of the languages this subpackage knows.
LANGS = ("en", "es", "fr", "de", "ru", "zh", "ja", "hi", "ar", "th")


@lru_cache(maxsize=1)
def separator_table() -> np.ndarray:
    """Of each code point, whether it separates words."""
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    # the planes between hold only letters and unassigned code points
    for point in (*range(0x20000), *range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(point))
        out[point] = kind[0] in "ZP" or kind in ("Cc", "Cf")
    return out


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern[str]:
    """Finds the words of a lower-cased text."""
    points = np.flatnonzero(separator_table())
    breaks = np.flatnonzero(np.diff(points) > 1)
    starts, ends = points[np.r_[0, breaks + 1]], points[np.r_[breaks, len(points) - 1]]
    ranges = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))
    return re.compile(f"[^{ranges}]+")


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased, in order."""
    return word_pattern().findall(text.lower())


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text begins (one more entry: the end)."""
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def clean_lang(col: Column) -> Column:
    """Two-letter code in lower case of a declared language; ``und`` for null, blank and unknown ones."""
    code = F.substring(F.lower(F.trim(col)), 1, 2)
    return F.when(code.isin(*LANGS) & F.lower(F.trim(col)).rlike("^[a-z]{2}([-_].*)?$"), code).otherwise(F.lit("und"))


def clean_source(df: DataFrame, column: str, sources: DataFrame) -> DataFrame:
    """Replaces ``column`` by the code of ``sources`` it stands for; ``unknown`` where it stands for none.

    ``sources`` (source, title) is the fixed list of sources; it does not grow with the corpus.
    """
    codes = sources.select(F.lower(F.trim("source")).alias("_spelling"), F.col("source").alias("_code"))
    titles = sources.select(F.lower(F.trim("title")).alias("_spelling"), F.col("source").alias("_code"))
    spellings = union_all(codes, titles).groupBy("_spelling").agg(F.min("_code").alias("_code"))
    joined = df.join(F.broadcast(spellings), F.lower(F.trim(df[column])) == F.col("_spelling"), "left")
    return joined.withColumn(column, F.coalesce("_code", F.lit("unknown"))).drop("_code", "_spelling")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """big joined with small (one row a key) on keys, with the rows of a key spread over ``salts`` tasks by ``salt``, a column of big that differs within a key."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(copies, [*keys, "_salt"], how).drop("_salt")


def may_be_in(df: DataFrame, keys: list[str], wanted: DataFrame, most_bits: int = 1 << 29) -> DataFrame:
    """The rows of df whose keys may be among those of ``wanted``: all that are and few others.

    A bitmap of hashed keys is broadcast: 16 bits for each wanted row, at most ``most_bits`` (64 MB); beyond that it lets more rows pass.
    """
    bits = 1 << max(15, min(most_bits, 16 * max(1, wanted.count())).bit_length() - 1)
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    maps = wanted.select(place.alias("_at")).groupBy(F.shiftright("_at", 15).alias("_bucket")).agg(F.bitmap_construct_agg((F.col("_at") % 32768)).alias("_map"))
    at = place % 32768
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return df.join(F.broadcast(maps), (F.shiftright(place, 15) == F.col("_bucket")) & is_set, "left_semi")


def arrow_rows(make: Callable[[pa.RecordBatch], Iterable[dict[str, list]] | Iterator[pa.RecordBatch]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: make gives column dictionaries for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in make(batch):
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def bounded_sample(df: DataFrame, key: str, stratum: Column, per_stratum: int) -> DataFrame:
    """Rows of df with at most ``per_stratum`` distinct keys of each stratum, those of the smallest hash of the key.

    First only keys and strata are read and ranked; the at most ``per_stratum`` keys for each stratum
    (strata are a fixed list, such as languages), a bounded table, then filter a second scan, so that texts are never sorted.
    """
    from pyspark.sql import Window as W

    keys = df.select(F.col(key).alias("_k"), stratum.alias("_s")).where(F.col("_k").isNotNull()).dropDuplicates(["_s", "_k"])
    ranked = keys.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy(F.xxhash64("_k"), "_k")))
    chosen = ranked.where(F.col("_r") <= per_stratum).select("_k")
    return df.join(F.broadcast(chosen), F.col(key) == F.col("_k"), "left_semi")
