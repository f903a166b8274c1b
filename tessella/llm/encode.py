"""Problem 7: encoding of a corpus with a public tokenizer, as a monoid tree reduction over each text, and decoding up the tree.

A text of at most LEAF characters is a leaf, encoded directly; most texts of the given tables are. The results don't depend on LEAF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows
from tessella.llm.tokenizer import BYTE_BPE, VOCABULARIES, load

#: Texts of at most so many characters are leaves of the tree and encoded directly.
LEAF = 4096

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)


@lru_cache(maxsize=1 << 16)
def kind_of(char: str) -> int:
    """The class of a character in the pattern that splits text before merging.

    Outside the basic plane, where libraries' Unicode tables differ in age, it is UNSURE, which makes no seam.
    """
    if ord(char) > 0xFFFF:
        return UNSURE
    if char.isspace():
        return SPACE
    major = unicodedata.category(char)[0]
    return LETTER if major == "L" else NUMBER if major == "N" else OTHER


def is_seam(before: str, after: str) -> bool:
    """Whether, whatever else the text holds, one piece of the splitting pattern ends between these characters.

    A letter or digit belongs to a piece that can go on only with characters of its own class, so a
    change of class after it always ends the piece. This holds for contractions, too: ``'s`` ends
    with a letter and, where a letter follows, there is no change of class.
    """
    kind = kind_of(before)
    return kind in (LETTER, NUMBER) and kind_of(after) not in (kind, UNSURE)


def join(text: str, start: int, middle: int, end: int, left: list[int], right: list[int], encoder, lengths: list[int]) -> list[int]:  # noqa: ANN001
    """The ids of text[start:end] from those of text[start:middle] and text[middle:end].

    A window around the join grows to both sides until it ends at seams; merges never cross seams,
    so the tokens outside it can't change, and only the window is encoded again.
    """
    if start == middle or middle == end or is_seam(text[middle - 1], text[middle]):
        return left + right

    low = middle - 1
    while low > start and not is_seam(text[low - 1], text[low]):
        low -= 1
    high = middle + 1
    while high < end and not is_seam(text[high - 1], text[high]):
        high += 1
    size, cut = len(text[low:middle].encode()), len(left)
    while size > 0:
        cut -= 1
        size -= lengths[left[cut]]
    rest, skip = len(text[middle:high].encode()), 0
    while rest > 0:
        rest -= lengths[right[skip]]
        skip += 1
    return left[:cut] + encoder.encode_ordinary(text[low:high]) + right[skip:]


def encode_text(text: str, encoder, lengths: list[int], leaf: int = LEAF) -> list[int]:  # noqa: ANN001
    """The ids of a text: halves are encoded recursively and joined."""

    def tree(start: int, end: int) -> list[int]:
        if end - start <= leaf:
            return encoder.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return join(text, start, middle, end, tree(start, middle), tree(middle, end), encoder, lengths)

    return tree(0, len(text)) if text else []


def token_ids(df: DataFrame, id_col: str, text_col: str, *, folder: str = VOCABULARIES, name: str = BYTE_BPE, leaf: int = LEAF) -> DataFrame:
    """(id, ids array<int>): the ids of each text, without special tokens; strings that look like special tokens are ordinary text.

    Null and empty texts get an empty list; a null id is kept; repeated rows give repeated rows; other
    columns of df are not read. A lone surrogate can't occur in a Spark string. No shuffle: each row on its own.
    """
    kind = df.schema[id_col].dataType
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        encoder, lengths = load(folder, name)
        yield {"id": batch.column(0).to_pylist(), "ids": [encode_text(t, encoder, lengths, leaf) if t else [] for t in batch.column(1).to_pylist()]}

    out = source.mapInArrow(arrow_rows(make, schema), f"id {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_ids(ids: list[int], encoder, leaf: int = LEAF) -> bytes:  # noqa: ANN001
    """The bytes of ids: those of halves, decoded recursively, one after the other."""
    if len(ids) <= leaf:
        return encoder.decode_bytes(ids)
    middle = len(ids) // 2
    return decode_ids(ids[:middle], encoder, leaf) + decode_ids(ids[middle:], encoder, leaf)


def token_texts(df: DataFrame, id_col: str, ids_col: str, *, folder: str = VOCABULARIES, name: str = BYTE_BPE, leaf: int = LEAF) -> DataFrame:
    """(id, text): the text of each list of ids; '' for null and empty lists; bytes that are no UTF-8 become U+FFFD.

    A null id is kept; repeated rows give repeated rows; other columns are not read. An id outside the vocabulary is an error. No shuffle.
    """
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("text", pa.string())])

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        encoder, _ = load(folder, name)
        yield {"id": batch.column(0).to_pylist(), "text": [decode_ids(ids, encoder, leaf).decode("utf-8", "replace") if ids else "" for ids in batch.column(1).to_pylist()]}

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(arrow_rows(make, schema), f"id {kind.simpleString()}, text string")
    return out.withColumnRenamed("id", id_col)
