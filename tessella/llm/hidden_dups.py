"""Problem 3: records that differ only in formatting, found by progressive partition refinement.

First, each record gets cheap invariants: lengths without separators and a digest of its letter histogram, both
blind to order, so that one pass over code points gives them. Classes of one member are settled. Only
members of larger classes get the costlier key, a digest of their words in order. All grouping is by keys of a few
bytes with map-side partial aggregation; a class that holds a third of all rows is one row a task before any shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import arrow_rows, code_points, may_be_in, salted_join, separator_table, settle, union_all

#: Between words: separators, except full stops and commas between two digits, which belong to the number.
_BETWEEN = r"(?:[\p{Z}\p{Cc}\p{Cf}\p{P}&&[^.,]]|(?<!\p{Nd})[.,]|[.,](?!\p{Nd}))+"
def canonical(col: Column) -> Column:
    """The words of a text in lower case with one space between them; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), _BETWEEN, " "))


def parsed_lines(df: DataFrame, id_col: str, line_col: str, first: str = "question", second: str = "answer") -> DataFrame:
    """(id, first, second) of the lines that are valid JSON objects with both fields as strings.

    Null, empty, broken lines, other values than objects, and objects that lack a field or have null or another
    type in it give no row.
    """
    schema = pa.schema([("id", pa.string()), (first, pa.string()), (second, pa.string())])

    def refuse(value: str) -> float:
        raise ValueError(value)

    def make(batch: pa.RecordBatch):  # noqa: ANN202
        out: dict[str, list] = {name: [] for name in schema.names}
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                record = json.loads(line, parse_constant=refuse)
                pair = [record[name].encode("utf-8", "replace").decode() for name in (first, second)]
            except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
                continue
            for name, value in zip(schema.names, (key, *pair), strict=True):
                out[name].append(value)
        if out["id"]:
            yield out

    lines = df.select(F.col(id_col).cast("string").alias("id"), F.col(line_col).alias("line")).where(F.col("line").isNotNull())
    return lines.mapInArrow(arrow_rows(make, schema), f"id string, {first} string, {second} string")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: a random weight of its lower case, that one's length (0 for separators), whether it is a digit."""
    size = len(separator_table())
    state = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        state = (state ^ (state >> np.uint64(shift))) * np.uint64(factor)
    own = state ^ (state >> np.uint64(31))
    own[ord("ς")] = own[ord("σ")]  # lower case of a capital sigma depends on its place
    weights, lengths, digits = own.copy(), np.ones(size, dtype=np.int64), np.zeros(size, dtype=bool)
    for point in range(size):
        char = chr(point)
        low = char.lower()
        if low != char:
            lengths[point] = len(low)
            weights[point] = sum(int(own[ord(c)]) for c in low) % (1 << 64)
        if char.isdecimal():
            digits[point] = True
    lengths[separator_table()] = 0
    weights[separator_table()] = 0
    return weights, lengths, digits


def invariants(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the length without separators, the sum of its letters' weights, the number of words."""
    weights, lengths, digits = _tables()
    points, ends = code_points([t or "" for t in texts])
    if not len(points):
        zero = np.zeros(len(texts), dtype=np.int64)
        return zero, zero.astype(np.uint64), zero
    inner = np.zeros(len(points), dtype=bool)
    marks = np.flatnonzero((points == 46) | (points == 44))
    marks = marks[(marks > 0) & (marks < len(points) - 1)]
    edges = np.zeros(len(points) + 1, dtype=bool)
    edges[ends] = True
    marks = marks[digits[points[marks - 1]] & digits[points[marks + 1]] & ~edges[marks] & ~edges[marks + 1]]
    inner[marks] = True
    kept = lengths[points]
    kept[marks] = 1
    weight = weights[points]
    weight[marks] = points[marks].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    part = kept > 0
    first = part & ~np.r_[False, part[:-1]]
    first |= part & edges[:-1]

    def by_text(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, dtype=values.dtype)
        np.cumsum(values, out=total[1:])
        return total[ends[1:]] - total[ends[:-1]]

    return by_text(kept), by_text(weight), by_text(first.astype(np.int64))


def _marks(at: int, least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = np.zeros(batch.num_rows, dtype=np.uint64)
            kept = np.ones(batch.num_rows, dtype=bool)
            for k in range(2, batch.num_columns):
                lengths, letters, words = invariants(batch.column(k).to_pylist())
                for part in (lengths.astype(np.uint64), letters):
                    total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
                    total ^= total >> np.uint64(29)
                if k == at:
                    kept = words >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total.view(np.int64))], names=["grp", "id", "invariant"]).filter(pa.array(kept))

    return run


def _refined(df: DataFrame, id_col: str, fields: list[str], group_cols: tuple[str, ...], least_words: tuple[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """(grp, keep_id) of the records alone in their class of invariants, and (grp, key, id) of the others with the digest of their words."""
    names = [f"f{k}" for k in range(len(fields))]
    base = df.select(F.struct(*(F.col(g).alias(f"g{k}") for k, g in enumerate(group_cols)), F.lit(0).alias("g")).alias("grp"), F.col(id_col).cast("string").alias("id"), *(F.col(f).alias(n) for f, n in zip(fields, names, strict=True))).where(F.col("id").isNotNull())
    at, least = (2 + fields.index(least_words[0]), least_words[1]) if least_words else (2, 0)
    # groups, ids and invariants, a few bytes a record
    marked = settle(base.mapInArrow(_marks(at, least), f"grp {base.schema['grp'].dataType.simpleString()}, id string, invariant long").dropDuplicates())
    classes = marked.groupBy("grp", "invariant").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    several = classes.where(F.col("low") < F.col("high")).select("grp", "invariant")
    left = settle(salted_join(marked, several, ["grp", "invariant"], F.col("id"), "left_semi").select("grp", "id"))
    words = F.concat_ws("\n", *(canonical(F.col(n)) for n in names))
    # only texts that may be in such a class are shuffled
    texts = may_be_in(base, ["grp", "id"], left).join(left, ["grp", "id"], "left_semi")
    members = settle(texts.select("grp", "id", F.sha2(words, 256).alias("key")).dropDuplicates(["grp", "key", "id"]))
    alone = classes.where(F.col("low") == F.col("high")).select("grp", F.col("low").alias("keep_id"))
    return alone, members


def copies(df: DataFrame, id_col: str, fields: list[str], *, group_cols: tuple[str, ...] = (), least_words: tuple[str, int] | None = None) -> DataFrame:
    """(group_cols, keep_id, copy_id, n_copies): one row for each other member of each class of copies.

    Records of equal group_cols are copies if, in each field, they have the same words in the same order. keep_id is
    the smallest id (as a string), n_copies the size of the class. A null field counts as one without words; rows with a null id
    take no part; a repeated id counts once; other columns are not read. ``least_words``: a field
    and how many words it must have. An empty table gives no row. The members of a class, however many, are spread over tasks.
    """
    _, members = _refined(df, id_col, fields, group_cols, least_words)
    sizes = members.groupBy("grp", "key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).where(F.col("n_copies") > 1)
    found = salted_join(members, sizes, ["grp", "key"], F.col("id")).where(F.col("id") > F.col("keep_id"))
    return found.select(*(F.col(f"grp.g{k}").alias(g) for k, g in enumerate(group_cols)), "keep_id", F.col("id").alias("copy_id"), "n_copies")


def collapsed(df: DataFrame, id_col: str, fields: list[str], *, group_cols: tuple[str, ...] = (), least_words: tuple[str, int] | None = None) -> DataFrame:
    """(group_cols, keep_id, n_copies): each record that takes part once, by the smallest id of its copies, with how many there are; as in ``copies``."""
    alone, members = _refined(df, id_col, fields, group_cols, least_words)
    sizes = members.groupBy("grp", "key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies")).select("grp", "keep_id", "n_copies")
    both = union_all(sizes, alone.withColumn("n_copies", F.lit(1).cast("long")))
    return both.select(*(F.col(f"grp.g{k}").alias(g) for k, g in enumerate(group_cols)), "keep_id", "n_copies")
