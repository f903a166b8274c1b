"""Sinks and stores: JSON lines, CSV, vector indexes and one-row reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vectors import Embedder, embed, hashed_bag_of_words


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_report(report: DataFrame, path: str) -> dict:
    """Writes a report of one row as indented JSON and returns it."""
    row = report.first().asDict(recursive=True)
    write_file(path, json.dumps(row, indent=2, ensure_ascii=False))
    return row


def write_file(path: str, content: str) -> None:
    """Writes a text file at a path or a URI of a shared store."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as file:
        file.write(content.encode("utf-8", "replace"))


def write_files(df: DataFrame, path_col: str, content_col: str, root: str) -> int:
    """Writes each row's content as a file below root, from the tasks that hold the rows; how many. A file written twice, by a task that was repeated, is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                write_file(f"{root}/{path}", content or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return df.select(path_col, content_col).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def index_count(index: DataFrame) -> int:
    """The number of vectors of an opened index."""
    return index.count()


def build_index(chunks: DataFrame, path: str, strategy: str, text_col: str = "dense_text", embedder: Embedder = hashed_bag_of_words, append: bool = False) -> DataFrame:
    """Writes the vector table of one strategy and returns it: the whole anew, or with ``append`` only chunk ids it lacks."""
    spark, target = chunks.sparkSession, f"{path}/strategy={strategy}"
    if append:
        chunks = chunks.join(open_index(spark, path, strategy).select("chunk_id"), "chunk_id", "left_anti")
    vectors = embed(chunks, "chunk_id", text_col, embedder)
    chunks.join(vectors, "chunk_id").write.mode("append" if append else "overwrite").parquet(target)
    return open_index(spark, path, strategy)


def open_index(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """The vector table of a strategy; RuntimeError where it was never built."""
    try:
        return spark.read.parquet(f"{path}/strategy={strategy}")
    except AnalysisException as error:
        raise RuntimeError(f"index {strategy!r} not found in {path}; build it first") from error
