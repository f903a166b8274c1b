"""Scans of the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class MissingInput(FileNotFoundError):
    """An input of a step does not exist; the message names the step that writes it."""


def table(spark: SparkSession, folder: str, name: str, made_by: str | None = None) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; MissingInput where there is none."""
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            hint = f"; run {made_by} first" if made_by else ""
            raise MissingInput(f"no table {name} in {folder}{hint}") from error
        raise
