"""Exact dense top-k.

``top_k`` sets blocks of queries against all blocks of vectors. A cell index spares most of them: vectors are stored by the nearest of some centers, a query first
asks the cells nearest to it, and then only those whose bound (by the angle between query and center and the widest angle in the cell) reaches
its k-th score so far. No cell that could hold a better or an equal score is left out, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.session import settle, union_all

#: Vectors in a block, and queries in one.
BLOCK, QUERY_BLOCK = 4096, 256
#: Vectors a cell should have, most centers of an index, the vectors they are fitted on at most, rounds of fitting, and cells a query asks first.
CELL, MOST_CELLS, SAMPLE, ROUNDS, PROBES = 20_000, 1024, 20_000, 8, 4


def _blocks(df: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """Rows (ids, vectors) of at most ``block`` vectors, as they come."""
    schema = pa.schema([("ids", pa.list_(pa.string())), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                vectors = np.array(part.column(1).to_pylist(), dtype=np.float64)
                yield pa.RecordBatch.from_pydict({"ids": [part.column(0).to_pylist()], "vectors": [vectors.tobytes()]}, schema=schema)

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull()).mapInArrow(run, "ids array<string>, vectors binary")


def top_k(queries: DataFrame, query_id: str, query_vector: str, index: DataFrame, index_id: str, index_vector: str, k: int, *, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k largest dot products of each query, rounded to 6 places; ties go by id as a string.

    Blocks are joined with blocks; each task keeps k rows a query, so what is shuffled is k rows for each pair of
    blocks and query. Spark broadcasts the queries' blocks only while they are below its size threshold. Null ids and vectors take no part.
    """
    asked = _blocks(queries, query_id, query_vector, block).toDF("q_ids", "q_vectors")
    held = _blocks(index, index_id, index_vector, block)
    near = _scored(held.crossJoin(asked), k)
    return _ranked(near, k)


_NEAR = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())])


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each pair of blocks (ids, vectors, q_ids, q_vectors) the best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.array(row["ids"], dtype=object), row["q_ids"]
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                vectors = np.frombuffer(row["vectors"]).reshape(len(ids), -1)[order]
                asked_for = np.frombuffer(row["q_vectors"]).reshape(len(q_ids), -1)
                scores = np.floor(asked_for @ vectors.T * 1e6 + 0.5) / 1e6
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                taken = np.take_along_axis(scores, best, axis=1)
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.array(q_ids, dtype=object), best.shape[1]).tolist(), "id": ids[best.ravel()].tolist(), "score": taken.ravel()}, schema=_NEAR)

    return pairs.select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id string, id string, score double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@dataclass
class CellIndex:
    """blocks (cell, ids, vectors) of all vectors, and bounds (cell, center, least_cosine, least_norm, most_norm), one row a cell."""

    blocks: DataFrame
    bounds: DataFrame


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None], norms


def _centers(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of ``count`` groups of the sample's vectors."""
    units, norms = _unit(sample)
    units = np.unique(units[norms > 0], axis=0)
    if len(units) <= count:
        return units
    centers = units[np.random.default_rng(0).choice(len(units), count, replace=False)]
    for _ in range(ROUNDS):
        own = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, units)
        moved, lengths = _unit(sums)
        centers = np.where(lengths[:, None] > 0, moved, centers)
    return centers


def write_cells(df: DataFrame, id_col: str, vector_col: str, path: str, *, block: int = BLOCK) -> CellIndex:
    """Writes the cell index of all vectors and returns it, opened. Centers, at most MOST_CELLS, are fitted on at most SAMPLE vectors; null ids and vectors take no part.

    Vectors of length zero are a cell of their own, -1. A cell that holds many vectors is many blocks, written by many tasks.
    """
    session = df.sparkSession
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    total = rows.count()
    every = max(1, total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("v").limit(SAMPLE).collect()
    centers = _centers(np.array([r.v for r in sample], dtype=np.float64).reshape(len(sample), -1), min(MOST_CELLS, 1 + total // CELL)) if sample else np.zeros((0, 0))
    shared = session.sparkContext.broadcast(centers)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units, norms = _unit(np.array(batch.column(1).to_pylist(), dtype=np.float64))
                cells = np.where(norms > 0, (units @ shared.value.T).argmax(axis=1), -1) if len(shared.value) else np.full(len(norms), -1)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch.column(0), batch.column(1)], names=["cell", "id", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("cell", pa.int32()), ("ids", pa.list_(pa.string())), ("vectors", pa.binary())])
        held: dict[int, tuple[list, list]] = {}

        def given(cell: int) -> pa.RecordBatch:
            ids, vectors = held.pop(cell)
            return pa.RecordBatch.from_pydict({"cell": [cell], "ids": [ids], "vectors": [np.array(vectors, dtype=np.float64).tobytes()]}, schema=schema)

        for batch in batches:
            for cell, key, vector in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids, vectors = held.setdefault(cell, ([], []))
                ids.append(key)
                vectors.append(vector)
                if len(ids) >= block:
                    yield given(cell)
            for cell in [c for c in held if c != batch.column(0)[-1].as_py()]:  # rows come in order of cells
                yield given(cell)
        for cell in list(held):
            yield given(cell)

    parts = max(session.sparkContext.defaultParallelism, total // 200_000)
    by_cell = rows.mapInArrow(assigned, "cell int, id string, v array<double>").repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(1 + total // 4_000_000))).sortWithinPartitions("cell")
    by_cell.mapInArrow(blocks, "cell int, ids array<string>, vectors binary").write.mode("overwrite").parquet(f"{path}/blocks")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                units, norms = _unit(np.frombuffer(row["vectors"]).reshape(len(row["ids"]), -1))
                center = shared.value[row["cell"]] if row["cell"] >= 0 else np.zeros(units.shape[1])
                yield pa.RecordBatch.from_pydict({"cell": pa.array([row["cell"]], pa.int32()), "center": pa.array([center.tolist()], pa.list_(pa.float64())), "cosine": [float((units @ center).min())], "low": [float(norms.min())], "high": [float(norms.max())]})

    seen = session.read.parquet(f"{path}/blocks").mapInArrow(measured, "cell int, center array<double>, cosine double, low double, high double")
    bounds = seen.groupBy("cell").agg(F.first("center").alias("center"), F.min("cosine").alias("least_cosine"), F.min("low").alias("least_norm"), F.max("high").alias("most_norm"))
    bounds.write.mode("overwrite").parquet(f"{path}/bounds")
    return open_cells(session, path)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    """A stored cell index; RuntimeError where there is none."""
    try:
        return CellIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/bounds"))
    except AnalysisException as error:
        raise RuntimeError(f"vector index not found in {path}; build it first") from error


def most_scores(vectors: np.ndarray, centers: np.ndarray, cosines: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and cell a score that no vector of the cell exceeds."""
    units, norms = _unit(vectors)
    apart = np.arccos(np.clip(units @ centers.T, -1.0, 1.0)) - np.arccos(np.clip(cosines, -1.0, 1.0))[None, :]
    bound = np.cos(np.clip(apart, 0.0, np.pi))
    return norms[:, None] * np.where(bound >= 0, bound * high[None, :], bound * low[None, :]) + 2e-6


def top_k_cells(index: CellIndex, queries: DataFrame, query_id: str, query_vector: str, k: int) -> DataFrame:
    """(query_id, rank, id, score) as ``top_k`` gives it, from a cell index; a repeated query id counts once.

    The bounds, at most MOST_CELLS rows, are sent to all tasks; queries meet blocks by an equal join on cells, in blocks of QUERY_BLOCK queries.
    """
    asked = queries.select(F.col(query_id).cast("string").alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("query_id").isNotNull()).dropDuplicates(["query_id"])
    table = index.bounds.orderBy("cell").collect()
    if not table:
        return _ranked(asked.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score")).limit(0), k)
    cells = np.array([r.cell for r in table])
    shared = asked.sparkSession.sparkContext.broadcast((cells, np.array([r.center for r in table], dtype=np.float64), *(np.array([r[c] for r in table]) for c in ("least_cosine", "least_norm", "most_norm"))))

    def wanted(first: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, centers, cosines, low, high = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                most = most_scores(vectors, centers, cosines, low, high)
                order = np.argsort(-most, axis=1, kind="stable")[:, :PROBES]
                chosen = np.zeros(most.shape, dtype=bool)
                np.put_along_axis(chosen, order, True, axis=1)
                if not first:
                    least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                    chosen = ~chosen & (most >= least[:, None])
                row, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(cells[cell], pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["cell", "query_id", "v"])

        return run

    def near(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).agg(F.collect_list(F.struct("query_id", "v")).alias("asks"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    vectors = np.array([a["v"] for a in row["asks"]], dtype=np.float64)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([row["cell"]], pa.int32()), "q_ids": pa.array([[a["query_id"] for a in row["asks"]]], pa.list_(pa.string())), "q_vectors": pa.array([vectors.tobytes()], pa.binary())})

        blocks = grouped.select("cell", "asks").mapInArrow(packed, "cell int, q_ids array<string>, q_vectors binary")
        return _scored(index.blocks.join(blocks, "cell"), k)

    shape = "cell int, query_id string, v array<double>"
    if len(cells) <= PROBES:  # all are asked, so blocks of queries meet the few blocks there are
        return _ranked(_scored(index.blocks.select("ids", "vectors").crossJoin(_blocks(asked, "query_id", "v", QUERY_BLOCK).toDF("q_ids", "q_vectors")), k), k)
    asked = settle(asked)  # a vector a query
    groups = 1 + asked.count() // QUERY_BLOCK
    first = settle(_ranked(near(asked.mapInArrow(wanted(True), shape)), k))  # k rows a query
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = near(asked.join(least, "query_id", "left").select("query_id", "v", "least").mapInArrow(wanted(False), shape))
    return _ranked(union_all(first.select("query_id", "id", "score"), rest), k)


def nearest(index: DataFrame, index_id: str, index_vector: str, vector: list[float], k: int) -> DataFrame:
    """(rank, id, score): the k vectors nearest to one by cosine, rounded to 6 places; ties go by id as a string. One query needs no join: each task keeps k rows."""
    given = F.array(*(F.lit(float(x)) for x in vector))
    scored = index.where(F.col(index_vector).isNotNull() & F.col(index_id).isNotNull()).select(F.col(index_id).cast("string").alias("id"), F.round(cosine(F.col(index_vector).cast("array<double>"), given), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"), "id", "score")
