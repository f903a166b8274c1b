"""BM25: an inverted index as stored tables, and exact top-k for many queries at once.

The index is cut into shards of chunks. A shard holds, for each of its terms, one row with the places of the chunks that have it and how
often; queries read only the rows of their terms, and each shard gives the best k of each query, zero scores included, so that
no pair of query and chunk is ever shuffled and no order is made over all chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import tokenize
from tessella.session import settle, union_all

#: Fixed values of the Okapi formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a shard and queries of a block: what one task scores at once.
SHARD_CHUNKS, QUERY_BLOCK = 20_000, 256
_TOKENS = re.compile("[a-z0-9]+")


@dataclass
class SparseIndex:
    """blocks (shard, term, at, tf), docs (shard, chunk_ids, dl), terms (term, df, idf), totals (one row: n, avgdl)."""

    blocks: DataFrame
    docs: DataFrame
    terms: DataFrame
    totals: DataFrame


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, chunk_id, tf, dl): how often each term occurs in each chunk, and how many tokens the chunk has."""
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), tokenize(F.col(text_col)).alias("tokens"))
    # explode_outer: for explode Spark would tokenize twice, once to filter out empty arrays
    exploded = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    return exploded.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).select("term", "chunk_id", "tf", "dl")


_SHARD = pa.schema([("shard", pa.int32()), ("term", pa.string()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("chunk_ids", pa.list_(pa.string())), ("dl", pa.list_(pa.int32()))])
_SHARD_DDL = "shard int, term string, at array<int>, tf array<int>, chunk_ids array<string>, dl array<int>"


def _shard(table: pa.Table) -> pa.Table:
    """The rows of one shard: its chunks in order of their ids, and each term's places among them."""
    rows = sorted(zip(table.column("chunk_id").to_pylist(), table.column("text").to_pylist(), strict=True))
    places: dict[str, list[int]] = {}
    times: dict[str, list[int]] = {}
    lengths = []
    for at, (_, text) in enumerate(rows):
        tokens = _TOKENS.findall((text or "").lower())
        lengths.append(len(tokens))
        for term, tf in Counter(tokens).items():
            places.setdefault(term, []).append(at)
            times.setdefault(term, []).append(tf)
    terms, shard = sorted(places), table.column("shard")[0].as_py()
    none = [None] * len(terms)
    return pa.table({"shard": [shard] * (len(terms) + 1), "term": [None, *terms], "at": [None, *(places[t] for t in terms)], "tf": [None, *(times[t] for t in terms)], "chunk_ids": [[i for i, _ in rows], *none], "dl": [lengths, *none]}, schema=_SHARD)


def _shards(chunks: DataFrame, id_col: str, text_col: str, shard_chunks: int) -> DataFrame:
    count = int(max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // shard_chunks)))
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).where(F.col("chunk_id").isNotNull())
    return rows.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(count)).cast("int")).repartition(count, "shard").groupBy("shard").applyInArrow(_shard, _SHARD_DDL)


def _of(shards: DataFrame) -> SparseIndex:
    """The index of shard rows. Negative idf become EPSILON times the mean over the vocabulary."""
    blocks = shards.where(F.col("term").isNotNull()).select("shard", "term", "at", "tf")
    docs = shards.where(F.col("term").isNull()).select("shard", "chunk_ids", "dl")
    totals = docs.agg(F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("cf"))
    totals = settle(totals.select("n", (F.col("cf") / F.greatest("n", F.lit(1))).alias("avgdl")))
    counted = settle(blocks.groupBy("term").agg(F.sum(F.size("at")).cast("long").alias("df")))
    raw = counted.crossJoin(F.broadcast(totals)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return SparseIndex(blocks, docs, terms, totals)


def build_index(chunks: DataFrame, id_col: str, text_col: str, shard_chunks: int = SHARD_CHUNKS) -> SparseIndex:
    """The index of ``text_col``, its shards kept by a checkpoint. A null text has no terms; rows with a null id take no part."""
    return _of(settle(_shards(chunks, id_col, text_col, shard_chunks)))


def write_index(chunks: DataFrame, id_col: str, text_col: str, path: str, shard_chunks: int = SHARD_CHUNKS) -> SparseIndex:
    """Writes the index of ``text_col`` and returns it, opened: shard rows in order of terms, so that a query's terms skip the others, and the terms."""
    _shards(chunks, id_col, text_col, shard_chunks).sortWithinPartitions("shard", "term").write.mode("overwrite").parquet(f"{path}/shards")
    built = _of(chunks.sparkSession.read.parquet(f"{path}/shards"))
    built.terms.write.mode("overwrite").parquet(f"{path}/terms")
    built.totals.write.mode("overwrite").parquet(f"{path}/totals")
    return open_index(chunks.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> SparseIndex:
    """A stored index; RuntimeError where there is none."""
    try:
        shards, terms, totals = (spark.read.parquet(f"{path}/{name}") for name in ("shards", "terms", "totals"))
    except AnalysisException as error:
        raise RuntimeError(f"sparse index not found in {path}; build it first") from error
    return SparseIndex(shards.where(F.col("term").isNotNull()).select("shard", "term", "at", "tf"), shards.where(F.col("term").isNull()).select("shard", "chunk_ids", "dl"), terms, totals)


def _rounded(values: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(values) * 1e6 + 0.5) / 1e6, values) + 0.0


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, best first, ties in order of place."""
    if k >= len(scores):
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    kept = np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]
    return kept[np.lexsort((kept, -scores[kept]))]


_FOUND = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("bm25_score", pa.float64())])


def _scored(k: int):  # noqa: ANN202
    """The best k chunks of one shard for each query of one block."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(row for row in rows if row["term"] is None)
        lengths, queries = np.array(head["dl"], dtype=np.float64), {q: n for n, q in enumerate(head["query_ids"])}
        norm = K1 * (1 - B + B * lengths / (head["avgdl"] or 1.0))
        scores = np.zeros((len(queries), len(lengths)))
        for row in rows:
            if row["term"] is not None:
                at, tf = np.array(row["at"]), np.array(row["tf"], dtype=np.float64)
                share = tf * (K1 + 1) / (tf + norm[at])
                for ask in row["asks"]:
                    scores[queries[ask["query_id"]], at] += ask["weight"] * share
        scores = _rounded(scores)
        ids = np.array(head["chunk_ids"], dtype=object)
        out: dict[str, list] = {name: [] for name in _FOUND.names}
        for query, number in queries.items():
            best = _best(scores[number], k)
            out["query_id"] += [query] * len(best)
            out["chunk_id"] += ids[best].tolist()
            out["bm25_score"] += scores[number][best].tolist()
        return pa.table(out, schema=_FOUND)

    return run


def top_k(index: SparseIndex, queries: DataFrame, k: int, query_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, rank, chunk_id, bm25_score): k rows of each query while there are chunks, those without a hit with score 0.

    Ties go by chunk_id. A repeated term counts each time; a null query text is one without terms; a null query id takes no part; a repeated query counts once. Blocks of queries
    meet the shards; of a shard only the rows of the block's terms are read. Shuffled are those rows and k rows for each query and shard.
    """
    asked = queries.select(F.col(query_col).cast("string").alias("query_id"), F.col(text_col).alias("question")).where(F.col("query_id").isNotNull()).dropDuplicates(["query_id"])
    count = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int"))
    counted = asked.select("block", "query_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("block", "query_id", "term").agg(F.count("*").alias("qtf"))
    weighed = counted.join(index.terms.select("term", "idf"), "term").select("block", "term", F.struct("query_id", (F.col("qtf") * F.col("idf")).alias("weight")).alias("ask"))
    weighed = settle(weighed.groupBy("block", "term").agg(F.collect_list("ask").alias("asks")))  # at most QUERY_BLOCK queries a row
    held = asked.groupBy("block").agg(F.collect_list("query_id").alias("query_ids"))
    matched = index.blocks.join(weighed, "term").select("shard", "block", "term", "at", "tf", "asks")
    heads = index.docs.crossJoin(F.broadcast(index.totals.select("avgdl"))).crossJoin(held)  # shards by blocks of queries
    both = union_all(matched, heads.select("shard", "block", "chunk_ids", "dl", "avgdl", "query_ids"), missing=True)
    near = both.groupBy("shard", "block").applyInArrow(_scored(k), "query_id string, chunk_id string, bm25_score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25_score"), "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "bm25_score")
