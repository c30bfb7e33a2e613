"""Exact cosine search: blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one broadcast block (64 dimensions: 5 MB).
QUERY_BLOCK = 10_000
#: Rows and queries of one product of matrices (8 MB of scores).
ROW_TILE, QUERY_TILE = 4_096, 256

RESULT = "query_id long, vec_id long, label int, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return rows.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first(k: int, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Where the k best entries of each query are: highest score first (NaN before all, as in SQL), then the smallest id."""
    order = np.lexsort((vec, -np.where(np.isnan(score), np.inf, score), query))
    own = query[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _tile(rows: np.ndarray, vec: np.ndarray, units: np.ndarray, least: np.ndarray, k: int) -> list[np.ndarray]:
    """(row, query, score) of the k best rows for each query among those that reach its ``least``."""
    scores = np.round(rows @ units.T, 4) + 0.0
    key = np.where(np.isnan(scores), np.inf, scores)
    if len(rows) > k:
        least = np.maximum(least, np.partition(key, -k, axis=0)[-k]) if np.isneginf(least).any() else least
    at, query = np.nonzero(key >= least)
    score = scores[at, query]
    kept = _first(k, query, score, vec[at])
    return [at[kept], query[kept], score[kept]]


def _scan(block, k: int):
    """The k best rows of a task for each query of the block; what is held is k rows a query and one tile of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = block.value
        query, score, vec, label = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(start, ROW_TILE)
                own_vec, own_label, rows = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), _unit(_matrix(part.column(2)))
                found = [[query], [score], [vec], [label]]
                for low in range(0, len(ids), QUERY_TILE):
                    at, q, x = _tile(rows, own_vec, units[low : low + QUERY_TILE], least[low : low + QUERY_TILE], k)
                    for own, more in zip(found, (q + low, x, own_vec[at], own_label[at]), strict=True):
                        own.append(more)
                query, score, vec, label = (np.concatenate(x) for x in found)
                kept = _first(k, query, score, vec)
                query, score, vec, label = query[kept], score[kept], vec[kept], label[kept]
                full = np.bincount(query, minlength=len(ids)) == k
                worst = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.empty(0, np.int64)
                least[query[worst]] = np.where(full[query[worst]], np.where(np.isnan(score[worst]), np.inf, score[worst]), -np.inf)
        for start in range(0, len(query), 10_000):
            cut = slice(start, start + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[query[cut]]), pa.array(vec[cut]), pa.array(label[cut], pa.int32()), pa.array(score[cut])], names=["query_id", "vec_id", "label", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, label, score): the k rows with the highest cosine, four digits, for every query.

    ``vectors``: vec_id, label, embedding; ``queries``: query_id, q.  Each block of
    queries is broadcast to a scan of all rows; a task of it holds scores in tiles
    and passes on k rows a query, so neither memory nor what is shuffled grows with
    rows x queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding")
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = []
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if own.num_rows:
            block = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), _unit(_matrix(own.column("q").combine_chunks()))))
            found.append(rows.mapInArrow(_scan(block, k), RESULT))
    if not found:
        return spark.createDataFrame([], RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
