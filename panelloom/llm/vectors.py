"""Vectors in shards and queries in blocks, as both nearest-neighbour operators use them.

A shard is one row that holds a bounded number of vectors; a query block is one row that
holds a bounded number of queries.  Each pair of a shard and a block of equal dimension is
one piece of work, so no task holds more than one of each and work spreads over
shards x blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.llm.common import stored

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
SHARD_SCHEMA = "dim int, shard int, ids array<long>, counts array<long>, data binary"
FOUND_SCHEMA = "query_id long, vec_ids array<long>, scores array<{kind}>"


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """Rows (vec_id, vector as doubles, dim) whose vector is whole: not null or empty, each
    component there and finite; with ``nonzero`` also some component other than 0.  Rows
    without an id are left out as well."""
    v = F.col(vector_col)
    whole = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    keep = F.col(id_col).isNotNull() & (F.size(v) > 0) & whole
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(keep, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        v.cast("array<double>").alias("vector"),
        F.size(v).alias("dim"),
    )


def shards(
    rows: DataFrame, size: int, prepare: Callable[[np.ndarray], np.ndarray], name: str
) -> DataFrame:
    """Rows (vec_id, vector, dim) in shards of about ``size``, stored: dim, shard, ids,
    counts, data (the matrix ``prepare`` makes, as bytes).  Repeated rows are one with their
    count.  A vector's shard follows from its id and content, so copies of one vector and
    vectors of one id spread over all shards."""
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    n = max(1, math.ceil(most / size))
    dealt = (
        rows.groupBy("vec_id", "vector", "dim")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int"))
    )

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        data = prepare(np.stack(pdf["vector"].to_numpy()))
        return pd.DataFrame(
            {
                "dim": [key[0]],
                "shard": [key[1]],
                "ids": [pdf["vec_id"].to_numpy(np.int64)],
                "counts": [pdf["n"].to_numpy(np.int64)],
                "data": [np.ascontiguousarray(data).tobytes()],
            }
        )

    return stored(dealt.groupBy("dim", "shard").applyInPandas(pack, SHARD_SCHEMA), name)


def search(
    candidates: DataFrame,
    queries: DataFrame,
    dtype: str,
    kind: str,
    k: int,
    best: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator],
) -> DataFrame:
    """Each query's ``k`` best over all shards: query_id, rank, vec_id, score.

    ``best(ids, counts, matrix, query_ids, query_matrix)`` yields for each query its best ids and
    scores in one shard.  Every shard and block meet once.
    """
    # Query blocks go to the shards of their dimension, of which there are few numbers.
    places = candidates.select("dim", F.col("shard").alias("_to"))
    sent = queries.select(
        "dim", F.col("ids").alias("query_ids"), F.col("data").alias("query_data"),
        F.col("shard").alias("block"),
    ).join(places, "dim")
    # Only the key of the shard goes along with the block; its vectors stay where they are.
    met = candidates.join(
        sent.withColumnRenamed("_to", "shard"), ["dim", "shard"]
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = np.asarray(r.ids, np.int64)
                matrix = np.frombuffer(r.data, dtype).reshape(len(ids), -1)
                query_ids = np.asarray(r.query_ids, np.int64)
                asked = np.frombuffer(r.query_data, dtype).reshape(len(query_ids), -1)
                found = list(best(ids, np.asarray(r.counts, np.int64), matrix, query_ids, asked))
                yield pd.DataFrame(
                    {
                        "query_id": query_ids,
                        "vec_ids": [f[0] for f in found],
                        "scores": [f[1] for f in found],
                    }
                )

    part = met.mapInPandas(scan, FOUND_SCHEMA.format(kind=kind))
    pairs = part.select(
        "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("_p")
    ).select("query_id", F.col("_p.vec_ids").alias("vec_id"), F.col("_p.scores").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        pairs.withColumn("rank", F.row_number().over(by).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def is_query(every: int) -> Column:
    return F.pmod(F.col("vec_id"), F.lit(every)) == 0


def ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Copies:
    """Equal vectors of a shard as one, with their smallest ids.

    A query's ``k`` best hold at most ``k`` copies of one vector, and one more id may be the
    query's own, so the ``k + 1`` smallest different ids of each are all that can count.  An
    id stands as often as its rows are repeated, ``k`` times at most.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray, matrix: np.ndarray, k: int):
        raw = np.ascontiguousarray(matrix + 0)
        key = raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel()
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        ids, of, counts = ids[order], of[order], counts[order]
        # Rows of one id whose vectors became equal are one entry.
        new = np.append(True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]))
        counts = np.minimum(np.add.reduceat(counts, np.flatnonzero(new)), k)
        ids, of = ids[new], of[new]
        begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        place = np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))
        keep = place <= k
        self.matrix = matrix[first]
        self.ids = np.repeat(ids[keep], counts[keep])
        of = np.repeat(of[keep], counts[keep])
        self.starts = np.searchsorted(of, np.arange(len(first)))
        self.sizes = np.bincount(of, minlength=len(first))
