"""Exact top-k search with vector-approximation files.

Every shard's vectors are approximated by the cell of each component, sixteen cells a
dimension bounded by the shard's quantiles.  A query first scans the cells: the edges of a
cell bound the inner product from above and below.  Exact vectors are then read in the
order of their upper bounds, until the next bound is below the kth exact score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from panelloom.llm.common import gathered
from panelloom.llm.vectors import (
    BLOCK_QUERIES, SHARD_ROWS, Copies, is_query, ranked, search, shards, usable,
)

CELLS = 16
# Exact vectors read in one step.
STEP = 32
# Sums below this are exact in double precision.
EXACT = float(1 << 53)


class CellFile:
    """The approximation of one shard: a cell per vector and dimension, and cell edges."""

    def __init__(self, vectors: np.ndarray):
        dims = vectors.shape[1]
        self.cells = np.zeros(vectors.shape, np.uint8)
        self.low = np.zeros((dims, CELLS))
        self.high = np.zeros((dims, CELLS))
        cuts = np.quantile(vectors, np.arange(1, CELLS) / CELLS, axis=0)
        for d in range(dims):
            self.cells[:, d] = np.searchsorted(cuts[:, d], vectors[:, d], side="right")
            # Edges are the least and greatest component that really lies in the cell.
            order = np.argsort(self.cells[:, d], kind="stable")
            used, first = np.unique(self.cells[order, d], return_index=True)
            self.low[d, used] = np.minimum.reduceat(vectors[order, d], first)
            self.high[d, used] = np.maximum.reduceat(vectors[order, d], first)
        every = np.arange(dims)
        self.below = self.low[every, self.cells]
        self.above = self.high[every, self.cells]

    def upper(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, queries x vectors."""
        return np.maximum(queries, 0) @ self.above.T + np.minimum(queries, 0) @ self.below.T

    def lower(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.below.T + np.minimum(queries, 0) @ self.above.T


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors)


def top_in_shard(k: int):
    def best(ids, counts, matrix, query_ids, asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        copies = Copies(ids, counts, matrix, k)
        points = copies.matrix
        # Where sums might round, bounds are widened and scores are taken as integers.
        largest = float(np.abs(points).max(initial=0)) * float(np.abs(asked).max(initial=0))
        exact = largest * points.shape[1] < EXACT
        slack = 0.0 if exact else largest * points.shape[1] * 1e-12
        file = CellFile(points)
        whole = points if exact else points.astype(np.int64).astype(object)
        for begin in range(0, len(asked), 256):
            some = asked[begin : begin + 256]
            upper, lower = file.upper(some) + slack, file.lower(some) - slack
            # k vectors score at least the kth lower bound (one may be the query's own).
            sure = min(k, lower.shape[1] - 1)
            floor = np.partition(lower, lower.shape[1] - 1 - sure, axis=1)[
                :, lower.shape[1] - 1 - sure
            ]
            if lower.shape[1] <= k:
                floor = np.full(len(some), -np.inf)
            for j in range(len(some)):
                near = np.flatnonzero(upper[j] >= floor[j])
                near = near[np.argsort(-upper[j, near], kind="stable")]
                q = some[j] if exact else some[j].astype(np.int64).astype(object)
                got_ids = np.zeros(0, np.int64)
                got = np.zeros(0, np.int64)
                at = 0
                while at < len(near):
                    if len(got) >= k and upper[j, near[at]] < got[k - 1]:
                        break
                    read = near[at : at + STEP]
                    at += STEP
                    score = (whole[read] @ q).astype(np.int64)
                    sizes = copies.sizes[read]
                    new_ids = copies.ids[gathered(copies.starts[read], sizes)]
                    new = np.repeat(score, sizes)
                    other = new_ids != query_ids[begin + j]
                    got_ids = np.append(got_ids, new_ids[other])
                    got = np.append(got, new[other])
                    order = ranked(got_ids, got, k)
                    got_ids, got = got_ids[order], got[order]
                yield got_ids, got

    return best


def exact_top_k(
    vectors: DataFrame, k: int = 5, query_every: int = 50,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Exact top ``k`` by the inner product of floor(256 x): query_id, rank, vec_id, score.

    Queries are the vectors whose id is divisible by ``query_every``; candidates are all
    with another id.  Vectors that are null, empty or hold null or non-finite components,
    and rows without id, take no part.  Only vectors of equal dimension are compared.  Ties
    go to the smaller id.  A query without candidates has no rows; a repeated query row is
    answered once, and repeated candidate rows count each.  Products must fit a long.
    """
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    asked = rows.where(is_query(query_every)).dropDuplicates(["vec_id"])
    files = shards(rows, SHARD_ROWS, quantised, "cells")
    blocks = shards(asked, BLOCK_QUERIES, quantised, "queries")
    return search(files, blocks, "float64", "long", k, top_in_shard(k))
