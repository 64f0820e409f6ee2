"""Approximate nearest neighbours with vantage-point trees.

The largest inner product is the least distance once every vector x of a shard gets one
more component sqrt(M^2 - |x|^2), M being the largest norm: distances to a query with 0
there are |q|^2 + M^2 - 2 q.x.  A tree splits a shard by the distance to vantage points.
The search enters the nearer side first and leaves out a side when ``factor`` times its
distance by the triangle inequality exceeds the kth best: factor 1 is exact, larger
factors read less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from panelloom.llm.common import gathered
from panelloom.llm.vectors import (
    BLOCK_QUERIES, SHARD_ROWS, Copies, is_query, ranked, search, shards, usable,
)

LEAF = 256
SEED = 7


class Node:
    __slots__ = ("far", "inner", "inner_range", "members", "outer", "outer_range", "vantage")


def lifted(points: np.ndarray) -> np.ndarray:
    """Points with the component that makes all norms equal."""
    norms = np.einsum("ij,ij->i", points, points)
    most = norms.max(initial=0.0)
    return np.column_stack([points, np.sqrt(np.maximum(most - norms, 0.0))])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = points - to
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def build(points: np.ndarray, members: np.ndarray, rng: np.random.Generator) -> Node:
    """Tree over ``members``; of a few random vantage points the one whose distances spread
    most is taken.  Members all at one distance stay in one leaf."""
    node = Node()
    node.members, node.vantage = members, None
    if len(members) <= LEAF:
        return node
    tried = rng.choice(members, size=3, replace=False)
    spread = [distances(points[members], points[t]) for t in tried]
    best = int(np.argmax([s.std() for s in spread]))
    d = spread[best]
    near = d < np.median(d)
    if not near.any() or near.all():
        return node
    node.vantage = points[tried[best]]
    node.inner_range = (d[near].min(), d[near].max())
    node.outer_range = (d[~near].min(), d[~near].max())
    node.inner = build(points, members[near], rng)
    node.outer = build(points, members[~near], rng)
    node.members = None
    return node


class Search:
    """k nearest of a batch of queries in one tree."""

    def __init__(self, points: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.points, self.queries, self.k, self.factor = points, queries, k, factor
        self.kth = np.full(len(queries), np.inf)
        self.found = np.zeros((len(queries), 0), np.int64)
        self.dist = np.zeros((len(queries), 0))
        self.norms = np.einsum("ij,ij->i", points, points)
        # A distance may be off by the root of the rounding of its square.
        square = np.einsum("ij,ij->i", queries, queries) + self.norms.max(initial=0.0)
        self.slack = 1e-7 * np.sqrt(square)
        self.read = 0
        self.found = np.full((len(queries), k), -1, np.int64)
        self.dist = np.full((len(queries), k), np.inf)

    def visit(self, node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.vantage is None:
            self._scan(node.members, active)
            return
        d = distances(self.queries[active], node.vantage)
        bounds = {}
        for side, (low, high) in (("inner", node.inner_range), ("outer", node.outer_range)):
            bounds[side] = np.maximum(np.maximum(low - d, d - high), 0.0)
        inside = bounds["inner"] <= bounds["outer"]
        for first, second, chosen in (
            ("inner", "outer", inside), ("outer", "inner", ~inside)
        ):
            mine = active[chosen]
            for side in (first, second):
                open_ = bounds[side][chosen] * self.factor <= self.kth[mine] + self.slack[mine]
                self.visit(getattr(node, side), mine[open_])

    def _scan(self, members: np.ndarray, active: np.ndarray) -> None:
        q = self.queries[active]
        self.read += len(members) * len(active)
        square = (
            np.einsum("ij,ij->i", q, q)[:, None] + self.norms[members] - 2 * q @ self.points[members].T
        )
        d = np.sqrt(np.maximum(square, 0.0))
        found = np.concatenate([self.found[active], np.broadcast_to(members, d.shape)], axis=1)
        d = np.concatenate([self.dist[active], d], axis=1)
        pick = np.argpartition(d, self.k - 1, axis=1)[:, : self.k]
        self.dist[active] = np.take_along_axis(d, pick, axis=1)
        self.found[active] = np.take_along_axis(found, pick, axis=1)
        self.kth[active] = self.dist[active].max(axis=1)


def measured(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.add.accumulate(vectors * query, axis=1)[:, -1]


def nearest_in_shard(k: int, factor: float):
    def best(ids, counts, matrix, query_ids, asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        copies = Copies(ids, counts, matrix, k)
        points = lifted(copies.matrix)
        tree = build(points, np.arange(len(points)), np.random.default_rng(SEED))
        # One more than k for the query's own vector, and some for ties within rounding.
        hunt = Search(points, np.column_stack([asked, np.zeros(len(asked))]), k + 4, factor)
        hunt.visit(tree, np.arange(len(asked)))
        size = hunt.norms.max(initial=0.0)
        for j in range(len(asked)):
            at = hunt.found[j][hunt.found[j] >= 0]
            # The measure itself, on the vectors as given, summed from the first component on.
            score = measured(copies.matrix[at], asked[j])
            # Where the last vectors found tie within rounding with the last that can
            # count, all that reach its score are looked at.
            slack = 1e-12 * (size + asked[j] @ asked[j])
            if len(at) == hunt.k:
                last = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                if score.min() >= last - slack:
                    at = np.flatnonzero(copies.matrix @ asked[j] >= last - slack)
                    score = measured(copies.matrix[at], asked[j])
            sizes = copies.sizes[at]
            got_ids = copies.ids[gathered(copies.starts[at], sizes)]
            got = np.repeat(score, sizes)
            other = got_ids != query_ids[j]
            got_ids, got = got_ids[other], got[other]
            order = ranked(got_ids, got, k)
            yield got_ids[order], got[order]

    return best


def same(vectors: np.ndarray) -> np.ndarray:
    return vectors


def nearest(
    vectors: DataFrame, k: int = 20, query_every: int = 20, factor: float = 1.0,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``k`` nearest by largest inner product: query_id, rank, vec_id, score.

    Queries are the vectors whose id is divisible by ``query_every``; candidates are all
    with another id.  Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without id, take no part; only vectors of equal dimension are
    compared.  Ties go to the smaller id.  A repeated query row is answered once; repeated
    candidate rows count each.  With factor 1 the result is exact.
    """
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    asked = rows.where(is_query(query_every)).dropDuplicates(["vec_id"])
    trees = shards(rows, SHARD_ROWS, same, "trees")
    blocks = shards(asked, BLOCK_QUERIES, same, "queries")
    return search(trees, blocks, "float64", "double", k, nearest_in_shard(k, factor))
