"""Both nearest-neighbour operators against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm import topk_cells, vantage

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def vector_rows() -> list[tuple]:
    """Random vectors, a hot group of copies, ties, and every kind of unusable vector."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(300)]
    copy = [0.5, -0.25, 1.0, 0.0, 2.0, -1.5]
    rows += [(i, copy, 0) for i in range(300, 450)]
    rows += [(500, [0.0] * 6, 0), (501, None, 0), (502, [], 0), (None, copy, None)]
    rows += [(520, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(540, [float("nan")] + [1.0] * 5, 1), (560, [float("inf")] + [1.0] * 5, 1)]
    # Another dimension; one query there without candidates in a third one.
    rows += [(600, [1.0, 2.0], 2), (601, [2.0, 1.0], 2), (602, [-1.0, 0.5], 2), (700, [3.0], 2)]
    # Rows of one query that are repeated are answered once.
    return rows + [rows[0], rows[100]]


def best_by_hand(rows, k, every, change, nonzero):
    good = []
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        if nonzero and not any(v):
            continue
        good.append((i, change(np.array(v, np.float32).astype(float))))
    result = {}
    for i, q in good:
        if i % every == 0 and i not in result:
            found = [(float(q @ v), j) for j, v in good if j != i and len(v) == len(q)]
            found.sort(key=lambda f: (-f[0], f[1]))
            result[i] = found[:k]
    return result


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS).repartition(5)
    for name in ("dim", "shard", "ids", "data", "rank", "score", "query_id", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in found.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return found


@pytest.mark.parametrize("shard", [16, 8192])
def test_cells_give_the_exact_top_k(vectors, monkeypatch, shard):
    monkeypatch.setattr(topk_cells, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_cells, "BLOCK_QUERIES", 4)
    found = answers(topk_cells.exact_top_k(vectors, k=5, query_every=50))
    wanted = best_by_hand(vector_rows(), 5, 50, lambda v: np.floor(256 * v), False)
    wanted = {q: rows for q, rows in wanted.items() if rows}
    assert found.keys() == wanted.keys()
    for q, rows in wanted.items():
        assert [(j, s) for _, j, s in found[q]] == [(j, int(s)) for s, j in rows]


@pytest.mark.parametrize("shard", [16, 8192])
def test_vantage_trees_of_factor_one_are_exact(vectors, monkeypatch, shard):
    monkeypatch.setattr(vantage, "SHARD_ROWS", shard)
    monkeypatch.setattr(vantage, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(vantage, "LEAF", 8)
    found = answers(vantage.nearest(vectors, k=20, query_every=20))
    wanted = best_by_hand(vector_rows(), 20, 20, lambda v: v, True)
    wanted = {q: rows for q, rows in wanted.items() if rows}
    assert found.keys() == wanted.keys()
    for q, rows in wanted.items():
        assert [j for _, j, _ in found[q]] == [j for _, j in rows]
        assert np.allclose([s for _, _, s in found[q]], [s for s, _ in rows], rtol=1e-12)


def test_a_larger_factor_reads_less_and_finds_most():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(6000, 8))
    tree_points = vantage.lifted(points)
    tree = vantage.build(tree_points, np.arange(len(points)), rng)
    asked = np.column_stack([points[:200], np.zeros(200)])
    read, kept = [], []
    exact = np.argsort(-(points[:200] @ points.T), axis=1)[:, :20]
    for factor in (1.0, 1.05):
        hunt = vantage.Search(tree_points, asked, 20, factor)
        hunt.visit(tree, np.arange(200))
        read.append(hunt.read)
        kept.append(np.mean([len(set(e) & set(f)) / 20 for e, f in zip(exact, hunt.found)]))
    assert kept[0] == 1.0
    assert read[1] < read[0] and kept[1] >= 0.9


def test_no_vectors_give_no_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk_cells.exact_top_k(none).count() == 0
    assert vantage.nearest(none).count() == 0
