"""Near duplicates among vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import near_vectors
from test_vectors import VECTORS


def floats(v):
    return [float(x) for x in v]


def rows():
    rng = np.random.default_rng(6)
    out = [(i, floats(rng.normal(size=32)), 0) for i in range(1, 500)]
    centre = rng.normal(size=32)
    # A group of near copies, a chain, equal vectors and multiples of one.
    out += [(i, floats(centre + 0.05 * rng.normal(size=32)), 0) for i in range(600, 690)]
    step = np.eye(32)
    out += [
        (700 + i, floats(np.cos(0.25 * i) * step[0] + np.sin(0.25 * i) * step[1]), 0) for i in range(12)
    ]
    one = rng.normal(size=32)
    out += [(i, floats(one), 0) for i in range(800, 860)]
    out += [(860 + i, floats(np.float32(one) * 2.0**i), 0) for i in range(1, 4)]
    out += [(5, floats(centre), 1)]
    big = 2**53
    out += [(big + 1, floats(step[9]), 0), (big + 3, floats(step[9] + 0.01 * step[10]), 0)]
    # Vectors that take no part, another dimension, repeated rows.
    out += [(900, [0.0] * 32, 0), (901, None, 0), (902, [], 0), (903, [float("nan")] * 32, 0)]
    out += [(904, [None] + [1.0] * 31, 0), (905, [float("inf")] + [1.0] * 31, 0)]
    out += [(None, floats(one), 0), (None, None, None)]
    out += [(910, [1.0, 2.0], 0), (911, [2.0, 4.1], 0), (912, [-1.0, 2.0], 0), (913, [3.0], 0)]
    out += [(920, floats(1e30 * step[3]), 0), (921, floats(1e-30 * step[3]), 0)]
    return out + [out[0], out[520], out[520]]


def by_hand(all_rows, cosine):
    nodes = {}
    for i, v, _ in all_rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        nodes[i, tuple(x)] = x / np.abs(x).max()
    keys = list(nodes)
    links = {k: [] for k in keys}
    for a in keys:
        for b in keys:
            x, y = nodes[a], nodes[b]
            if a != b and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a].append(b)
    label = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        label[k] = min(s[0] for s in seen)
    out = []
    for i, v, _ in all_rows:
        key = (i, tuple(np.array(v, np.float32).astype(float))) if v and None not in v else None
        if key in nodes:
            out.append((i, len(links[key]), label[key], i == label[key]))
        else:
            out.append((i, 0, i, True))
    return out


def ordered(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("block", [4096, 8])
def test_links_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    df = spark.createDataFrame(rows(), VECTORS).repartition(7)
    for name in ("node", "vector", "dim", "copies", "links", "Least"):
        df = df.withColumn(name, F.lit("clash"))
    found = near_vectors.near_vectors(df, 0.95).collect()
    assert ordered(found) == ordered(by_hand(rows(), 0.95))


def test_nothing_gives_nothing(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, where codes differ most."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    near = 0.9505 * base + np.sqrt(1 - 0.9505**2) * aside
    some = [(i, floats(v), 0) for i, v in enumerate(np.concatenate([base, near]))]
    found = near_vectors.near_vectors(spark.createDataFrame(some, VECTORS), 0.95)
    recall = found.agg(F.sum("n_links")).first()[0] / 3000
    assert 0.99 <= recall <= 1.0


def test_codes_are_balanced():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(4000, 24)) + 0.5
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    coder = near_vectors.learned(sample, 10**6, 0.95)
    assert coder.directions.shape[1] >= coder.part * coder.tables
    assert np.all(np.abs(coder.bits(sample).mean(axis=0) - 0.5) < 0.1)
