"""Repeated rows, ties and sampled labels: cases in which results were lost."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from llm_fixtures import frame, words
from test_vectors import VECTORS, answers, best_by_hand

from panelloom.llm import near_dedup, topk_cells, toxicity, vantage


@pytest.fixture(scope="module")
def repeated_rows():
    rng = np.random.default_rng(9)
    copy = [4.0, 4.0, 4.0, 4.0]
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(1, 200)]
    # A query repeated more often than k, and copies of it under larger ids.
    rows += [(0, copy, 0)] * 30 + [(i, copy, 0) for i in range(301, 310)]
    # An id with very many vectors, and many different vectors that tie for one query.
    rows += [(777, [float(x) for x in rng.normal(size=4)], 0) for _ in range(50)]
    rows += [(1000, [9.0, 0.0, 0.0, 0.0], 0)]
    return rows + [(2001 + 2 * i, [9.0, float(40 - i) / 8, 0.0, 0.0], 0) for i in range(40)]


@pytest.mark.parametrize("shard", [16, 8192])
@pytest.mark.parametrize("op", ["cells", "vantage"])
def test_repeated_queries_and_ties(spark, monkeypatch, repeated_rows, op, shard):
    df = spark.createDataFrame(repeated_rows, VECTORS).repartition(4)
    if op == "cells":
        monkeypatch.setattr(topk_cells, "SHARD_ROWS", shard)
        found = answers(topk_cells.exact_top_k(df, k=5, query_every=50))
        wanted = best_by_hand(repeated_rows, 5, 50, lambda v: np.floor(256 * v), False)
    else:
        monkeypatch.setattr(vantage, "SHARD_ROWS", shard)
        monkeypatch.setattr(vantage, "LEAF", 8)
        found = answers(vantage.nearest(df, k=20, query_every=20))
        wanted = best_by_hand(repeated_rows, 20, 20, lambda v: v, True)
    assert found.keys() == wanted.keys()
    for q, rows in wanted.items():
        assert [j for _, j, _ in found[q]] == [j for _, j in rows]


def test_repeated_rows_are_one_before_sets_meet(spark, monkeypatch):
    rng = random.Random(2)
    text = words(rng, 60)
    near = " ".join([*text[:-1], "other"])
    rows = [(1, " ".join(text), "a")] * 300 + [(2, near, "a")] * 200
    # The matrix of one task would be as wide as the rows.
    whole = near_dedup.linked_pairs
    def few(sets, split, percent):
        assert len(sets) <= 2
        return whole(sets, split, percent)
    monkeypatch.setattr(near_dedup, "linked_pairs", few)
    got = near_dedup.near_duplicates(frame(spark, rows), words=2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False)}
    assert len(got) == 500
    once = list(near_dedup.once_each([pd.DataFrame({"doc_id": [1, 1, 2], "text": ["a", "a", "a"]})] * 2))
    assert [len(b) for b in once] == [2, 0]


def test_long_texts_get_blocks_of_their_own(spark, monkeypatch):
    rng = random.Random(3)
    base = words(rng, 4000)
    rows = [(i, " ".join([*base, f"end{i}"]), "a") for i in range(8)]
    whole = near_dedup.linked_pairs
    def light(sets, split, percent):
        assert len(sets) < 8
        return whole(sets, split, percent)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 1 << 15)
    monkeypatch.setattr(near_dedup, "linked_pairs", light)
    got = near_dedup.near_duplicates(frame(spark, rows), words=2).collect()
    assert {r.component_id for r in got} == {0}


def test_scores_do_not_depend_on_the_caps(spark, monkeypatch):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 10 == 0
        text = words(rng, 30)
        # Half of the toxic texts and some others have the word: borderline.
        if rng.random() < (0.7 if bad else 0.08):
            text[rng.randrange(30)] = "zzqqxx"
        rows.append((i, " ".join(text), "a"))
        labels.append((i, int(bad)))
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = toxicity.train(docs, marks)
    monkeypatch.setattr(toxicity, "TRAIN_ORDINARY", 90)
    capped = toxicity.train(docs, marks)
    texts = [t for _, t, _ in rows]
    a, b = (float(np.mean(toxicity.Scorer(m).scores(texts))) for m in (whole, capped))
    assert a == pytest.approx(0.1, abs=0.04)
    assert b == pytest.approx(a, abs=0.06)
    assert toxicity.fit(["a"], [0], (3.0, 1.0)) == 0.0
    assert toxicity.fit(["a", "b"], [0, 1], (3.0, 1.0)) == 0.25
