"""Exact quantiles and ranks against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelloom.plans.order_stats import average_ranks, column_medians, quantiles

EDGES = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.9999999999999998, 2.0, 2.0000000000000004,
         -3.9999999999999996, -4.0, 1e-310, 0.1, 0.1, 1024.0, 1023.9999999999999]
PROBS = {"p0": 0.0, "p5": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p95": 0.95, "p100": 1.0}


def check(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    row = quantiles(df, ["g"], "v", PROBS).first()
    assert row["n"] == len(values)
    for name, p in PROBS.items():
        want = float(np.percentile(np.array(values, dtype=float), p * 100))
        assert row[name] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_edge_values(spark):
    check(spark, EDGES)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values)


def test_groups_nulls_and_infinities(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 7}", float(np.round(rng.lognormal(3, 2), 2))) for i in range(4000)]
    junk = [("g1", None), ("g2", float("inf")), ("g3", float("nan")), (None, 5.0)]
    df = spark.createDataFrame(rows + junk, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", PROBS).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    assert set(got) == set(pdf["g"])
    for g, part in pdf.groupby("g")["v"]:
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(part, p * 100))


def test_ranks_average_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(600), "g": rng.integers(0, 3, 600),
                        "v": rng.integers(-20, 20, 600) / 4})
    df = spark.createDataFrame(pdf)
    got = average_ranks(df, ["g"], "v").toPandas().sort_values("id")["rank"].to_numpy()
    want = pdf.groupby("g")["v"].rank(method="average").to_numpy()
    np.testing.assert_array_equal(got, want)


def test_medians_of_empty_columns_are_null(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    row = column_medians(df, ["a", "b"]).first()
    assert (row["a"], row["b"]) == (2.0, None)


def test_sketch_is_an_option(spark):
    df = spark.range(10_001).selectExpr("id % 2 AS g", "CAST(id AS double) AS v")
    got = quantiles(df, ["g"], "v", {"mid": 0.5, "top": 1.0}, approximate=True)
    for r in got.collect():
        assert abs(r["mid"] - 5000) < 10 and r["top"] >= 9999
