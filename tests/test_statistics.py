"""Statistics against brute force, published values and the expected scenarios."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import tails
from panelloom.functions.normal import normal_quantile
from panelloom.operators.bootstrap import bootstrap_ci, bootstrap_means
from panelloom.operators.components import fit_components
from panelloom.operators.correlation import (
    correlation_matrix,
    correlation_pairs,
    holm,
    holm_of_few,
    pvalue_matrix,
    sample_sizes,
    significance_list,
)
from panelloom.operators.describe import histogram_bins, scale_range, trend_line
from panelloom.operators.group_tests import (
    anova,
    brown_forsythe,
    kruskal_wallis,
    mann_whitney_pairs,
    mann_whitney_statistics,
    select_group_test,
    shapiro_by_group,
    shapiro_statistic,
    tukey_pairs,
)
from panelloom.operators.outliers import iqr_mask, iqr_outliers


def groups_frame(spark, groups):
    rows = [
        (i * 100 + j, f"R{i}", float(v))
        for i, values in enumerate(groups)
        for j, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "id int, region string, value double")


def normal_scores(n=10):
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf((i - 0.5) / n) for i in range(1, n + 1)])


# --- tails: published table values ------------------------------------------------


@pytest.mark.parametrize("t,df,p", [(2.228, 10, 0.05), (2.845, 20, 0.01), (12.706, 1, 0.05)])
def test_t_table(t, df, p):
    assert tails.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("f,a,b,p", [(4.103, 2, 10, 0.05), (2.866, 4, 20, 0.05),
                                     (5.953, 3, 12, 0.01)])
def test_f_table(f, a, b, p):
    assert tails.f_sf(f, a, b) == pytest.approx(p, rel=5e-3)


@pytest.mark.parametrize("x,df,p", [(3.841, 1, 0.05), (7.815, 3, 0.05), (23.209, 10, 0.01)])
def test_chi2_table(x, df, p):
    assert tails.chi2_sf(x, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize("q,k,df", [(3.877, 3, 10), (3.958, 4, 20), (3.977, 5, 60),
                                    (3.635, 2, 5), (4.560, 10, 120)])
def test_studentised_range_table(q, k, df):
    assert tails.studentised_range_sf(q, k, df) == pytest.approx(0.05, rel=5e-3)
    assert tails.studentised_range_critical(0.05, k, df) == pytest.approx(q, abs=2e-3)


def test_studentised_range_of_two_is_a_t_test():
    for q, df in ((1.0, 7), (3.3, 12), (5.0, 30)):
        want = tails.t_two_sided(q / math.sqrt(2), df)
        assert tails.studentised_range_sf(q, 2, df) == pytest.approx(want, abs=1e-6)


def test_exact_rank_p_equals_enumeration():
    n1, n2 = 4, 6
    places = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, 11), n1)]
    for u in range(0, n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(p >= top for p in places) / len(places))
        assert tails.mann_whitney_p(u, n1, n2, 0) == pytest.approx(want)


def test_normal_quantile_column(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-6, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(normal_quantile("p")).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-8)


# --- outliers, bins, ranges ---------------------------------------------------------


def test_only_the_extreme_value_is_an_outlier(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(1, 9), 100])],
                               "id int, value double")
    got = iqr_outliers(df, "value", "id").collect()
    assert [r["value"] for r in got] == [100.0] and got[0]["iqr_distance"] > 0
    assert iqr_mask(df, "value").where("is_outlier").count() == 1
    flat = df.withColumn("value", F.lit(2.0))
    assert iqr_outliers(flat, "value", "id").count() == 0


def test_histogram_bins(spark):
    spread = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert histogram_bins(spread, "v").first()["bins"] > 1
    assert histogram_bins(spread.limit(16).withColumn("v", F.lit(1.0)), "v").first()["bins"] == 5
    assert histogram_bins(spread.limit(1), "v").first()["bins"] == 1
    assert histogram_bins(spread.limit(0), "v").first()["bins"] == 1


def test_scale_range_cases(spark):
    rows = spark.range(101).select((F.col("id") - 20).cast("double").alias("v"))
    assert tuple(scale_range(rows, "v").first()) == (-20.0, 80.0)
    assert tuple(scale_range(rows, "v", robust=True).first()) == (-15.0, 75.0)
    assert tuple(scale_range(rows, "v", diverging=True).first()) == (-80.0, 80.0)
    assert tuple(scale_range(rows.where("v = 0"), "v").first()) == (-1.0, 1.0)
    assert tuple(scale_range(rows.where("v = 40"), "v").first()) == (38.0, 42.0)
    assert tuple(scale_range(rows.limit(0), "v").first()) == (None, None)


# --- correlation --------------------------------------------------------------------


def test_pairwise_matrices_use_complete_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 4), (2.0, None, 3), (3.0, 3.0, 2), (4.0, 4.0, 1)], "a double, b double, c int"
    )
    cols = ["a", "b", "c"]
    sizes = {r["variable"]: r for r in sample_sizes(df, cols).collect()}
    assert (sizes["a"]["b"], sizes["a"]["c"], sizes["b"]["b"]) == (3, 4, 3)
    p = {r["variable"]: r for r in pvalue_matrix(df, cols, "spearman").collect()}
    assert p["a"]["c"] == p["c"]["a"] == pytest.approx(0.0, abs=1e-9)
    assert p["a"]["a"] == 0.0
    assert p["a"]["b"] is None
    r = {x["variable"]: x for x in correlation_matrix(df, cols, "spearman").collect()}
    assert r["a"]["c"] == pytest.approx(-1) and r["a"]["b"] == pytest.approx(1)
    assert [x["variable"] for x in correlation_matrix(df, cols).collect()] == cols


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_equals_pandas(spark, method):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.integers(-9, 9, (300, 4)) / 2.0, columns=list("wxyz"))
    pdf["x"] += pdf["w"]
    pdf = pdf.mask(rng.random(pdf.shape) < 0.2)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    rows.append((float("inf"), 1.0, float("-inf"), 2.0))
    df = spark.createDataFrame(rows, "w double, x double, y double, z double")
    got = correlation_pairs(df, list("wxyz"), method).collect()
    assert len(got) == 6
    for r in got:
        a, b = r["var_a"], r["var_b"]
        both = pdf[[a, b]].dropna()
        extra = 1 if (a, b) == ("x", "z") else 0
        if extra:
            both = pd.concat([both, pd.DataFrame({a: [1.0], b: [2.0]})])
        if method == "spearman":
            both = both.rank()
        assert r["n"] == len(both)
        assert r["r"] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


def test_constant_column_has_no_correlation(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert correlation_pairs(df, ["a", "b"]).first()["r"] is None
    assert significance_list(df, ["a", "b"]).count() == 0


def test_trend_line_needs_two_distinct_x(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert tuple(trend_line(df, "x", "y").first()) == (2, None, None)
    assert tuple(trend_line(df.limit(0), "x", "y").first()) == (0, None, None)
    line = trend_line(df.unionByName(spark.createDataFrame([(3.0, 6.5)], df.schema)), "x", "y")
    assert tuple(line.first()) == pytest.approx((3, 2.0, 0.5))


def test_holm_is_monotone_and_not_below_raw(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p_value double")
    got = holm(df, "p_value").orderBy("p_value").collect()
    want = [0.03, 0.05, 0.12, 0.12, 1.0, 1.0]
    assert [r["p_adj"] for r in got] == pytest.approx(want)
    assert all(r["p_adj"] >= r["p_value"] for r in got)


def test_holm_with_ties_equals_the_steps_one_by_one(spark):
    rng = np.random.default_rng(5)
    p = [*rng.uniform(0, 1, 150), *(rng.uniform(0, 1, 20) ** 9), *[0.0] * 5, *[1.0] * 4, *[0.25] * 30]
    p += list(rng.choice(p, 60)) + [5e-324, 1e-300]
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(-1, None), (-2, float("nan"))]
    df = spark.createDataFrame(rows, "id int, p double").repartition(5)
    got = holm(df, "p", "adj")
    assert got.columns == ["id", "p", "adj"]
    found = {r.id: r.adj for r in got.collect()}
    few = {r.id: r.adj for r in holm_of_few(df, "p", "adj").collect()}
    assert found == pytest.approx(few)
    want, high = {}, 0.0
    for step, i in enumerate(sorted(range(len(p)), key=lambda i: p[i])):
        high = max(high, (len(p) - step) * p[i])
        want[i] = min(1.0, high)
    assert found == pytest.approx(want)


def test_rank_tests_read_their_rows_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"g{i % 4}", float(v)) for i, v in enumerate(rng.integers(0, 50, 400))]
    rows += [("g0", None), (None, 1.0), ("alone", 3.0), ("g1", float("nan"))]
    spark.createDataFrame(rows, "g string, x double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    groups = [np.array([x for g, x in rows[:400] if g == f"g{k}"]) for k in range(4)]
    spread = [np.abs(v - np.median(v)) for v in groups]
    every = np.concatenate(spread)
    between = sum(len(s) * (s.mean() - every.mean()) ** 2 for s in spread) / 3
    within = sum(((s - s.mean()) ** 2).sum() for s in spread) / 396
    row = brown_forsythe(df, "x", "g").first()
    assert (row["k"], row["n"]) == (4, 400)
    assert row["statistic"] == pytest.approx(between / within)
    for test in (kruskal_wallis, brown_forsythe):
        out = test(df, "x", "g")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") == 1, final


# --- group tests --------------------------------------------------------------------


def test_workflow_selects_anova_and_tukey(spark):
    scores = normal_scores()
    df = groups_frame(spark, [scores + s for s in (0.0, 1.0, 2.0, 3.0)])
    result = select_group_test(df, "value", "region", "id")
    row = result.decision.first()
    assert row["method"] == "anova" and row["reject_h0"] is True
    assert row["effect_name"] == "omega_squared" and row["group_statistic_name"] == "mean"
    assert result.posthoc.columns == [
        "group1", "group2", "meandiff", "p-adj", "lower", "upper", "reject"]
    assert result.posthoc.count() == 6
    assert [r["region"] for r in result.group_summary.collect()] == ["R3", "R2", "R1", "R0"]


def test_workflow_selects_kruskal_for_skewed_groups(spark):
    skewed = np.array([0, 0, 0, 0, 0.1, 0.2, 0.3, 5.0])
    df = groups_frame(spark, [skewed + s for s in (0.0, 1.0, 2.0, 3.0)])
    row = select_group_test(df, "value", "region", "id").decision.first()
    assert row["method"] == "kruskal" and row["effect_name"] == "epsilon_squared"
    assert row["group_statistic_name"] == "median"


def test_posthoc_is_blocked_without_a_significant_test(spark):
    df = groups_frame(spark, [normal_scores()] * 4)
    result = select_group_test(df, "value", "region", "id")
    assert result.decision.first()["reject_h0"] is False
    assert result.posthoc.count() == 0


def test_two_value_group_forces_kruskal_and_one_group_raises(spark):
    scores = normal_scores()
    df = groups_frame(spark, [scores, scores + 1, scores[:2]])
    assert select_group_test(df, "value", "region", "id").decision.first()["method"] == "kruskal"
    with pytest.raises(ValueError, match="at least two groups"):
        select_group_test(groups_frame(spark, [scores, [1.0]]), "value", "region", "id")


def test_shapiro_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = groups_frame(spark, [weights, [1.0, 2.0], [3.0, 3.0, 3.0], [1.0, 2.0, 4.0]])
    got = {r["region"]: r for r in shapiro_by_group(df, "value", "region", "id").collect()}
    assert got["R0"]["w"] == pytest.approx(0.788814, abs=2e-6)
    assert got["R0"]["p_value"] == pytest.approx(0.006703, abs=2e-6)
    assert got["R0"]["normal_05"] is False
    assert got["R1"]["w"] is None and got["R1"]["note"] == "Too few observations"
    assert (got["R2"]["w"], got["R2"]["p_value"]) == (1.0, 1.0)
    # n = 3: (x3 - x1)^2 / 2 over the squared deviations.
    assert got["R3"]["w"] == pytest.approx(4.5 / (14 / 3), abs=1e-9)


def royston(values):
    """The statistic of sorted values, one by one."""
    from statistics import NormalDist

    from panelloom.functions.tails import ROYSTON_A1, ROYSTON_A2

    x = np.sort(np.asarray(values, float))
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, a = 1 / math.sqrt(n), m.copy()
    a[-1] = sum(c * u**k for k, c in enumerate(ROYSTON_A1)) + m[-1] / math.sqrt(m @ m)
    a[-2] = sum(c * u**k for k, c in enumerate(ROYSTON_A2)) + m[-2] / math.sqrt(m @ m)
    inner = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
    a[2:-2] = m[2:-2] / math.sqrt(inner)
    a[0], a[1] = -a[-1], -a[-2]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("first", [None, 5000, 5599, 5600])
def test_shapiro_over_all_or_the_first_rows(spark, monkeypatch, first):
    from panelloom.operators import group_tests

    # Runs of equal values are longer than a segment; the order of some rows is unknown.
    monkeypatch.setattr(group_tests, "_SEGMENT", 16)
    values = [float(i * 7919 % 97) if i < 5000 else 300.0 + i % 3 for i in range(5600)]
    rows = [(i if i < 5500 else None, "g", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, region string, value double").repartition(5)
    row = shapiro_statistic(df, "value", "region", "id", first).first()
    late = sorted(values[5500:])
    used = values[:5500] + late if first is None else (values[:5500] + late)[:first]
    assert row["n"] == 5600
    assert row["w"] == pytest.approx(royston(used), abs=1e-9)
    cut = first is not None and first < 5600
    assert row["note"].startswith(f"First {first}" if cut else "p is approximate")


@pytest.mark.parametrize("m,n", [(1, 7), (2, 5), (3, 40), (8, 9), (8, 60)])
def test_exact_tail_of_a_small_side_counts_placements(m, n):
    from itertools import combinations as choose

    from panelloom.functions import tails

    if math.comb(m + n, m) < 20_000:
        us = [sum(p) - m * (m - 1) // 2 for p in choose(range(m + n), m)]
        for u in range(m * n + 1):
            assert tails._placements_up_to(m, n, u) == sum(x <= u for x in us)
    assert tails._placements_up_to(m, n, m * n) == math.comb(m + n, m)
    middle = m * n // 2
    assert tails._placements_up_to(m, n, middle) + tails._placements_up_to(
        m, n, m * n - middle - 1
    ) == math.comb(m + n, m)


def test_exact_tail_beside_a_side_of_any_size():
    from panelloom.functions import tails

    # Just below and above fifty million pairs, and far beyond: one rule.
    near = [tails.mann_whitney_p(0.12 * 5 * n, 5, n, 0) for n in (9_999_999, 10_000_001, 10**8)]
    assert near == pytest.approx([near[0]] * 3, rel=1e-5)
    assert tails.mann_whitney_p(5 * 10**8, 5, 10**8, 0) == 2 / math.comb(10**8 + 5, 5)
    # Five uniform places: U / n tends to their sum.
    total = sum((-1) ** k * math.comb(5, k) * max(0.6 - k, 0) ** 5 for k in range(6)) / math.factorial(5)
    assert near[2] == pytest.approx(2 * total, rel=1e-5)


def test_anova_and_kruskal_by_hand(spark):
    groups = [[6, 8, 4, 5, 3, 4], [8, 12, 9, 11, 6, 8], [13, 9, 11, 8, 7, 12]]
    row = anova(groups_frame(spark, groups), "value", "region").first()
    assert row["statistic"] == pytest.approx(9.264706, abs=1e-6)
    assert row["omega_squared"] == pytest.approx((84 - 2 * 68 / 15) / (152 + 68 / 15))
    ranks = pd.Series(sum(groups, [])).rank()
    t = pd.Series(sum(groups, [])).value_counts()
    sums = [ranks[i * 6:(i + 1) * 6].sum() for i in range(3)]
    h = 12 / (18 * 19) * sum(s * s / 6 for s in sums) - 3 * 19
    h /= 1 - (t**3 - t).sum() / (18**3 - 18)
    got = kruskal_wallis(groups_frame(spark, groups), "value", "region").first()
    assert got["statistic"] == pytest.approx(h)
    assert got["epsilon_squared"] == pytest.approx((h - 2) / 15)
    same = kruskal_wallis(groups_frame(spark, [[1, 1], [1, 1]]), "value", "region").first()
    assert same["statistic"] is None


def test_rank_test_counts_pairs(spark, monkeypatch):
    from panelloom.operators import group_tests

    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 12, n).tolist() for n in (5, 9, 2, 14, 7, 3)]
    df = groups_frame(spark, groups)
    want = {}
    for a, b in itertools.combinations(range(6), 2):
        if min(len(groups[a]), len(groups[b])) < 3:
            continue
        u = sum((x > y) + (x == y) / 2 for x in groups[a] for y in groups[b])
        t = pd.Series(groups[a] + groups[b]).value_counts()
        want[f"R{a}", f"R{b}"] = (u, float((t**3 - t).sum()))
    for block in (32, 2, 1):
        monkeypatch.setattr(group_tests, "_GROUP_BLOCK", block)
        rows = mann_whitney_statistics(df, "value", "region").collect()
        got = {(r["group_A"], r["group_B"]): (r["U"], r["ties"]) for r in rows}
        assert got == want
    tested = mann_whitney_pairs(df, "value", "region").collect()
    assert all(0 < r["p_value"] <= r["p_adj"] <= 1 for r in tested)
    for r in tested:
        assert r["cliffs_delta"] == pytest.approx(2 * r["U"] / (r["n_A"] * r["n_B"]) - 1)


def test_tukey_intervals_agree_with_p(spark):
    df = groups_frame(spark, [normal_scores(8) + s for s in (0.0, 0.4, 1.9)] + [[5.0]])
    rows = tukey_pairs(df, "value", "region").collect()
    assert len(rows) == 6
    for r in rows:
        assert r["reject"] == (r["p-adj"] < 0.05) == (not r["lower"] <= 0 <= r["upper"])
        assert r["meandiff"] == pytest.approx((r["lower"] + r["upper"]) / 2)


# --- bootstrap ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 64, 65, 400, 1024, 1025])
def test_bootstrap_interval_is_close_to_theory(spark, n):
    values = np.random.default_rng(9).normal(50, 10, n)
    df = groups_frame(spark, [values, [1.0, 2.0]])
    r = bootstrap_means(df, "value", "region").collect()
    assert [x["region"] for x in r] == ["R0"]
    r = r[0]
    assert r["ci_low"] < r["mean"] < r["ci_high"]
    if n >= 64:
        error = values.std() / math.sqrt(n)
        assert (r["ci_high"] - r["ci_low"]) / error == pytest.approx(2 * 1.96, rel=0.1)
    again = bootstrap_means(df.repartition(7), "value", "region").first()
    assert again["ci_low"] == pytest.approx(r["ci_low"], abs=1e-9)


@pytest.mark.parametrize("n", [1000, 9000])
def test_bootstrap_is_the_same_in_one_block_and_in_many(spark, monkeypatch, n):
    from panelloom.operators import bootstrap

    # Long runs of equal values reach over blocks.
    values = np.random.default_rng(4).integers(0, 40, n).astype(float)
    df = groups_frame(spark, [values, values[: n // 3]])
    found = []
    for block in (1 << 14, 256):
        monkeypatch.setattr(bootstrap, "BLOCK", block)
        rows = bootstrap_means(df, "value", "region", n_boot=60).collect()
        found.append([(r["region"], r["n"], r["mean"], r["ci_low"], r["ci_high"]) for r in rows])
    for one, other in zip(*found, strict=True):
        assert one[:2] == other[:2]
        assert one[2:] == pytest.approx(other[2:], abs=1e-9)


def test_bootstrap_draws_the_weights_of_a_block_once(spark, monkeypatch):
    from panelloom.operators import bootstrap

    calls = spark.sparkContext.accumulator(0)
    weighted = bootstrap._weighted

    def counted(n_boot, seed):
        sums = weighted(n_boot, seed)

        def counting(runs: pd.DataFrame) -> pd.DataFrame:
            calls.add(1)
            return sums(runs)

        return counting

    monkeypatch.setattr(bootstrap, "_weighted", counted)
    values = np.random.default_rng(6).normal(50, 10, 3 * bootstrap.BLOCK)
    df = groups_frame(spark, [values, values[:100]])
    assert bootstrap_means(df, "value", "region", n_boot=20).count() == 2
    calls.value = 0
    assert len(bootstrap_means(df, "value", "region", n_boot=20).collect()) == 2
    assert calls.value == 3 + 1


def test_numbers_are_those_of_plain_integers():
    from panelloom.functions import resampling as rs

    m = rs.MODULUS
    draws = [0, 1, 77, m - 1, m, m + 1, 2 * m - 1, 2 * m, 10**15]
    for seed, group, r in itertools.product((0, 42), (0, 5, 2**28 - 1), (0, 1, 1999, m - 1)):
        want = []
        for j in draws:
            low, high = j % m, j // m
            y = seed * rs.SEED_STEP + group * rs.GROUP_STEP + r * rs.REPLICATE_STEP
            y = (y + low * rs.DRAW_STEP) % m
            y = (y * y + rs.SHIFT + low) % m
            y = (y * y + rs.SHIFT + r + high) % m
            want.append((y * y + rs.SHIFT) % m)
        assert rs.numbers(seed, group, r, draws).tolist() == want
        limits = rs.poisson_thresholds(0.97)
        counts = [sum(y >= limit for limit in limits) for y in want]
        once = rs.Draws(seed, group, draws).unreduced(r)
        assert rs.poisson_weights(once, 0.97).tolist() == counts
    edges = [y for limit in limits for y in (limit - 1, limit, limit + 1) if y < m]
    found = rs.poisson_weights(np.array(edges, np.uint64), 0.97).tolist()
    assert found == [sum(y >= limit for limit in limits) for y in edges]


@pytest.mark.parametrize("n", [65, 1024, 1025])
def test_poisson_counts_and_missing_draws_are_multinomial(n):
    """Counts of a position over replicates have the mean and variance of n draws."""
    from panelloom.functions import resampling as rs

    r = np.arange(3000)
    drawn = rs.numbers(42, 5, r[:, None], np.arange(n)[None, :])
    counts = rs.poisson_weights(drawn, rs.poisson_mean(n)).astype(int)
    for i in range(len(r)):
        missing = n - counts[i].sum()
        assert missing >= 0
        at = rs.positions(42, 5, np.uint64(i), np.arange(missing), n).astype(int)
        np.add.at(counts[i], at, 1)
    assert (counts.sum(axis=1) == n).all()
    assert counts.mean(axis=0) == pytest.approx(1, abs=0.12)
    assert counts.var(axis=0).mean() == pytest.approx(1 - 1 / n, rel=0.02)
    both = np.cov(counts[:, 0], counts[:, 1])[0, 1]
    assert both == pytest.approx(-1 / n, abs=0.08)


def test_draws_beyond_the_modulus_do_not_repeat():
    from panelloom.functions import resampling as rs

    j = np.arange(1000, dtype=np.uint64)
    near = rs.numbers(1, 2, np.uint64(3), j)
    far = rs.numbers(1, 2, np.uint64(3), j + np.uint64(rs.MODULUS))
    assert (near != far).mean() > 0.99
    at = rs.positions(1, 2, np.uint64(3), j, 10**12)
    assert at.max() > 9 * 10**11 and len(np.unique(at)) == 1000


def test_bootstrap_of_few_values(spark):
    none = groups_frame(spark, [[1.0]]).where("value > 5")
    assert tuple(bootstrap_ci(none, "value").first()) == (None, None, None)
    one = groups_frame(spark, [[4.5]])
    assert tuple(bootstrap_ci(one, "value").first()) == (4.5, 4.5, 4.5)


# --- principal components -----------------------------------------------------------


FEATURES = ["f1", "f2", "f3", "f4"]


def latent_frame(spark, n=80):
    rng = np.random.default_rng(42)
    base = rng.normal(size=n)
    pdf = pd.DataFrame({
        "f1": base + rng.normal(scale=0.05, size=n), "f2": -base + rng.normal(scale=0.1, size=n),
        "f3": 20_000 + base * 2_000 + rng.normal(scale=900, size=n), "f4": rng.normal(size=n),
        "name": [f"C{i % 20}" for i in range(n)], "year": 2010 + np.arange(n) % 15,
        "f3_imputed": np.arange(n) < 5,
    })
    return pdf, spark.createDataFrame(pdf)


def test_components_equal_singular_vectors(spark):
    pdf, df = latent_frame(spark)
    fitted = fit_components(df, FEATURES, ["name", "year"])
    kept = pdf[5:]
    x = (kept[FEATURES] - kept[FEATURES].mean()) / kept[FEATURES].std(ddof=0)
    u, s, vt = np.linalg.svd(x.to_numpy(), full_matrices=False)
    np.testing.assert_allclose(fitted.explained_variance_ratio, s**2 / (s**2).sum(), atol=1e-10)
    assert (fitted.n, fitted.imputed_rows_excluded) == (75, 5)
    assert fitted.loadings.columns == ["feature", "PC1", "PC2"]
    variance = s**2 / (len(kept) - 1)
    want = np.abs(vt[:2].T * np.sqrt(variance[:2]))
    got = fitted.loadings.toPandas()
    np.testing.assert_allclose(got[["PC1", "PC2"]].abs().to_numpy(), want, atol=1e-9)
    for c in ("PC1", "PC2"):
        assert got[c][got[c].abs().idxmax()] > 0
    scores = fitted.scores.toPandas()
    np.testing.assert_allclose(
        np.sort(scores["PC1"].abs()), np.sort(np.abs(u[:, 0] * s[0])), atol=1e-9)


def test_smallest_number_of_components_reaching_the_threshold(spark):
    _, df = latent_frame(spark)
    for threshold in (0.5, 0.8, 0.97, 1.0):
        fitted = fit_components(df, FEATURES, ["name"], variance_threshold=threshold)
        total, k = fitted.cumulative_variance, fitted.selected_k
        assert k == len(total) or total[k - 1] >= threshold
        assert k == 1 or total[k - 2] < threshold
        assert total[-1] == pytest.approx(1.0)


def test_too_few_rows_for_components(spark):
    _, df = latent_frame(spark)
    with pytest.raises(ValueError, match="too few complete observations"):
        fit_components(df.limit(6), FEATURES, ["name"])
