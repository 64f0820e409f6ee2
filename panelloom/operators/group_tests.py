"""Comparing groups: assumptions, omnibus tests, effect sizes and post-hoc tests.

All statistics come from three small tables: moments per group, medians per group,
and counts per distinct value.  No group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cells import finite, is_finite
from panelloom.functions.normal import normal_quantile
from panelloom.functions.tails import (
    ROYSTON_A1,
    ROYSTON_A2,
    chi2_p_value,
    f_p_value,
    mann_whitney_p_value,
    shapiro_p_value,
    studentised_range_p_value,
    studentised_range_quantile,
)
from panelloom.operators.correlation import holm_of_few
from panelloom.operators.describe import group_means, group_medians
from panelloom.plans.order_stats import (
    COUNT,
    VALUE,
    as_scalar,
    average_rank,
    quantiles,
    quantiles_of_counts,
    running_totals,
    value_counts,
)

# Royston's approximation of p was fitted up to this size.
SHAPIRO_ROWS = 5000
_SALTS = 1024
# Equal values that are placed together.
_SEGMENT = 4096
# Groups handled by one value scan of the pairwise test.
_GROUP_BLOCK = 32


def group_moments(df: DataFrame, metric: str, group: str, min_n: int = 1) -> DataFrame:
    """Rows (group, n, mean, ss) over finite values; ss is the squared deviation."""
    rows = df.where(F.col(group).isNotNull() & is_finite(F.col(metric)))
    value = F.col(metric).cast("double")
    out = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("ss"),
    )
    return out.where(F.col("n") >= min_n)


def _one_way(moments: DataFrame) -> DataFrame:
    """k, n, sums of squares and F of a moments table."""
    weighted = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    grand = moments.agg(weighted.alias("m")).scalar()
    between = F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)
    row = moments.withColumn("_grand", grand).agg(
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(between).alias("ss_between"),
        F.sum("ss").alias("ss_within"),
    )
    k, n = F.col("k"), F.col("n")
    usable = (k >= 2) & (n > k) & (F.col("ss_within") > 0)
    within = F.col("ss_within") / F.when(usable, n - k)
    return row.withColumn("statistic", F.col("ss_between") / F.when(usable, k - 1) / within)


def anova(df: DataFrame, metric: str, group: str, min_n: int = 2) -> DataFrame:
    """One row: k, n, ss_between, ss_within, statistic, omega_squared."""
    row = _one_way(group_moments(df, metric, group, min_n))
    k, n = F.col("k"), F.col("n")
    defined = (k >= 2) & (n > k)
    within = F.col("ss_within") / F.when(defined, n - k)
    total = F.col("ss_between") + F.col("ss_within") + within
    effect = (F.col("ss_between") - (k - 1) * within) / F.when(total != 0, total)
    return row.withColumn(
        "omega_squared", F.when(effect.isNotNull(), F.greatest(F.lit(0.0), effect))
    )


def with_f_p_value(row: DataFrame) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    return row.withColumn("p_value", f_p_value(F.col("statistic"), k - 1, n - k))


def brown_forsythe(df: DataFrame, metric: str, group: str, min_n: int = 2) -> DataFrame:
    """Levene statistic around the group medians (one row: k, n, statistic).

    Medians, means and squares come from the same counts of distinct values, so the rows are
    read once and no group is gathered.
    """
    counts = value_counts(df, [group], metric)
    medians = quantiles_of_counts(counts, [group], {"_median": 0.5}).where(F.col("n") >= min_n)
    spread = F.abs(F.col(VALUE) - F.col("_median"))
    centres = (
        counts.join(medians.drop("n"), group)
        .groupBy(group, "_median")
        .agg(F.sum(COUNT).alias("n"), (F.sum(spread * F.col(COUNT)) / F.sum(COUNT)).alias("mean"))
    )
    moments = (
        counts.join(centres, group)
        .groupBy(group, "n", "mean")
        .agg(F.sum(F.pow(spread - F.col("mean"), 2) * F.col(COUNT)).alias("ss"))
    )
    return _one_way(moments).select("k", "n", "statistic")


def kruskal_wallis(df: DataFrame, metric: str, group: str, min_n: int = 2) -> DataFrame:
    """One row: k, n, statistic (tie-corrected H) and epsilon_squared.

    H is NULL when all values are equal.  Ranks come from the counts of distinct
    values, so tied observations are never ranked one by one.
    """
    counts = value_counts(df, [group], metric)
    sizes = counts.groupBy(group).agg(F.sum(COUNT).alias("size")).where(F.col("size") >= min_n)
    counts = counts.join(sizes, group)
    pooled = counts.groupBy(VALUE).agg(F.sum(COUNT).alias(COUNT))
    ranks = running_totals(pooled, []).select(
        VALUE,
        average_rank(F.col(f"{COUNT}_below"), F.col(COUNT)).alias("rank"),
        (F.pow(COUNT, 3) - F.col(COUNT)).alias("ties"),
    )
    per_group = (
        counts.join(ranks.select(VALUE, "rank"), VALUE)
        .groupBy(group)
        .agg(F.sum(F.col(COUNT) * F.col("rank")).alias("rank_sum"), F.sum(COUNT).alias("size"))
    )
    ties = ranks.agg(F.coalesce(F.sum("ties"), F.lit(0.0)).alias("t")).scalar()
    row = per_group.agg(
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("n"),
        F.sum(F.pow("rank_sum", 2) / F.col("size")).alias("_squares"),
    ).withColumn("_ties", ties)
    k, n = F.col("k"), F.col("n")
    size = n.cast("double")
    raw = F.lit(12.0) / F.when(n > 0, size * (size + 1)) * F.col("_squares") - 3 * (size + 1)
    correction = 1 - F.col("_ties") / F.when(n > 1, F.pow(size, 3) - size)
    h = raw / F.when(correction > 0, correction)
    effect = (h - k + 1) / F.when(n > k, n - k)
    return row.select(
        "k",
        "n",
        h.alias("statistic"),
        F.when(effect.isNotNull(), F.greatest(F.lit(0.0), effect)).alias("epsilon_squared"),
    )


def with_chi2_p_value(row: DataFrame) -> DataFrame:
    return row.withColumn("p_value", chi2_p_value(F.col("statistic"), F.col("k") - 1))


def effect_label(value: Column) -> Column:
    return (
        F.when(~is_finite(value), F.lit("n/a"))
        .when(value < 0.01, "negligible")
        .when(value < 0.06, "small")
        .when(value < 0.14, "medium")
        .otherwise("large")
    )


def delta_label(delta: Column) -> Column:
    size = F.abs(delta)
    return (
        F.when(delta.isNull(), F.lit("n/a"))
        .when(size < 0.147, "negligible")
        .when(size < 0.33, "small")
        .when(size < 0.474, "medium")
        .otherwise("large")
    )


def shapiro_statistic(
    df: DataFrame, metric: str, group: str, order: str | None = None, first: int | None = None
) -> DataFrame:
    """Rows (group, n, w, note) by Royston's approximation, over all finite values.

    No group is gathered: positions of the values come from the scan of the distinct values,
    runs of equal values are cut into bounded segments, and sums over positions give the
    statistic.  With ``first`` only so many values of each group are used, the first by
    ``order`` (NULLs last, ties by value).
    """
    rows = df.where(F.col(group).isNotNull()).select(
        group,
        (F.lit(None) if order is None else F.col(order)).alias("_order"),
        finite(F.col(metric)).alias("_x"),
    )
    sizes = rows.groupBy(group).agg(F.count("_x").alias("n"))
    known = rows.where(F.col("_x").isNotNull())
    if first is not None:
        known = _first_rows(known, group, first)
    counts = value_counts(known, [group], "_x")
    means = counts.groupBy(group).agg(
        (F.sum(F.col(VALUE) * F.col(COUNT)) / F.sum(COUNT)).alias("_mean")
    )
    below, ties = F.col(f"{COUNT}_below"), F.col(COUNT)
    segment = F.col("_segment") * _SEGMENT
    placed = (
        running_totals(counts, [group])
        .join(means, group)
        .withColumn(
            "_segment",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((ties - 1) / _SEGMENT))),
        )
        .withColumn(
            "_i",
            F.explode(
                F.sequence(below + segment + 1, below + F.least(ties, segment + _SEGMENT))
            ),
        )
        .withColumnsRenamed({VALUE: "_x", f"{COUNT}_total": "_size"})
    )
    scored = placed.select(
        group,
        "_i",
        "_size",
        (F.col("_x") - F.col("_mean")).alias("_d"),
        normal_quantile("((_i - 0.375D) / (_size + 0.25D))").alias("_m"),
    )
    i, size, d, m = F.col("_i"), F.col("_size"), F.col("_d"), F.col("_m")

    def at(position: Column, c: Column) -> Column:
        return F.max(F.when(i == position, c))

    sums = scored.groupBy(group).agg(
        F.max(size).cast("double").alias("s"),
        F.sum(d * d).alias("ss"),
        F.sum(m * m).alias("mm"),
        F.sum(m * d).alias("md"),
        F.max(m).alias("m1"),
        at(size - 1, m).alias("m2"),
        (at(size, d) - at(F.lit(1), d)).alias("range1"),
        (at(size - 1, d) - at(F.lit(2), d)).alias("range2"),
    )
    found = _royston_statistic(sums).select(group, "w")
    n = F.col("n")
    note = F.when(n < 3, "Too few observations")
    if first is not None:
        note = note.when(n > first, f"First {first} observations used")
    used = n if first is None else F.least(n, F.lit(first))
    note = note.when(used > SHAPIRO_ROWS, f"p is approximate above {SHAPIRO_ROWS} observations")
    return sizes.join(found, group, "left").select(
        group, "n", F.when(n >= 3, F.col("w")).alias("w"), note.otherwise("").alias("note")
    )


def _first_rows(rows: DataFrame, group: str, first: int) -> DataFrame:
    """The first rows of each group by order and value: ranked inside salted parts of a group,
    whose first rows are ranked together."""
    by_order = [F.col("_order").asc_nulls_last(), F.col("_x")]
    salt = F.pmod(F.xxhash64("_order", "_x"), F.lit(_SALTS)).alias("_salt")
    salted = Window.partitionBy(group, "_salt").orderBy(*by_order)
    whole = Window.partitionBy(group).orderBy(*by_order)
    return (
        rows.select("*", salt)
        .withColumn("_i", F.row_number().over(salted))
        .where(F.col("_i") <= first)
        .withColumn("_i", F.row_number().over(whole))
        .where(F.col("_i") <= first)
        .select(group, "_x")
    )


def _royston_statistic(sums: DataFrame) -> DataFrame:
    """Add ``w`` to one row of sums per group.

    The one or two outermost weights on each side come from polynomials, the
    others are proportional to the expected normal order statistics.
    """
    s, mm, m1, m2 = F.col("s"), F.col("mm"), F.col("m1"), F.col("m2")

    def poly(coefficients: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for c in reversed(coefficients):
            total = total * F.col("u") + F.lit(c)
        return total

    rows = sums.withColumns({"u": F.lit(1.0) / F.sqrt(s), "root": F.sqrt(mm)})
    rows = rows.withColumns(
        {
            "a1": F.when(s <= 3, F.sqrt(F.lit(0.5))).otherwise(
                poly(ROYSTON_A1) + m1 / F.col("root")
            ),
            "a2": F.when(s > 5, poly(ROYSTON_A2) + m2 / F.col("root")),
        }
    )
    a1, a2 = F.col("a1"), F.col("a2")
    left = F.when(s > 5, mm - 2 * m1 * m1 - 2 * m2 * m2).otherwise(mm - 2 * m1 * m1)
    room = F.when(s > 5, 1 - 2 * a1 * a1 - 2 * a2 * a2).otherwise(1 - 2 * a1 * a1)
    rows = rows.withColumn("scale", F.when((s > 3) & (room > 0), F.sqrt(left / room)))
    outer = m1 * F.col("range1") + F.coalesce(F.when(s > 5, m2 * F.col("range2")), F.lit(0.0))
    inner = F.coalesce((F.col("md") - outer) / F.col("scale"), F.lit(0.0))
    second = F.coalesce(a2 * F.col("range2"), F.lit(0.0))
    rows = rows.withColumn("ax", inner + a1 * F.col("range1") + second)
    # No spread at all counts as perfectly normal.
    w = F.when(F.col("ss") > 0, F.least(F.lit(1.0), F.col("ax") * F.col("ax") / F.col("ss")))
    return rows.withColumn("w", F.coalesce(w, F.lit(1.0)))


def shapiro_by_group(
    df: DataFrame, metric: str, group: str, order: str | None = None, first: int | None = None
) -> DataFrame:
    """Rows (group, n, w, p_value, normal_05, note), ordered by group."""
    rows = shapiro_statistic(df, metric, group, order, first)
    used = F.col("n") if first is None else F.least(F.col("n"), F.lit(first))
    rows = rows.withColumn("p_value", shapiro_p_value(F.col("w"), used))
    rows = rows.withColumn("normal_05", F.col("p_value") >= 0.05)
    return rows.select(group, "n", "w", "p_value", "normal_05", "note").orderBy(group)


def group_names(df: DataFrame, group: str) -> list[str]:
    """Distinct non-NULL groups as text, sorted (an output of pairs has k^2 rows)."""
    rows = df.select(F.col(group).cast("string").alias("g")).dropna().distinct()
    return sorted(r["g"] for r in rows.collect())


def mann_whitney_statistics(
    df: DataFrame, metric: str, group: str, names: Sequence[str] | None = None, min_n: int = 3
) -> DataFrame:
    """Rows per group pair: sizes, means, medians, U of the first group, tie sum
    and Cliff's delta.

    U is a sum over distinct values of (values of A) x (values of B below, plus half
    of those equal).  A scan of the value axis carries one counter per group, so
    no observation is copied to the pairs it takes part in.
    """
    names = list(names) if names is not None else group_names(df, group)
    rows = df.where(is_finite(F.col(metric))).select(
        F.col(group).cast("string").alias("g"), F.col(metric).cast("double").alias("x")
    )
    blocks = [names[i : i + _GROUP_BLOCK] for i in range(0, len(names), _GROUP_BLOCK)]
    parts = []
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            parts.append(_pair_sums(rows, left, right))
    if not parts:
        parts = [_pair_sums(rows, [""], [""])]
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    sides = group_moments(rows, "x", "g", min_n).select("g", "n", "mean")
    medians = quantiles(rows, ["g"], "x", {"median": 0.5}).select("g", "median")
    sides = sides.join(medians, "g")

    def side(label: str) -> DataFrame:
        return sides.select(
            F.col("g").alias(f"group_{label}"),
            F.col("n").alias(f"n_{label}"),
            F.col("mean").alias(f"mean_{label}"),
            F.col("median").alias(f"median_{label}"),
        )

    out = sums.join(side("A"), "group_A").join(side("B"), "group_B")
    pairs = F.col("n_A").cast("double") * F.col("n_B")
    return out.select(
        "group_A",
        "group_B",
        "n_A",
        "n_B",
        "mean_A",
        "mean_B",
        "median_A",
        "median_B",
        "U",
        "ties",
        (2 * F.col("U") / pairs - 1).alias("cliffs_delta"),
    )


def _pair_sums(rows: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """U and tie sums of all ordered pairs between two blocks of groups."""
    names = list(dict.fromkeys([*left, *right]))
    column = {g: f"_g{i}" for i, g in enumerate(names)}
    weights = {column[g]: F.count_if(F.col("g") == g) for g in names}
    counts = value_counts(rows.where(F.col("g").isin(names)), [], "x", weights)
    scan = running_totals(counts, [], list(weights))

    def cell(g: str) -> Column:
        return F.struct(
            F.lit(g).alias("g"),
            F.col(column[g]).alias("here"),
            F.col(f"{column[g]}_below").alias("below"),
        )

    a = F.array(*[cell(g) for g in names])
    # Only groups that own the value go on; the partner loop stays in the same
    # stage and is summed before any shuffle.
    owners = scan.select(
        F.explode(F.filter(a, lambda c: c["here"] > 0)).alias("a"), a.alias("all")
    )
    both = owners.select("a", F.explode("all").alias("b")).where(F.col("a.g") != F.col("b.g"))
    here_a, here_b = F.col("a.here"), F.col("b.here")
    tied = (here_a + here_b).cast("double")
    forward = F.col("a.g") < F.col("b.g")
    # A value owned by both is counted for its ties once, from the smaller name.
    counts_ties = forward | (here_b == 0)
    ordered = both.groupBy(
        F.least("a.g", "b.g").alias("group_A"), F.greatest("a.g", "b.g").alias("group_B")
    ).agg(
        F.coalesce(
            F.sum(F.when(forward, here_a * (F.col("b.below") + here_b / 2.0))), F.lit(0.0)
        ).alias("U"),
        F.sum(F.when(counts_ties, tied * tied * tied - tied).otherwise(0.0)).alias("ties"),
    )
    if list(left) != list(right):
        in_left = F.col("group_A").isin(list(left)) & F.col("group_B").isin(list(right))
        in_right = F.col("group_A").isin(list(right)) & F.col("group_B").isin(list(left))
        ordered = ordered.where(in_left | in_right)
    return ordered


def mann_whitney_pairs(
    df: DataFrame, metric: str, group: str, names: Sequence[str] | None = None
) -> DataFrame:
    """Two-sided Mann-Whitney test of every pair of groups with three values or more."""
    rows = mann_whitney_statistics(df, metric, group, names)
    rows = rows.withColumn("p_value", mann_whitney_p_value("U", "n_A", "n_B", "ties"))
    rows = holm_of_few(rows, "p_value")
    return rows.withColumns(
        {
            "effect_size": delta_label(F.col("cliffs_delta")),
            "significant_05": F.col("p_adj") < 0.05,
        }
    ).select(
        "group_A", "group_B", "n_A", "n_B", "mean_A", "mean_B", "median_A", "median_B",
        "U", "p_value", "cliffs_delta", "p_adj", "effect_size", "significant_05",
    ).orderBy("group_A", "group_B")


def unordered_pairs(summary: DataFrame, name: str) -> DataFrame:
    """All pairs of rows of a small summary, as (a, b) structs with a before b.

    The partner numbers are exploded and joined by equality.
    """
    everything = Window.partitionBy(F.lit(0))
    numbered = summary.withColumn("_i", F.row_number().over(everything.orderBy(name)))
    numbered = numbered.withColumn("_k", F.count(F.lit(1)).over(everything))
    first = numbered.where(F.col("_i") < F.col("_k")).select(
        F.struct(*summary.columns).alias("a"),
        F.explode(F.sequence(F.col("_i") + 1, F.col("_k").cast("int"))).alias("_j"),
    )
    second = numbered.select(F.struct(*summary.columns).alias("b"), F.col("_i").alias("_j"))
    return first.join(second, "_j").select("a", "b")


def tukey_statistics(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Rows per group pair: mean difference (second minus first), standard error
    of the studentised range, k and the error degrees of freedom."""
    moments = group_moments(df, metric, group).withColumn(group, F.col(group).cast("string"))
    pooled = as_scalar(
        moments.agg(
            F.sum("ss").alias("ss"),
            (F.sum("n") - F.count(F.lit(1))).alias("df"),
            F.count(F.lit(1)).alias("k"),
        )
    )
    pairs = unordered_pairs(moments.select(group, "n", "mean"), group).withColumn("s", pooled)
    error = F.col("s.ss") / F.when(F.col("s.df") > 0, F.col("s.df"))
    scale = F.sqrt(error / 2 * (F.lit(1.0) / F.col("a.n") + F.lit(1.0) / F.col("b.n")))
    return pairs.select(
        F.col(f"a.{group}").alias("group1"),
        F.col(f"b.{group}").alias("group2"),
        (F.col("b.mean") - F.col("a.mean")).alias("meandiff"),
        scale.alias("std_error"),
        F.col("s.k").alias("k"),
        F.col("s.df").alias("df"),
    )


def tukey_pairs(df: DataFrame, metric: str, group: str, alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer comparison of all pairs of groups."""
    rows = tukey_statistics(df, metric, group)
    error = F.when(F.col("std_error") > 0, F.col("std_error"))
    rows = rows.withColumns(
        {
            "p-adj": studentised_range_p_value(F.abs("meandiff") / error, F.col("k"), F.col("df")),
            "_half": studentised_range_quantile(F.lit(alpha), F.col("k"), F.col("df")) * error,
        }
    )
    return rows.select(
        "group1",
        "group2",
        "meandiff",
        "p-adj",
        (F.col("meandiff") - F.col("_half")).alias("lower"),
        (F.col("meandiff") + F.col("_half")).alias("upper"),
        (F.abs("meandiff") > F.col("_half")).alias("reject"),
    ).orderBy("group1", "group2")


@dataclass(frozen=True)
class GroupTestResult:
    """Decision row, diagnostics, group summary and post-hoc rows."""

    decision: DataFrame
    diagnostics: DataFrame
    group_summary: DataFrame
    posthoc: DataFrame


# Wording of the result contract.
METHOD_TEXT = {
    "anova": {
        "method_label": "One-way ANOVA",
        "hypothesis_null": "group means are equal",
        "hypothesis_alternative": "at least one group mean differs",
        "group_statistic_name": "mean",
        "interpretation": "ANOVA compares group means.",
    },
    "kruskal": {
        "method_label": "Kruskal-Wallis",
        "hypothesis_null": "distributions and ranks are the same in all groups",
        "hypothesis_alternative": "at least one group has another rank distribution",
        "group_statistic_name": "median",
        "interpretation": (
            "Kruskal-Wallis compares rank distributions; it is not automatically a test of "
            "equal medians."
        ),
    },
}

DECISION_SCHEMA = (
    "method string, method_label string, hypothesis_null string, hypothesis_alternative string, "
    "group_statistic_name string, interpretation string, statistic double, p_value double, "
    "alpha double, reject_h0 boolean, effect_name string, effect_size double, "
    "effect_label string, levene_stat double, levene_p double, all_normal boolean, "
    "equal_variances boolean"
)


def select_group_test(
    df: DataFrame, metric: str, group: str, order: str, alpha: float = 0.05,
    shapiro_first: int | None = SHAPIRO_ROWS,
) -> GroupTestResult:
    """Choose ANOVA or Kruskal-Wallis from the diagnostics, then the post-hoc test.

    ANOVA needs a Shapiro p of at least alpha in every group and a Levene p of at
    least alpha, by the first ``shapiro_first`` values of a group (None: all).  Only rows
    per group reach the driver.
    """
    spark = df.sparkSession
    diagnostics = shapiro_by_group(df, metric, group, order, shapiro_first)
    shapiro = diagnostics.select("n", "p_value").collect()
    k = sum(1 for r in shapiro if r["n"] >= 2)
    if k < 2:
        raise ValueError(
            "not enough observed data: at least two groups with two observations are needed"
        )
    tested = [r["p_value"] for r in shapiro if r["p_value"] is not None]
    all_normal = len(tested) == k and all(p >= alpha for p in tested)
    levene = with_f_p_value(brown_forsythe(df, metric, group)).first()
    equal = levene["p_value"] is not None and levene["p_value"] >= alpha
    method = "anova" if all_normal and equal else "kruskal"
    if method == "anova":
        effect_name = "omega_squared"
        test = with_f_p_value(anova(df, metric, group))
        summary = group_means(df, group, metric).withColumnRenamed("mean", "value")
    else:
        effect_name = "epsilon_squared"
        test = with_chi2_p_value(kruskal_wallis(df, metric, group))
        summary = group_medians(df, group, metric).withColumnRenamed("median", "value")
    row = test.withColumn("label", effect_label(F.col(effect_name))).first()
    reject = row["p_value"] is not None and row["p_value"] < alpha
    text = METHOD_TEXT[method]
    decision = spark.createDataFrame(
        [
            (
                method,
                text["method_label"],
                text["hypothesis_null"],
                text["hypothesis_alternative"],
                text["group_statistic_name"],
                text["interpretation"],
                row["statistic"],
                row["p_value"],
                float(alpha),
                reject,
                effect_name,
                row[effect_name],
                row["label"],
                levene["statistic"],
                levene["p_value"],
                all_normal,
                equal,
            )
        ],
        DECISION_SCHEMA,
    )
    posthoc = (
        tukey_pairs(df, metric, group)
        if method == "anova"
        else mann_whitney_pairs(df, metric, group)
    )
    return GroupTestResult(
        decision, diagnostics, summary, posthoc if reject else posthoc.where(F.lit(False))
    )
