"""Pairwise-complete correlations, p-values and multiple-testing correction."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.cells import finite, is_finite
from panelloom.functions.tails import correlation_p_value
from panelloom.plans.order_stats import (
    COUNT,
    VALUE,
    average_rank,
    running_maximum,
    running_totals,
    value_counts,
)


def _finite_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[finite(F.col(c)).alias(c) for c in cols])


def _partner_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns ``<a>|<b>``: rank of a among the rows where a and b are both known; column ``<a>``
    is known where a is.

    The columns stand below one another, so that one scan ranks all of them: it carries a
    running count per partner.  Ranks go back to the rows in one join and one grouping by row,
    so the number of exchanges does not depend on the number of columns.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("_of"), (F.col(c) + 0.0).alias(VALUE)) for i, c in enumerate(cols)]
    )
    long = (
        # Numbered before the cells are dealt out, which all carry their row's number.
        df.withColumn("_row", F.monotonically_increasing_id())
        .select(
            "_row",
            F.array(*[F.col(c).isNotNull() for c in cols]).alias("_known"),
            F.explode(cells).alias("_cell"),
        )
        .select("_row", "_known", "_cell.*")
        .where(F.col(VALUE).isNotNull())
    )
    names = [f"_with_{i}" for i in range(len(cols))]
    counts = long.groupBy("_of", VALUE).agg(
        *[F.count_if(F.col("_known")[i]).alias(n) for i, n in enumerate(names)]
    )
    ranks = running_totals(counts, ["_of"], names).select(
        "_of", VALUE, F.array(*[average_rank(F.col(f"{n}_below"), F.col(n)) for n in names]).alias("_ranks")
    )
    rows = (
        long.select("_row", "_of", VALUE)
        .join(ranks, ["_of", VALUE])
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("_of", "_ranks"))).alias("_ranks"))
    )
    known = {c: F.element_at("_ranks", F.lit(i)) for i, c in enumerate(cols)}
    return rows.select(
        *[known[c].alias(c) for c in cols],
        *[known[a][j].alias(f"{a}|{b}") for a in cols for j, b in enumerate(cols) if a != b],
    )


def _pair_cells(cols: Sequence[str], method: str) -> tuple[list[Column], list[tuple[str, str]]]:
    pairs = list(combinations(cols, 2))
    cells = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.col(a), F.col(b)) if method == "pearson" else (
            F.col(f"`{a}|{b}`"),
            F.col(f"`{b}|{a}`"),
        )
        x, y = F.when(both, x), F.when(both, y)
        # Not ``corr``: in ANSI mode that fails on a constant column.
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        r = F.covar_pop(x, y) / F.when(varied & (spread > 0), spread)
        cells.append(
            F.struct(
                F.lit(a).alias("var_a"),
                F.lit(b).alias("var_b"),
                F.count_if(both).alias("n"),
                F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
            )
        )
    return cells, pairs


def correlation_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Rows (var_a, var_b, n, r), one per unordered pair, from one aggregation.

    ``r`` is NULL unless both sides vary over the complete rows.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method}")
    rows = _finite_columns(df, cols)
    if method == "spearman":
        rows = _partner_ranks(rows, cols)
    cells, _ = _pair_cells(cols, method)
    # One slim aggregate row, then one output row per pair.
    return rows.agg(F.array(*cells).alias("pairs")).select(F.inline("pairs"))


def _mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """Both orders of every pair."""
    turned = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("var_a").alias("row"), F.col("var_b").alias("col"), value),
                F.struct(F.col("var_b").alias("row"), F.col("var_a").alias("col"), value),
            )
        ).alias("c")
    )
    return turned.select("c.*")


def as_matrix(cells: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """Long cells (row, col, value) as one row per variable, in column order."""
    wide = cells.groupBy(F.col("row").alias("variable")).agg(
        *[F.max(F.when(F.col("col") == c, F.col(value))).alias(c) for c in cols]
    )
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("variable"))
    return wide.orderBy(order)


def _diagonal(df: DataFrame, cols: Sequence[str], cell, value: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("row"), F.lit(c).alias("col"), cell(c).alias(value)) for c in cols
    ]
    return _finite_columns(df, cols).agg(F.array(*cells).alias("d")).select(F.inline("d"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Symmetric matrix; the diagonal is 1 where a column has a finite value."""
    pairs = correlation_pairs(df, cols, method)
    diagonal = _diagonal(df, cols, lambda c: F.when(F.count(c) > 0, F.lit(1.0)), "r")
    return as_matrix(_mirrored(pairs, "r").unionByName(diagonal), cols, "r")


def sample_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Matrix of pairwise-complete counts; the diagonal counts finite values."""
    rows = _finite_columns(df, cols)
    cells = [
        F.struct(
            F.lit(a).alias("row"),
            F.lit(b).alias("col"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
        )
        for a in cols
        for b in cols
    ]
    return as_matrix(rows.agg(F.array(*cells).alias("c")).select(F.inline("c")), cols, "n")


def holm(df: DataFrame, p_value: str, name: str = "p_adj") -> DataFrame:
    """Holm step-down adjustment over all rows with a finite p-value; the others go.

    Of equal p-values the first step has the largest product, so that one product per distinct
    value is enough.  Counts of smaller values and the running maximum come from scans of the
    distinct values in bounded windows; no task sees all tests.
    """
    counts = value_counts(df, [], p_value)
    below, tests = F.col(f"{COUNT}_below"), F.col(f"{COUNT}_total")
    scaled = running_totals(counts, []).select(
        VALUE, ((tests - below) * F.col(VALUE)).alias("_scaled")
    )
    adjusted = running_maximum(scaled, [], "_scaled", "_adjusted").select(
        VALUE, F.least(F.lit(1.0), F.col("_adjusted")).alias(name)
    )
    known = df.where(is_finite(F.col(p_value))).withColumn(
        VALUE, F.col(p_value).cast("double") + F.lit(0.0)
    )
    return known.join(adjusted, VALUE).drop(VALUE)


def holm_of_few(df: DataFrame, p_value: str, name: str = "p_adj") -> DataFrame:
    """:func:`holm` in one window, for the pairs of some columns or groups.

    Those are few whatever the number of rows, and the scans of :func:`holm` would work out the
    tests themselves again for every branch.
    """
    whole = Window.partitionBy(F.lit(0))
    ordered = whole.orderBy(p_value)
    left = F.count(p_value).over(whole) - F.row_number().over(ordered) + 1
    known = df.where(is_finite(F.col(p_value))).withColumn("_scaled", left * F.col(p_value))
    running = F.max("_scaled").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn(name, F.least(F.lit(1.0), running)).drop("_scaled")


def tested_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pairs with at least four complete rows, with raw and Holm-adjusted p."""
    pairs = correlation_pairs(df, cols, method).where((F.col("n") >= 4) & F.col("r").isNotNull())
    tested = pairs.withColumn("p_value", correlation_p_value("r", "n"))
    return holm_of_few(tested, "p_value")


def significance_list(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Tested pairs with r squared and the 0.05 verdict, strongest first."""
    out = tested_pairs(df, cols, method).withColumns(
        {"r_squared": F.col("r") * F.col("r"), "significant_05": F.col("p_adj") < 0.05}
    )
    return out.select(
        "var_a", "var_b", "n", "r", "p_value", "r_squared", "p_adj", "significant_05"
    ).orderBy(F.abs("r").desc(), "var_a", "var_b")


def pvalue_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Symmetric matrix of adjusted p-values; untested pairs are NULL, the diagonal 0."""
    pairs = tested_pairs(df, cols, method)
    diagonal = _diagonal(df, cols, lambda c: F.count(F.lit(1)) * F.lit(0.0), "p_adj")
    return as_matrix(_mirrored(pairs, "p_adj").unionByName(diagonal), cols, "p_adj")
