"""Exact ranks and quantiles of groups of any size.

``percentile`` keeps all values of a group in one task and ``rank()`` sorts a
group in one task.  Here equal values are first collapsed to (group, value, count)
with map-side combining; running counts then come from a three-level scan.  The
levels are a monotone digit expansion of the double value (sign, exponent and ten
mantissa bits; the next 21 bits; the rest), so no window holds more than about
4.4 million distinct values whatever the data looks like, and no sampled split
points are involved: a recomputed partition yields the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.cells import finite, is_finite

VALUE = "_value"
COUNT = "_n"
_COARSE = "_coarse"
_FINE = "_fine"


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Finite values per key tuple with their multiplicities (NULL keys dropped)."""
    weights = weights or {COUNT: F.count(F.lit(1))}
    rows = df
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    # Not nullable, so that joins on the value push no null filter below the counts and all
    # branches of a plan reuse one exchange.
    rows = rows.where(is_finite(F.col(value))).withColumn(
        VALUE, F.coalesce(F.col(value).cast("double"), F.lit(0.0)) + F.lit(0.0)
    )
    return rows.groupBy(*keys, VALUE).agg(*[w.alias(name) for name, w in weights.items()])


# Two monotone leading digits of a finite double.  log2(0) is NULL, so zero gets
# digit 0.  The coalesce also keeps the digits non-nullable: joins on them then push
# no null filter below the counts, and all branches of a scan reuse one exchange.
_EXPONENT = f"greatest(floor(log2(abs({VALUE}))), -1074)"
_SCALED = f"((abs({VALUE}) / pow(2D, {_EXPONENT}) - 1D) * 1024D)"
_SIGN = f"IF({VALUE} > 0, 1, -1)"
_DIGITS = {
    _COARSE: f"({_EXPONENT} + 1100) * 1024 + floor({_SCALED}) + 1",
    _FINE: f"floor(({_SCALED} - floor({_SCALED})) * {1 << 21})",
}


def _with_digits(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            name: F.expr(f"coalesce(CAST({_SIGN} * ({digit}) AS int), 0)")
            for name, digit in _DIGITS.items()
        }
    )


def running_totals(
    counts: DataFrame, keys: Sequence[str], weights: Sequence[str] = (COUNT,)
) -> DataFrame:
    """Add ``<w>_below`` (sum over smaller values) and ``<w>_total`` per key tuple.

    ``counts`` holds one row per (keys, VALUE), as made by :func:`value_counts`.
    """
    keys = list(keys)
    counts = _with_digits(counts)
    before = (Window.unboundedPreceding, -1)

    def sums() -> list[Column]:
        return [F.sum(w).alias(w) for w in weights]

    def preceding(w: str, scope: list[str], order: str) -> Column:
        window = Window.partitionBy(*scope).orderBy(order).rowsBetween(*before)
        return F.coalesce(F.sum(w).over(window), F.lit(0))

    fine_sums = counts.groupBy(*keys, _COARSE, _FINE).agg(*sums())
    coarse_sums = fine_sums.groupBy(*keys, _COARSE).agg(*sums())
    whole = Window.partitionBy(*keys)
    coarse_scan = coarse_sums.select(
        *keys,
        _COARSE,
        *[preceding(w, keys, _COARSE).alias(f"{w}_below_coarse") for w in weights],
        *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
    )
    totals = [f"{w}_total" for w in weights]
    at_coarse = [*keys, _COARSE]
    fine_scan = fine_sums.join(coarse_scan, at_coarse).select(
        *at_coarse,
        _FINE,
        *[
            (F.col(f"{w}_below_coarse") + preceding(w, at_coarse, _FINE)).alias(f"{w}_below_fine")
            for w in weights
        ],
        *totals,
    )
    at_fine = [*keys, _COARSE, _FINE]
    kept = [c for c in counts.columns if c not in (_COARSE, _FINE)]
    return counts.join(fine_scan, at_fine).select(
        *kept,
        *[
            (F.col(f"{w}_below_fine") + preceding(w, at_fine, VALUE)).alias(f"{w}_below")
            for w in weights
        ],
        *totals,
    )


def running_maximum(rows: DataFrame, keys: Sequence[str], weight: str, name: str) -> DataFrame:
    """Add ``name``, the largest ``weight`` over values up to and with the row's own.

    ``rows`` holds one row per (keys, VALUE).  The same three levels as in
    :func:`running_totals` bound every window.
    """
    keys = list(keys)
    rows = _with_digits(rows)
    before = (Window.unboundedPreceding, -1)
    at_coarse, at_fine = [*keys, _COARSE], [*keys, _COARSE, _FINE]

    def preceding(scope: list[str], order: str) -> Column:
        window = Window.partitionBy(*scope).orderBy(order).rowsBetween(*before)
        return F.max("_most").over(window)

    fine = rows.groupBy(*at_fine).agg(F.max(weight).alias("_most"))
    coarse = fine.groupBy(*at_coarse).agg(F.max("_most").alias("_most"))
    coarse_scan = coarse.select(*at_coarse, preceding(keys, _COARSE).alias("_most_coarse"))
    fine_scan = fine.join(coarse_scan, at_coarse).select(
        *at_fine, F.greatest("_most_coarse", preceding(at_coarse, _FINE)).alias("_most_before")
    )
    own = Window.partitionBy(*at_fine).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in rows.columns if c not in (_COARSE, _FINE)]
    return rows.join(fine_scan, at_fine).select(
        *kept, F.greatest("_most_before", F.max(weight).over(own)).alias(name)
    )


def average_rank(below: Column, ties: Column) -> Column:
    """Mean 1-based rank of a run of equal values."""
    return below + (ties + F.lit(1)) / F.lit(2.0)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    approximate: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles per key tuple, and ``n``.

    Exact unless ``approximate`` asks for Spark's quantile sketch.
    """
    if not approximate:
        return quantiles_of_counts(value_counts(df, keys, value), keys, probs)
    rows = df.where(is_finite(F.col(value)))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    sketch = F.percentile_approx(F.col(value).cast("double"), list(probs.values()), 10_000)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("_q"))
    return found.select(*keys, "n", *[F.col("_q")[i].alias(p) for i, p in enumerate(probs)])


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Radix selection: only the digit buckets that hold a wanted position go on
    to the next level, so after the first count almost nothing is sorted."""
    keys = list(keys)
    counts = _with_digits(counts)
    before = (Window.unboundedPreceding, -1)

    def place(p: float, rounding: str) -> str:
        return f"{rounding}((n - 1) * {float(p)!r}D)"

    def holds(index: str) -> str:
        return f"(_below <= {index} AND {index} < _below + _here)"

    indexes = {place(p, way) for p in probs.values() for way in ("floor", "ceil")}
    wanted = F.expr(" OR ".join(sorted(holds(i) for i in indexes)))

    def preceding(scope: list[str], order: str) -> Column:
        window = Window.partitionBy(*scope).orderBy(order).rowsBetween(*before)
        return F.coalesce(F.sum("_here").over(window), F.lit(0))

    at_coarse, at_fine = [*keys, _COARSE], [*keys, _COARSE, _FINE]
    coarse_picks = (
        counts.groupBy(*at_coarse)
        .agg(F.sum(COUNT).alias("_here"))
        .withColumns(
            {
                "_below": preceding(keys, _COARSE),
                "n": F.sum("_here").over(Window.partitionBy(*keys)),
            }
        )
        .where(wanted)
        .select(*at_coarse, F.col("_below").alias("_below_coarse"), "n")
    )
    fine_picks = (
        counts.join(coarse_picks, at_coarse)
        .groupBy(*at_fine)
        .agg(
            F.sum(COUNT).alias("_here"),
            F.max("_below_coarse").alias("_below_coarse"),
            F.max("n").alias("n"),
        )
        .withColumn("_below", F.col("_below_coarse") + preceding(at_coarse, _FINE))
        .where(wanted)
        .select(*at_fine, F.col("_below").alias("_below_fine"), "n")
    )
    values = (
        counts.join(fine_picks, at_fine)
        .withColumnRenamed(COUNT, "_here")
        .withColumn("_below", F.col("_below_fine") + preceding(at_fine, VALUE))
    )
    picks = []
    for name, p in probs.items():
        for side, way in (("lo", "floor"), ("hi", "ceil")):
            hit = f"max(CASE WHEN {holds(place(p, way))} THEN {VALUE} END)"
            picks.append(F.expr(hit).alias(f"{name}_{side}"))
    found = values.groupBy(*keys, "n").agg(*picks)
    between = {
        name: f"{name}_lo + ({name}_hi - {name}_lo) * "
        f"((n - 1) * {float(p)!r}D - {place(p, 'floor')})"
        for name, p in probs.items()
    }
    return found.select(*keys, "n", *[F.expr(e).alias(name) for name, e in between.items()])


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles of several columns from one pass: rows (column, n, <probs>)."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return quantiles(long, ["column"], "value", probs)


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the median of each column under the column's own name."""
    long = column_quantiles(df, columns, {"median": 0.5})
    return long.agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    )


def as_scalar(one_row: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery (no join needed)."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with the tie-averaged rank of ``value`` inside ``keys`` (NULL unranked)."""
    scan = running_totals(value_counts(df, keys, value), keys)
    ranks = scan.select(
        *keys, VALUE, average_rank(F.col(f"{COUNT}_below"), F.col(COUNT)).alias(name)
    )
    rows = df.withColumn(VALUE, finite(F.col(value)) + F.lit(0.0))
    return rows.join(ranks, [*keys, VALUE], "left").drop(VALUE)
