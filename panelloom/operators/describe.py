"""Descriptive aggregates and the data behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cells import finite, is_finite
from panelloom.operators.ranking import best_entity
from panelloom.plans.order_stats import (
    as_scalar,
    column_medians,
    column_quantiles,
    quantiles,
)
from panelloom.spec import PanelSpec


def group_means(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Mean per group, largest first; NULL groups and NULL means are dropped."""
    out = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(metric).alias("mean"))
    return out.where(F.col("mean").isNotNull()).orderBy(F.col("mean").desc(), group)


def group_medians(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Exact median per group, largest first."""
    out = quantiles(df, [group], metric, {"median": 0.5}).select(group, "median")
    return out.orderBy(F.col("median").desc(), group)


def numeric_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != spec.period
    ]


def describe_columns(
    df: DataFrame, spec: PanelSpec, columns: Sequence[str] | None = None
) -> DataFrame:
    """Count, mean, median, deviation, quartiles and range of numeric columns."""
    columns = list(columns or numeric_columns(df, spec))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = values.unpivot([], columns, "column", "value")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    cuts = column_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(cuts.drop("n"), "column", "left").select(
        "column", "count", "mean", "median", "std", "q1", "q3", "min", "max"
    )


def period_pivot(
    df: DataFrame, spec: PanelSpec, entity: str, metric: str, periods: Sequence[int]
) -> DataFrame:
    """Entities by periods with mean cells, highest row mean first.

    The row mean is the mean of the non-NULL period cells.
    """
    cells = df.where(F.col(spec.period).isin(list(periods)))
    wide = cells.groupBy(entity).pivot(spec.period, list(periods)).agg(F.avg(metric))
    names = [str(p) for p in periods]
    known = F.filter(F.array(*[F.col(f"`{p}`") for p in names]), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    wide = wide.withColumn("row_mean", total / F.when(F.size(known) > 0, F.size(known)))
    return wide.where(F.col("row_mean").isNotNull()).orderBy(F.col("row_mean").desc(), entity)


def key_figures(
    df: DataFrame, entity: str, gap: str, share: str, rate: str, reference_rate: str
) -> DataFrame:
    """One row: entities with the largest gap and share, mean rates and their
    difference, median gap."""
    median = as_scalar(column_medians(df, [gap]))
    row = df.agg(
        best_entity(entity, gap).alias("top_gap_entity"),
        F.max(gap).alias("top_gap"),
        F.avg(rate).alias("mean_rate"),
        F.avg(reference_rate).alias("mean_reference_rate"),
        best_entity(entity, share).alias("top_share_entity"),
        F.max(share).alias("top_share"),
    )
    return row.withColumns(
        {
            "rate_difference": F.col("mean_rate") - F.col("mean_reference_rate"),
            "median_gap": median[gap],
        }
    )


def grain_size(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows and distinct values: ``{output name: column}``."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_distinct(F.col(c)).alias(name) for name, c in names.items()],
    )


def category_funnel(grid: DataFrame, metric: str, final: DataFrame) -> DataFrame:
    """Raw grid rows, missing cells, observed rows and rows of the final view."""
    n_final = final.agg(F.count(F.lit(1)).alias("n")).scalar()
    row = grid.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col(metric).isNull()).alias("missing")
    )
    return row.select(
        "raw_rows",
        "missing",
        (F.col("raw_rows") - F.col("missing")).alias("observed"),
        n_final.alias("final_rows"),
    )


def run_summary(df: DataFrame, spec: PanelSpec, excluded: DataFrame) -> DataFrame:
    """Rows, entities and period range of a published panel, and removed rows."""
    removed = excluded.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(spec.entity).alias("n_entities"),
        F.min(spec.period).alias("min_period"),
        F.max(spec.period).alias("max_period"),
    ).withColumn("removed_rows", removed)


def scale_range(
    df: DataFrame, metric: str, robust: bool = False, diverging: bool = False
) -> DataFrame:
    """One row (low, high): value range for a colour scale, NULL without values.

    Robust: 5th to 95th percentile from 20 values on.  Diverging metrics that
    span zero become symmetric; a single value is padded.
    """
    cuts = {"p0": 0.0, "p5": 0.05, "p95": 0.95, "p100": 1.0}
    row = column_quantiles(df, [metric], cuts).agg(
        F.max("n").alias("n"), *[F.max(c).alias(c) for c in cuts]
    )
    trimmed = F.lit(robust) & (F.col("n") >= 20)
    low = F.when(trimmed, F.col("p5")).otherwise(F.col("p0"))
    high = F.when(trimmed, F.col("p95")).otherwise(F.col("p100"))
    row = row.select(low.alias("low"), high.alias("high"))
    if diverging:
        limit = F.greatest(F.abs("low"), F.abs("high"))
        spans = (F.col("low") < 0) & (F.col("high") > 0)
        row = row.select(
            F.when(spans, -limit).otherwise(F.col("low")).alias("low"),
            F.when(spans, limit).otherwise(F.col("high")).alias("high"),
        )
    share = F.abs("low") * 0.05
    pad = F.when(F.col("low") != F.col("high"), F.lit(0.0)).otherwise(
        F.when(share == 0, F.lit(1.0)).otherwise(share)
    )
    return row.select((F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))


def histogram_bins(df: DataFrame, metric: str) -> DataFrame:
    """One row (n, low, high, bins): Freedman-Diaconis, else Sturges; below two
    values one bin."""
    cuts = {"low": 0.0, "q1": 0.25, "q3": 0.75, "high": 1.0}
    row = column_quantiles(df, [metric], cuts).agg(
        F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"),
        *[F.max(c).alias(c) for c in cuts],
    )
    n = F.col("n")
    width = F.lit(2.0) * (F.col("q3") - F.col("q1")) / F.cbrt(F.when(n > 0, n))
    span = F.col("high") - F.col("low")
    usable = (width > 0) & (span > 0)
    bins = (
        F.when(n < 2, F.lit(1))
        .when(usable, F.ceil(span / F.when(usable, width)))
        .otherwise(F.ceil(F.log2(F.when(n > 0, n)) + 1))
    )
    return row.select("n", "low", "high", F.greatest(F.lit(1), bins).cast("long").alias("bins"))


def histogram(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Counts per equal-width bin of [min, max] and group."""
    shape = as_scalar(histogram_bins(df, metric))
    value = F.col(metric).cast("double")
    rows = df.where(is_finite(F.col(metric))).select(group, value.alias("v"), shape.alias("s"))
    span = F.col("s.high") - F.col("s.low")
    step = F.floor((F.col("v") - F.col("s.low")) / F.when(span > 0, span) * F.col("s.bins"))
    number = F.least(F.coalesce(step, F.lit(0)) + 1, F.col("s.bins"))
    return rows.groupBy(number.cast("long").alias("bin"), group).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through finite pairs; NULL below two distinct x."""
    pairs = df.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    enough = F.min(x) < F.max(x)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.regr_slope(y, x)).alias("slope"),
        F.when(enough, F.regr_intercept(y, x)).alias("intercept"),
    )


def scatter_rows(
    df: DataFrame, keep: Sequence[str], x: str, y: str, size: str, name: str = "point_size"
) -> DataFrame:
    """Finite pairs with a point size: NULL becomes the median size (1 if there is
    none above zero), at least 0.1, rounded half to even."""
    pairs = df.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    median = as_scalar(column_medians(pairs, [size]))[size]
    fallback = F.when(F.coalesce(median, F.lit(0.0)) > 0, median).otherwise(F.lit(1.0))
    shown = F.bround(F.greatest(F.coalesce(F.col(size), fallback), F.lit(0.1)), 1)
    return pairs.select(*keep, x, y, shown.alias(name))


def cross_section(
    df: DataFrame, spec: PanelSpec, period: int, metric: str, location: str
) -> DataFrame:
    """Rows of one period, marked by whether they have a value; rows without a
    value need a location to be drawn as missing."""
    rows = df.where(F.col(spec.period) == period)
    rows = rows.withColumn("has_value", F.col(metric).isNotNull())
    return rows.where(F.col("has_value") | F.col(location).isNotNull())


def endpoint_medians(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    return column_medians(summary, columns)


def box_stats(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Five-number summary and number of points per group."""
    cuts = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return quantiles(df, [group], metric, cuts)


def box_points(df: DataFrame, group: str, metric: str, keep: Sequence[str] = ()) -> DataFrame:
    """The single observations drawn next to each box."""
    rows = df.where(is_finite(F.col(metric)))
    return rows.select(group, *keep, finite(F.col(metric)).alias(metric))


def schema_rows(df: DataFrame) -> DataFrame:
    """Rows (position, column, dtype) of a frame's schema."""
    fields: list[Column] = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    rows = df.sparkSession.range(1).select(F.explode(F.array(*fields)).alias("c"))
    return rows.select("c.*")
