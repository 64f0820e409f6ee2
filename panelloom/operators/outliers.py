"""Tukey fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import INFINITY, is_finite
from panelloom.plans.order_stats import as_scalar, column_quantiles


def _quartiles(df: DataFrame, metric: str):
    row = column_quantiles(df, [metric], {"q1": 0.25, "q3": 0.75})
    return as_scalar(row.agg(F.max("q1").alias("q1"), F.max("q3").alias("q3")))


def iqr_outliers(df: DataFrame, metric: str, entity: str, n: int = 10) -> DataFrame:
    """The n finite rows farthest outside the 1.5 IQR fences.

    Distance is in units of the IQR.  A zero or overflowing IQR flags nothing.
    """
    cut = _quartiles(df, metric)
    rows = df.where(is_finite(F.col(metric))).withColumn("_cut", cut)
    spread = F.col("_cut.q3") - F.col("_cut.q1")
    usable = (spread > 0) & (spread < INFINITY)
    rows = rows.where(usable).withColumns(
        {
            "iqr_lower": F.col("_cut.q1") - 1.5 * spread,
            "iqr_upper": F.col("_cut.q3") + 1.5 * spread,
        }
    )
    value, safe = F.col(metric), F.when(spread > 0, spread)
    beyond = F.when(value < F.col("iqr_lower"), F.col("iqr_lower") - value).otherwise(
        value - F.col("iqr_upper")
    )
    rows = rows.where((value < F.col("iqr_lower")) | (value > F.col("iqr_upper")))
    rows = rows.withColumn("iqr_distance", beyond / safe)
    rows = rows.select(*df.columns, "iqr_distance", "iqr_lower", "iqr_upper")
    return rows.orderBy(F.col("iqr_distance").desc(), entity).limit(n)


def iqr_mask(df: DataFrame, metric: str, k: float = 1.5, name: str = "is_outlier") -> DataFrame:
    """Mark values outside ``[q1 - k iqr, q3 + k iqr]``; NULL is not an outlier."""
    rows = df.withColumn("_cut", _quartiles(df, metric))
    spread = F.col("_cut.q3") - F.col("_cut.q1")
    outside = (F.col(metric) < F.col("_cut.q1") - k * spread) | (
        F.col(metric) > F.col("_cut.q3") + k * spread
    )
    return rows.withColumn(name, F.coalesce(outside, F.lit(False))).drop("_cut")
