"""Sorted outputs, top-k lists and rankings; ties are broken by the entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.operators.slicing import listed
from panelloom.spec import PanelSpec


def sorted_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)


def ranked(df: DataFrame, metric: str, entity: str, ascending: bool = False) -> DataFrame:
    """All rows with a value, ordered by it."""
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.where(F.col(metric).isNotNull()).orderBy(order, F.col(entity))


def top_k(
    df: DataFrame, metric: str, k: int, entity: str, ascending: bool = False
) -> DataFrame:
    """The k rows with the largest (or smallest) value."""
    return ranked(df, metric, entity, ascending).limit(k)


def top_list(
    df: DataFrame, metric: str, entity: str, k: int = 3, ascending: bool = False
) -> DataFrame:
    """Top-k as one row of text ``name (+1.2), ...``; empty input gives NULL."""
    best = top_k(df.select(entity, metric), metric, k, entity, ascending)
    key = F.col(metric) if ascending else -F.col(metric)
    rows = best.agg(
        F.array_sort(F.collect_list(F.struct(key.alias("o"), F.col(entity).alias("name"),
                                             F.col(metric).alias("v")))).alias("rows")
    )
    text = F.transform("rows", lambda r: F.format_string("%s (%+.1f)", r["name"], r["v"]))
    return rows.select(
        F.when(F.size("rows") > 0, F.concat_ws(", ", text)).alias("listing")
    )


def top_names(
    df: DataFrame, metric: str, entity: str, k: int = 3, ascending: bool = False
) -> DataFrame:
    """Top-k names as one comma-joined row."""
    best = top_k(df.select(entity, metric), metric, k, entity, ascending)
    key = F.col(metric) if ascending else -F.col(metric)
    row = F.struct(key.alias("o"), F.col(entity).alias("name"))
    names = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["name"])
    return best.agg(F.concat_ws(", ", names).alias("names"))


def category_ranking(
    df: DataFrame,
    spec: PanelSpec,
    period: int,
    category_name: str,
    category: str,
    metric: str,
    entity: str,
    ascending: bool = True,
) -> DataFrame:
    """Entities of one category and period, ordered by the metric."""
    rows = df.where((F.col(spec.period) == period) & (F.col(category_name) == category))
    return ranked(rows, metric, entity, ascending)


def trend_rows(
    df: DataFrame, spec: PanelSpec, metric: str, name: str, names: Sequence[str]
) -> DataFrame:
    """Series of the chosen entities."""
    return df.where(listed(name, names)).select(name, spec.period, metric)


def best_entity(entity: str, metric: str) -> Column:
    """Aggregate: entity with the largest metric, ties to the smallest name."""
    row = F.struct((-F.col(metric)).alias("o"), F.col(entity).alias("name"))
    return F.min(F.when(F.col(metric).isNotNull(), row))["name"]
