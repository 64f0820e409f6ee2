"""Filters that cut a panel to what a caller looks at."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import is_finite
from panelloom.spec import PanelSpec


def filter_panel(
    df: DataFrame,
    spec: PanelSpec,
    periods: tuple[int, int] | None = None,
    entities: Sequence[str] | None = None,
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive filters; None or an empty list means no restriction."""
    if periods is not None:
        df = df.where(F.col(spec.period).between(*periods))
    if entities:
        df = df.where(F.col(spec.entity).isin(list(entities)))
    if groups:
        df = df.where(F.col(spec.group).isin(list(groups)))
    return df


def listed(column: str, values: Sequence[str]) -> Column:
    """Membership where an empty list selects nothing."""
    return F.col(column).isin(list(values)) if values else F.lit(False)


@dataclass(frozen=True)
class Slice:
    """What a dashboard user selected."""

    periods: tuple[int, int]
    groups: Sequence[str]
    names: Sequence[str]
    reference_period: int


@dataclass(frozen=True)
class SlicedViews:
    """Lazy frames behind all views of one selection."""

    panel: DataFrame
    categories: DataFrame | None
    scope: DataFrame
    reference: DataFrame


def slice_scope(df: DataFrame, spec: PanelSpec, cut: Slice, name: str) -> DataFrame:
    """Group and entity selection over all periods."""
    return df.where(listed(spec.group, cut.groups) & listed(name, cut.names))


def slice_views(
    df: DataFrame,
    spec: PanelSpec,
    cut: Slice,
    name: str,
    categories: DataFrame | None = None,
) -> SlicedViews:
    in_periods = F.col(spec.period).between(*cut.periods)
    scope = slice_scope(df, spec, cut, name)
    panel = scope.where(in_periods)
    return SlicedViews(
        panel=panel,
        categories=(
            None
            if categories is None
            else slice_scope(categories, spec, cut, name).where(in_periods)
        ),
        scope=scope,
        reference=panel.where(F.col(spec.period) == cut.reference_period),
    )


def default_periods(df: DataFrame, spec: PanelSpec, last: int = 10) -> DataFrame:
    """One row: period range of the table, default range and reference period."""
    ends = df.agg(F.min(spec.period).alias("min_period"), F.max(spec.period).alias("max_period"))
    return ends.withColumns(
        {
            "from_period": F.greatest(
                F.col("min_period"), F.col("max_period") - F.lit(last - 1)
            ),
            "to_period": F.col("max_period"),
            "reference_period": F.col("max_period"),
        }
    )


def default_groups(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.select(spec.group).dropna().distinct().orderBy(spec.group)


def default_names(
    df: DataFrame, spec: PanelSpec, name: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Selectable entities: those of the groups, or all without a group."""
    rows = df.where(F.col(spec.group).isin(list(groups))) if groups else df
    return rows.select(name).distinct().orderBy(name)


def default_slice(df: DataFrame, spec: PanelSpec, name: str) -> Slice:
    """The selection a user starts from (reads the small option lists)."""
    ends = default_periods(df, spec).first()
    groups = [r[0] for r in default_groups(df, spec).collect()]
    names = [r[0] for r in default_names(df, spec, name, groups).collect()]
    return Slice(
        periods=(ends["from_period"], ends["to_period"]),
        groups=groups,
        names=names,
        reference_period=ends["reference_period"],
    )


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def keep_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every listed column is a finite number."""
    for c in columns:
        df = df.where(is_finite(F.col(c).try_cast("double")))
    return df


def keep_positive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c) > 0)
    return df
