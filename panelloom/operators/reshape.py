"""Wide statistical tables to long panels, projections and display names."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import as_number, mapped, period_of, quoted
from panelloom.operators.quality import (
    DuplicateKeys,
    OpenDimensions,
    duplicate_keys,
    require_unique,
)
from panelloom.spec import PanelSpec

# Period columns are years or half-years.
PERIOD_COLUMN = re.compile(r"\d{4}(-S[12])?")


def period_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if PERIOD_COLUMN.fullmatch(c)]


def entity_column(df: DataFrame) -> str:
    """First column whose name starts with ``geo`` in any case."""
    for c in df.columns:
        if c.lower().startswith("geo"):
            return c
    raise ValueError(f"no geo column among {df.columns}")


def wide_to_long(
    df: DataFrame,
    spec: PanelSpec,
    value: str,
    codes: Mapping[str, str] | None = None,
    ids: Sequence[str] = (),
) -> DataFrame:
    """Melt period columns to rows (entity, period, *ids, value).

    Entity codes are normalised, numbers parsed with coercion and periods clipped
    to the declared range.  Columns of periods out of range are not even read.
    """
    periods = period_columns(df)
    if spec.first_period is not None and spec.last_period is not None:
        periods = [
            p for p in periods if spec.first_period <= int(p[:4]) <= spec.last_period
        ]
    if not periods:
        raise ValueError(f"no period column in range among {df.columns}")
    entity = mapped(quoted(entity_column(df)).cast("string"), codes or {})
    narrow = df.select(
        entity.alias(spec.entity), *ids, *[as_number(quoted(p)).alias(p) for p in periods]
    )
    keys = [spec.entity, *ids]
    long = narrow.unpivot(keys, [quoted(p) for p in periods], "_label", value)
    return long.select(
        spec.entity, period_of(F.col("_label")).alias(spec.period), *ids, value
    )


def wide_to_panel(
    df: DataFrame,
    spec: PanelSpec,
    value: str,
    codes: Mapping[str, str] | None = None,
    declared: Collection[str] = (),
) -> DataFrame:
    """Long form whose (entity, period) key is checked to be unique.

    If dimensions other than the ``declared`` ones tell all rows of every key apart, the error
    is :class:`OpenDimensions`; a key that occurs twice with equal dimensions is an error of the
    data, :class:`DuplicateKeys`.
    """
    long = wide_to_long(df, spec, value, codes)
    try:
        require_unique(long, spec.key, value)
    except DuplicateKeys as error:
        known = {entity_column(df), *period_columns(df), *declared}
        dimensions = [c for c in df.columns if c not in known]
        if not dimensions:
            raise
        cells = F.array(*[quoted(c).cast("string") for c in dimensions])
        told_apart = wide_to_long(
            df.withColumn("_dimensions", cells), spec, value, codes, ids=["_dimensions"]
        )
        if not duplicate_keys(told_apart, [*spec.key, "_dimensions"]).isEmpty():
            raise
        raise OpenDimensions(f"{error}; open dimensions: {dimensions}") from error
    return long


def average_subperiods(long: DataFrame, spec: PanelSpec, value: str) -> DataFrame:
    """Mean of the sub-periods of one period; NULLs are skipped."""
    return long.groupBy(*spec.key).agg(F.avg(value).alias(value))


def wide_to_category_grid(
    df: DataFrame,
    spec: PanelSpec,
    value: str,
    source_category: str,
    category_names: Mapping[str, str],
    category_name: str,
    codes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Long form by category, limited to known categories; NULL cells stay."""
    known = df.where(F.col(source_category).isin(list(category_names)))
    renamed = known.withColumnRenamed(source_category, spec.category)
    long = wide_to_long(renamed, spec, value, codes, ids=[spec.category])
    return long.withColumn(
        category_name, mapped(F.col(spec.category), category_names)
    ).select(*spec.key, spec.category, category_name, value)


def select_dimension_profile(
    df: DataFrame, profiles: Sequence[Mapping[str, set[str]]], source: str
) -> DataFrame:
    """Rows of the first profile whose columns exist and that matches any row."""
    tried = []
    for profile in profiles:
        if not set(profile) <= set(df.columns):
            continue
        tried.append({c: sorted(allowed) for c, allowed in profile.items()})
        selected = df
        for c, allowed in profile.items():
            selected = selected.where(quoted(c).cast("string").isin(sorted(allowed)))
        if not selected.isEmpty():
            return selected
    if tried:
        raise ValueError(f"{source}: no rows match supported profiles: {tried}")
    dimensions = [c for c in df.columns if c not in period_columns(df)]
    raise ValueError(f"{source}: unsupported dimensions. Available: {dimensions}")


def normalise_codes(df: DataFrame, column: str, codes: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(codes), subset=[column])


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fixed column order, tolerant of absent optional columns."""
    return df.select(*[c for c in order if c in df.columns])


def for_display(
    df: DataFrame,
    labels: Mapping[str, str],
    group: str,
    group_labels: Mapping[str, str],
) -> DataFrame:
    """Display names for columns, and display values for the group column."""
    if group in df.columns:
        df = df.withColumn(group, mapped(F.col(group), group_labels))
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})
