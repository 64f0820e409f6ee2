"""Combining sources and attaching context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.operators.quality import require_unique
from panelloom.plans.order_stats import as_scalar
from panelloom.spec import PanelSpec


def stack(parts: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)


def merge_measures(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Full outer merge of measure tables that are unique on ``key``.

    One union and one aggregation: a single shuffle for any number of tables,
    partial aggregation before it, and key filters reach every scan.
    """
    measures = []
    for part in parts:
        measures += [c for c in part.columns if c not in key and c not in measures]
    merged = stack(parts, allow_missing=True).groupBy(*key)
    return merged.agg(*[F.max(c).alias(c) for c in measures])


def merge_measures_by_join(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The same merge as a literal chain of full outer joins."""
    return reduce(lambda a, b: a.join(b, list(key), "full"), parts)


def attach_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join to a lookup; rows without an entry keep NULL attributes.

    The join carries no hint: Spark broadcasts a lookup whose files are known to
    be small and shuffles a large one, splitting skewed keys at run time.
    """
    return df.join(lookup, key, "left")


def keep_listed(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Semi-join: keep rows whose key occurs in the lookup."""
    return df.join(lookup.select(key), key, "left_semi")


def attach_context(
    grid: DataFrame, context: DataFrame, key: Sequence[str], validate: bool = True
) -> DataFrame:
    """Inner join, many grid rows to one context row; duplicate context keys raise."""
    if validate:
        require_unique(context, key, "context of a many-to-one join")
    return grid.join(context, list(key), "inner")


def with_frame_statistics(
    df: DataFrame, statistics: DataFrame, use: Mapping[str, str]
) -> DataFrame:
    """Put values of a one-row table next to every row (``{new name: statistic}``)."""
    row = as_scalar(statistics)
    return df.withColumns({new: row[old] for new, old in use.items()})


def pick_by_priority(
    parts: Sequence[DataFrame],
    spec: PanelSpec,
    value: str,
    source: str,
    priority: str,
) -> DataFrame:
    """Per key prefer a row that has a value, then the lower priority number; the
    source is blanked when no candidate has a value.

    An aggregation with ``min_by`` combines map-side, so a key that occurs often
    is reduced before the shuffle.
    """
    rows = stack(parts, allow_missing=True)
    others = [c for c in rows.columns if c not in (*spec.key, value, source, priority)]
    row = F.struct(value, source, *others)
    rank = F.struct(F.col(value).isNull(), F.col(priority), F.col(source))
    best = rows.groupBy(*spec.key).agg(F.min_by(row, rank).alias("_best"))
    picked: Column = F.col(f"_best.{value}")
    return best.select(
        *spec.key,
        picked.alias(value),
        F.when(picked.isNotNull(), F.col(f"_best.{source}")).alias(source),
        *[F.col(f"_best.{c}").alias(c) for c in others],
    )


def label_interpolated(df: DataFrame, value: str, source: str) -> DataFrame:
    """A value without a source was filled in by the gap policy."""
    label = F.when(F.col(value).isNotNull() & F.col(source).isNull(), F.lit("interpolated"))
    return df.withColumn(source, F.coalesce(label, F.col(source)))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct on ``key``, keeping the first row by ``order`` (ties by all columns)."""
    row = F.struct(*df.columns)
    rank = F.struct(*order, *[c for c in df.columns if c not in order])
    best = df.groupBy(*key).agg(F.min_by(row, rank).alias("_row"))
    return best.select("_row.*")
