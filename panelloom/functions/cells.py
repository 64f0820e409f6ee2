"""Column expressions for single cells: missing values, numbers, flags, codes."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def quoted(name: str) -> Column:
    """Column by its literal name, also when it holds dots or backslashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, at ingest, so that aggregates skip it."""
    floats = (T.DoubleType, T.FloatType)
    fixed = {
        f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, floats)
    }
    return df.withColumns(fixed) if fixed else df


def as_number(col: Column) -> Column:
    """Coercing numeric parse; text that is no number becomes NULL."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def is_finite(col: Column) -> Column:
    """False for NULL, NaN (which Spark orders above infinity) and infinities."""
    return F.coalesce(F.abs(col.cast("double")) < F.lit(INFINITY), F.lit(False))


def finite(col: Column) -> Column:
    """The value as double, NULL unless finite."""
    value = col.cast("double")
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def flag(col: Column) -> Column:
    return F.coalesce(col.cast("boolean"), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division by zero gives a signed infinity (NULL for 0/0) so that the
    output contract can report it; ANSI mode would end the job instead."""
    return (
        F.when(denominator != 0, numerator / F.when(denominator != 0, denominator))
        .when(numerator > 0, F.lit(INFINITY))
        .when(numerator < 0, F.lit(-INFINITY))
    )


def mapped(col: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; codes outside the dictionary stay as they are."""
    if not mapping:
        return col
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, col), col)


def period_of(label: Column) -> Column:
    """First four-digit run of a period label such as ``2024`` or ``2024-S1``."""
    return F.regexp_extract(label, r"(\d{4})", 1).cast("int")
