"""Scans with contracts, and a materialise-once cache of raw tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.cells import nan_to_null, quoted

# A condition on a stored column: its name, a comparison, and a value (a list for "in").
Condition = tuple[str, str, object]

# Layout of the lookup and of the exclusion report.
LOOKUP_SCHEMA = "country_code string, country_name string, iso3 string, region string"
EXCLUSION_SCHEMA = "country_code string, year int, missing_columns string"


def matching(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Rows that meet all conditions; a NULL meets none."""
    compare = {
        "=": lambda c, v: c == v,
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(list(v)),
    }
    for column, comparison, value in conditions:
        if comparison not in compare:
            raise ValueError(f"unknown comparison {comparison}")
        df = df.where(compare[comparison](quoted(column), value))
    return df


def read_parquet(
    spark: SparkSession, path: str, conditions: Sequence[Condition] = ()
) -> DataFrame:
    """Parquet scan with NaN turned into NULL, of the rows that meet the conditions.

    A filter on a cleaned column never reaches the scan.  Conditions are put to the stored
    columns first, where row groups can be skipped by them.  That loses nothing, since a value
    that meets one after cleaning is no NaN and met it before; NaN, which is above all numbers
    as stored, is dropped by the same conditions on the cleaned columns.
    """
    stored = matching(spark.read.parquet(path), conditions)
    return matching(nan_to_null(stored), conditions)


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} has an outdated schema. Missing columns: {', '.join(missing)}")
    return df


def read_contract(
    spark: SparkSession, path: str, required: Sequence[str], conditions: Sequence[Condition] = ()
) -> DataFrame:
    """Parquet scan whose required columns are checked before any row is read."""
    name = PurePosixPath(path).name
    require_columns(spark.read.parquet(path), required, name)
    return read_parquet(spark, path, conditions)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return nan_to_null(spark.read.csv(path, header=True, schema=schema))


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An absent report is an empty table of the known schema."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def filter_dimensions(df: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Source-level filters; those on absent dimensions are left to the profile.

    Plain ``IN`` predicates on stored columns, so they reach the Parquet scan.
    """
    for c, allowed in dimensions.items():
        if c in df.columns:
            df = df.where(quoted(c).isin(list(allowed)))
    return df


def cached_table(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Read ``path``, or build the table once, write it there and read it back.

    The path belongs on storage shared by all executors.  The table is built once; an empty
    one is an error and does not count as stored, so the next call builds again.
    """
    try:
        table = read_parquet(spark, path)
        if not table.isEmpty():
            return table
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    build().write.mode("overwrite").parquet(path)
    table = read_parquet(spark, path)
    if table.isEmpty():
        raise ValueError(f"source for {path} returned an empty table")
    return table


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
