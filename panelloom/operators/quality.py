"""Column profiles, key checks and output contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions.cells import INFINITY, flag, quoted
from panelloom.spec import PanelSpec


def profile_columns(
    df: DataFrame, view: str, stage: str, approximate: bool = False
) -> DataFrame:
    """One row per column: type, rows, missing, distinct and imputed cells.

    Cells are laid out as (column, value) and counted per value first, with
    map-side combining, so neither a hot value nor a wide table makes a hot task.
    ``approximate`` estimates the distinct counts and needs no such shuffle.
    """
    counted = _estimated_counts(df) if approximate else _exact_counts(df)
    # The list of columns comes from the schema, so an empty table has a profile too.
    schema = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    listed = df.sparkSession.range(1).select(F.explode(schema).alias("c")).select("c.*")
    zero = F.lit(0).cast("long")
    out = F.broadcast(listed).join(counted, "position", "left")
    rows = F.coalesce("row_count", zero)
    missing = F.coalesce("missing_count", zero)
    return out.select(
        F.lit(view).alias("view"),
        F.lit(stage).alias("stage"),
        "column",
        "dtype",
        rows.alias("row_count"),
        missing.alias("missing_count"),
        F.when(rows > 0, missing / F.when(rows > 0, rows) * 100).alias("missing_pct"),
        F.coalesce("unique_count", zero).alias("unique_count"),
        F.coalesce("imputed_count", zero).alias("imputed_count"),
    )


def _imputed(df: DataFrame, name: str) -> Column:
    flag_name = f"{name}_imputed"
    if name.endswith("_imputed") or flag_name not in df.columns:
        return F.lit(False)
    return flag(quoted(flag_name))


def _exact_counts(df: DataFrame) -> DataFrame:
    cells = []
    for position, field in enumerate(df.schema.fields):
        value = quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0)  # one spelling of zero
        cells.append(
            F.struct(
                F.lit(position).alias("position"),
                value.cast("string").alias("value"),
                _imputed(df, field.name).cast("long").alias("imputed"),
            )
        )
    long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    per_value = long.groupBy("position", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("imputed").alias("imputed")
    )
    missing = F.sum(F.when(F.col("value").isNull(), F.col("rows")))
    return per_value.groupBy("position").agg(
        F.sum("rows").alias("row_count"),
        missing.alias("missing_count"),
        F.count("value").alias("unique_count"),
        F.sum("imputed").alias("imputed_count"),
    )


def _estimated_counts(df: DataFrame) -> DataFrame:
    cells = [
        F.struct(
            F.lit(position).alias("position"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(quoted(name).isNull()).alias("missing_count"),
            F.approx_count_distinct(quoted(name)).alias("unique_count"),
            F.count_if(_imputed(df, name)).alias("imputed_count"),
        )
        for position, name in enumerate(df.columns)
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key tuples that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def duplicate_sample(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return duplicate_keys(df, key).orderBy(*key).limit(n)


class DuplicateKeys(ValueError):
    """A table holds a key more than once: its data are wrong, not its shape."""


class OpenDimensions(ValueError):
    """A table holds a key once for each value of dimensions that nothing selects from: it has
    another shape than the one read."""


def require_unique(df: DataFrame, key: Sequence[str], name: str) -> None:
    """Raise with up to five sample keys unless ``key`` is unique."""
    sample = [row.asDict() for row in duplicate_sample(df, key).select(*key).collect()]
    if sample:
        raise DuplicateKeys(f"{name}: {list(key)} is not unique, for instance at {sample}")


def contract_report(
    df: DataFrame,
    spec: PanelSpec,
    key: Sequence[str],
    name: str,
    min_rows: int = 1,
    min_numeric: int = 5,
) -> DataFrame:
    """The output contract as rows (check_no, name, check_name, found, passed).

    Duplicates are rows beyond the first of each key.  The table is read once.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    doubles = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    infinite = F.lit(False)
    for c in doubles:
        infinite = infinite | F.coalesce(F.abs(F.col(c)) == INFINITY, F.lit(False))
    period = F.col(spec.period)
    outside = F.lit(False)
    if spec.first_period is not None and spec.last_period is not None:
        outside = ~F.coalesce(period.between(spec.first_period, spec.last_period), F.lit(False))
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(infinite).alias("infinite"),
        F.count_if(outside).alias("outside"),
    )
    zero = F.lit(0).cast("long")
    found = per_key.agg(
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.coalesce(F.sum(F.col("rows") - 1), zero).alias("duplicates"),
        F.coalesce(F.sum("infinite"), zero).alias("infinite"),
        F.coalesce(F.sum("outside"), zero).alias("outside"),
    )
    checks = [
        ("min_rows", F.col("rows"), F.col("rows") >= min_rows),
        ("duplicate_keys", F.col("duplicates"), F.col("duplicates") == 0),
        (
            "numeric_columns",
            F.lit(len(numeric)).cast("long"),
            F.lit(len(numeric) >= min_numeric),
        ),
        ("infinite_values", F.col("infinite"), F.col("infinite") == 0),
        ("period_out_of_range", F.col("outside"), F.col("outside") == 0),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("check_no"),
                F.lit(name).alias("name"),
                F.lit(check).alias("check_name"),
                value.alias("found"),
                passed.alias("passed"),
            )
            for i, (check, value, passed) in enumerate(checks, start=1)
        ]
    )
    return found.select(F.explode(rows).alias("c")).select("c.*")


def require_contract(
    df: DataFrame,
    spec: PanelSpec,
    key: Sequence[str],
    name: str,
    min_rows: int = 1,
    min_numeric: int = 5,
) -> None:
    """Raise on the first failed check of :func:`contract_report`."""
    report = contract_report(df, spec, key, name, min_rows, min_numeric)
    for row in sorted(report.collect(), key=lambda r: r["check_no"]):
        if not row["passed"]:
            raise ValueError(f"{name}: check {row['check_name']} failed, found {row['found']}")


def reconcile_flags(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Compare the imputed counts of a profile with the sums of the flag columns."""
    measures = [c for c in df.columns if f"{c}_imputed" in df.columns]
    sums = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(flag(F.col(f"{c}_imputed"))).alias(c) for c in measures],
    ).unpivot([], measures, "column", "flag_sum")
    joined = profile.select("column", "imputed_count").join(sums, "column")
    return joined.withColumn("agrees", F.col("imputed_count") == F.col("flag_sum"))
