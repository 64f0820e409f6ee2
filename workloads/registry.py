"""Registration of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workloads.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; doubles are rounded alike on both sides."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Tables(spark, sf_dir))
            return df.select(
                *[
                    (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
                    if isinstance(f.dataType, T.DoubleType)
                    else F.col(f"`{f.name}`")
                    for f in df.schema.fields
                ]
            )

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _rounded(sql, doubles.split(), digits)
        return build

    return register


def _rounded(sql: str, doubles: list[str], digits: int) -> str:
    if not doubles:
        return sql
    cells = ", ".join(
        f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0::DOUBLE AS "{c}"' for c in doubles
    )
    return f"SELECT * REPLACE ({cells}) FROM (\n{sql}\n) AS q"
