"""Published tables and report exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_view(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A published table; Parquet, optionally partitioned for pruning."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with header; a global order is a range-partitioned sort, so the part
    files are in order and no task holds the whole table."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").csv(path, header=True)
