"""Helpers the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelloom.sources.shared import shared_folder

# A shingle or token word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file: the installed package, else /opt/tokenizers."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


def id_text(column: str) -> Column:
    """An id as text, for Python workers: beside a null, pandas holds longs as doubles."""
    return F.col(column).cast("long").cast("string")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage ends there, and
    any executor can read every part again."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(
    df: DataFrame, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row, in ``order``.

    Rows are range-partitioned by ``order`` and stored with the number of their range, so
    that every later pass sees the same ranges.  Sums of ranges (one row each) give each
    range's start; within a range a window adds the rest.  No task sees more than a range.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    by = [F.col(n).asc_nulls_last() for n in names]
    ranged = stored(
        keyed.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    starts = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, "_range")
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_range", "_start", "_inside", *names)
    )


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ragged_positions(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each length, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs that begin at ``starts`` with ``lengths``, concatenated."""
    return np.repeat(starts, lengths) + ragged_positions(lengths)
