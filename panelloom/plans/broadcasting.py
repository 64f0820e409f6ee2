"""Broadcast of checked size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when a count shows that it has at most this many rows.
BROADCAST_ROWS = 100_000


def if_small(side: DataFrame, sized_by: DataFrame) -> DataFrame:
    """``side`` marked for broadcast when counting shows it is small.

    ``sized_by`` is a cheaper frame with at least as many rows, such as the distinct
    keys that ``side`` is grouped by.  A larger side keeps an ordinary shuffle
    join, which adaptive execution splits where it is skewed.
    """
    few = sized_by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(side) if few else side


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Approximate distinct values per column, from one pass with tiny sketches."""
    row = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    return row.asDict()
