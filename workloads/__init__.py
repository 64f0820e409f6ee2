"""Queries over the driver's tables, one or more per operator, with DuckDB oracles."""

from workloads import (  # noqa: F401  (importing a module registers its queries)
    aggregates,
    inference,
    joins,
    ordering,
    reshaping,
    scans,
    slices,
    validation,
    windows,
)
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
