"""Declarative source catalogue: which raw table feeds which measure, and how."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.operators.combine import pick_by_priority
from panelloom.operators.quality import DuplicateKeys
from panelloom.operators.reshape import (
    average_subperiods,
    select_dimension_profile,
    wide_to_long,
    wide_to_panel,
)
from panelloom.sources.tables import filter_dimensions
from panelloom.spec import PanelSpec

Reader = Callable[[str], DataFrame]

ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SourceSpec:
    """One raw wide table and the way to a measure.

    ``dimensions`` are filters for the scan; ``profiles`` are the supported
    dimension layouts in order of preference.
    """

    table: str
    value: str
    dataset: str = ""
    dimensions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    profiles: Sequence[Mapping[str, set[str]]] = ()
    average: bool = False


def load_measure(
    read: Reader, source: SourceSpec, spec: PanelSpec, codes: Mapping[str, str] | None = None
) -> DataFrame:
    """Raw table to (entity, period, value)."""
    raw = filter_dimensions(read(source.table), source.dimensions)
    if source.profiles:
        raw = select_dimension_profile(raw, source.profiles, source.table)
    if source.average:
        return average_subperiods(
            wide_to_long(raw, spec, source.value, codes), spec, source.value
        )
    declared = set(source.dimensions).union(*source.profiles)
    return wide_to_panel(raw, spec, source.value, codes, declared)


def reason(error: AnalysisException | ValueError, source: SourceSpec) -> str:
    """Why a variant is passed over, also logged: its table is absent or has another shape.

    A table with dimensions that the variant does not select from is of another shape.  Any
    other failure, such as one of a job or a key that occurs twice with the same dimensions, is
    raised: another source must not stand in for one that was there.
    """
    if isinstance(error, DuplicateKeys):
        raise error
    if isinstance(error, AnalysisException) and error.getCondition() not in ABSENT:
        raise error
    text = f"{source.table}: {error}"
    log.warning("source passed over; %s", text)
    return text


def first_working(
    read: Reader,
    variants: Sequence[SourceSpec],
    spec: PanelSpec,
    codes: Mapping[str, str] | None = None,
) -> DataFrame:
    """The first variant that loads; if none does, raise with all reasons."""
    errors = []
    for source in variants:
        try:
            return load_measure(read, source, spec, codes)
        except (AnalysisException, ValueError) as error:
            errors.append(reason(error, source))
    raise ValueError("; ".join(errors))


def load_with_fallback(
    read: Reader,
    variants: Sequence[SourceSpec],
    spec: PanelSpec,
    source_column: str,
    codes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Value-level fallback over all variants that load, earlier ones preferred.

    ``source_column`` tells where each value came from.
    """
    parts, errors = [], []
    for priority, source in enumerate(variants):
        try:
            part = load_measure(read, source, spec, codes)
        except (AnalysisException, ValueError) as error:
            errors.append(reason(error, source))
            continue
        parts.append(
            part.withColumn(source_column, F.lit(source.dataset or source.table)).withColumn(
                "_priority", F.lit(priority)
            )
        )
    if not parts:
        raise ValueError(f"no usable variant; {'; '.join(errors)}")
    return pick_by_priority(parts, spec, variants[0].value, source_column, "_priority")
