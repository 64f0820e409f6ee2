"""Bounded gap filling with provenance flags, and exclusion of incomplete rows.

Filling is positional, as in the row order of one entity: a period without a row
is no gap.  ``complete_periods`` adds the missing rows where that is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.cells import flag
from panelloom.plans.segments import OrderedPanel
from panelloom.spec import PanelSpec

_OFFSET, _POS = "_offset", "_pos"


@dataclass(frozen=True)
class FillLimits:
    """How many cells of one gap each step may fill."""

    linear: int
    forward: int = 0
    backward: int = 0
    whole_gap_only: bool = False


STRICT = FillLimits(linear=2)
SOFT = FillLimits(linear=3, forward=3, backward=3)


def fill_gaps(
    df: DataFrame,
    spec: PanelSpec,
    strict: Sequence[str] = (),
    soft: Sequence[str] = (),
    strict_limits: FillLimits = STRICT,
    soft_limits: FillLimits = SOFT,
) -> DataFrame:
    """Fill short gaps of each column and add ``<column>_imputed`` flags.

    All columns share one ordered pass over (entity, period).
    """
    limits = {c: strict_limits for c in strict if c in df.columns}
    limits.update({c: soft_limits for c in soft if c in df.columns})
    if not limits:
        return df
    panel = OrderedPanel(df, spec)
    rows = panel.rows.withColumn(_POS, F.row_number().over(panel.window).cast("long"))
    rows = _with_neighbours(panel, rows, list(limits))
    filled = {c: _filled(c, limit) for c, limit in limits.items()}
    flags = {f"{c}_imputed": F.col(c).isNull() & v.isNotNull() for c, v in filled.items()}
    return rows.select(
        *[filled[c].alias(c) if c in filled else c for c in df.columns if c not in flags],
        *[col.alias(name) for name, col in flags.items()],
    )


def _with_neighbours(panel: OrderedPanel, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add for each column the nearest known cell before and after, with positions."""

    def known(c: str) -> Column:
        return F.expr(f"CASE WHEN `{c}` IS NOT NULL THEN struct({_POS} AS at, `{c}` AS value) END")

    def shifted(cell: str) -> Column:
        moved = f"struct({cell}.at + {_OFFSET} AS at, {cell}.value AS value)"
        return F.expr(f"CASE WHEN {cell} IS NOT NULL THEN {moved} END")

    summaries = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        summaries.append(F.min(known(c)).alias(f"_first_{c}"))
        summaries.append(F.max(known(c)).alias(f"_last_{c}"))

    def scan(earlier, later, _all):
        carried = {_OFFSET: F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
        for c in columns:
            last, first = shifted(f"`_last_{c}`"), shifted(f"`_first_{c}`")
            carried[f"_carry_prev_{c}"] = F.last(last, ignorenulls=True).over(earlier)
            carried[f"_carry_next_{c}"] = F.first(first, ignorenulls=True).over(later)
        return carried

    nothing = {_OFFSET: F.lit(0).cast("long")}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    for c in columns:
        cell = f"struct<at:bigint,value:{types[c]}>"
        nothing[f"_carry_prev_{c}"] = F.lit(None).cast(cell)
        nothing[f"_carry_next_{c}"] = F.lit(None).cast(cell)
    rows = panel.with_carries(rows, summaries, scan, nothing)
    near = {}
    for c in columns:
        near[f"_before_{c}"] = F.last(known(c), ignorenulls=True).over(panel.up_to_row)
        near[f"_after_{c}"] = F.first(known(c), ignorenulls=True).over(panel.from_row)
    joined = {_POS: F.expr(f"{_POS} + {_OFFSET}")}
    for c in columns:
        joined[f"_prev_{c}"] = F.coalesce(shifted(f"`_before_{c}`"), F.col(f"_carry_prev_{c}"))
        joined[f"_next_{c}"] = F.coalesce(shifted(f"`_after_{c}`"), F.col(f"_carry_next_{c}"))
    return rows.withColumns(near).withColumns(joined)


def _filled(c: str, limit: FillLimits) -> Column:
    """The chained steps linear, forward, backward as one expression."""
    prev, after = f"`_prev_{c}`", f"`_next_{c}`"
    since, until = f"({_POS} - {prev}.at)", f"({after}.at - {_POS})"
    width = f"({after}.at - {prev}.at)"
    inside = f"{prev} IS NOT NULL AND {after} IS NOT NULL"
    if limit.whole_gap_only:
        short = f"{width} - 1 <= {limit.linear}"
    else:
        short = "true"

    def on_line(k: str) -> str:
        slope = f"({after}.value - {prev}.value)"
        return f"{prev}.value + {slope} * {k} / nullif({width}, 0)"

    cases = [
        f"WHEN `{c}` IS NOT NULL THEN `{c}`",
        f"WHEN {inside} AND {short} AND {since} <= {limit.linear} THEN {on_line(since)}",
    ]
    if limit.forward:
        # Forward fill repeats the last cell that is known by then: the last
        # interpolated one inside a gap, the last observed one elsewhere.
        reach = limit.linear + limit.forward
        cases += [
            f"WHEN {inside} AND {short} AND {since} <= {reach} "
            f"THEN {on_line(f'{limit.linear}L')}",
            f"WHEN {inside} AND NOT ({short}) AND {since} <= {limit.forward} "
            f"THEN {prev}.value",
            f"WHEN {after} IS NULL AND {since} <= {limit.forward} THEN {prev}.value",
        ]
    if limit.backward:
        cases.append(f"WHEN {until} <= {limit.backward} THEN {after}.value")
    return F.expr(f"CASE {' '.join(cases)} END")


def complete_periods(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Add a NULL row for every period missing between an entity's first and last."""
    period, step = spec.period, spec.segment_span
    spans = df.groupBy(spec.entity).agg(F.min(period).alias("_from"), F.max(period).alias("_to"))
    # Two short sequences instead of one that may be as long as the period axis.
    blocks = spans.withColumn(
        "_block", F.expr(f"explode(sequence(floor(_from / {step}), floor(_to / {step})))")
    )
    inside = (
        f"explode(sequence(greatest(_from, _block * {step}), "
        f"least(_to, _block * {step} + {step - 1})))"
    )
    grid = blocks.select(spec.entity, F.expr(inside).alias(period))
    grid = grid.withColumn(period, F.col(period).cast(df.schema[period].dataType))
    return grid.join(df, spec.key, "left").select(*df.columns)


def exclude_incomplete(
    df: DataFrame, spec: PanelSpec, strict: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Split into rows with all strict columns known, and a table of the others
    with the names of the missing columns joined by ``;``."""
    present = [c for c in strict if c in df.columns]
    if not present:
        empty = df.select(*spec.key, F.lit("").alias("missing_columns")).where(F.lit(False))
        return df, empty
    complete = F.lit(True)
    for c in present:
        complete = complete & F.col(c).isNotNull()
    missing = F.concat_ws(";", *[F.when(F.col(c).isNull(), F.lit(c)) for c in present])
    excluded = df.where(~complete).select(*spec.key, missing.alias("missing_columns"))
    return df.where(complete), excluded


def mask_imputed(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Blank imputed cells so that inference sees observed values only."""
    flagged = [m for m in metrics if f"{m}_imputed" in df.columns]
    if not flagged:
        return df
    return df.withColumns({m: F.when(~flag(F.col(f"{m}_imputed")), F.col(m)) for m in flagged})


def imputed_counts(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows (metric, excluded): how many cells :func:`mask_imputed` blanks."""
    counts = {
        m: F.count_if(flag(F.col(f"{m}_imputed")))
        if f"{m}_imputed" in df.columns
        else F.lit(0).cast("long")
        for m in metrics
    }
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(m) for m, c in counts.items()])
    return one.unpivot([], list(metrics), "metric", "excluded")
