"""Column roles of a panel, shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Longest stretch of periods handed to one window task.  Periods are 32-bit
# integers and (entity, period) is unique, so both the rows of one segment and
# the segments of one entity are at most 2**16.
SEGMENT_SPAN = 1 << 16


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key columns, and the period range when it is known.

    With ``first_period`` and ``last_period`` declared and at most
    ``segment_span`` periods apart, an entity cannot own more rows than that and
    ordered operators use one window per entity.  Otherwise they split every
    entity into bounded segments (see ``panelloom.plans.segments``).
    """

    entity: str = "country_code"
    period: str = "year"
    group: str = "region"
    category: str = "food_category_code"
    first_period: int | None = None
    last_period: int | None = None
    segment_span: int = SEGMENT_SPAN

    @property
    def key(self) -> list[str]:
        return [self.entity, self.period]

    @property
    def is_short(self) -> bool:
        """True when the declared range proves that one entity is a small window."""
        if self.first_period is None or self.last_period is None:
            return False
        return self.last_period - self.first_period < self.segment_span
