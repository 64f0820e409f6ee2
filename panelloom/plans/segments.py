"""Ordered windows whose tasks stay bounded however long one entity is.

A plain ``Window.partitionBy(entity)`` puts an entity into one task.  Here the
period axis of each entity is cut into segments of ``segment_span`` periods.
Windows run inside (entity, segment); what a segment needs from its neighbours
(last known value, running product, row offset) travels in a small table with
one row per segment, scanned per entity and joined back on (entity, segment).
Rows and summaries are hash-partitioned alike, so the join moves neither: the wide
rows are shuffled once, and the key and measured columns once more for the summary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelloom.spec import PanelSpec

SEGMENT = "_segment"

Scan = Callable[[WindowSpec, WindowSpec, WindowSpec], Mapping[str, Column]]


class OrderedPanel:
    """A panel laid out for ordered windows."""

    def __init__(self, df: DataFrame, spec: PanelSpec):
        self.spec = spec
        if spec.is_short:
            self.keys = [spec.entity]
            self.rows = df
        else:
            self.keys = [spec.entity, SEGMENT]
            segment = F.floor(F.col(spec.period) / F.lit(spec.segment_span)).cast("int")
            self.rows = df.withColumn(SEGMENT, segment).repartition(*self.keys)
        self.window = Window.partitionBy(*self.keys).orderBy(spec.period)
        self.up_to_row = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.from_row = self.window.rowsBetween(0, Window.unboundedFollowing)

    def with_carries(
        self,
        df: DataFrame,
        summaries: Sequence[Column],
        scan: Scan,
        alone: Mapping[str, Column],
    ) -> DataFrame:
        """Add the columns a segment receives from the rest of its entity.

        ``summaries`` aggregate one segment; ``scan`` turns them into carried
        columns given the windows (segments before, segments after, all segments);
        ``alone`` holds the same columns for an entity that is one segment.
        """
        if self.spec.is_short:
            return df.withColumns(dict(alone))
        per_entity = Window.partitionBy(self.spec.entity)
        ordered = per_entity.orderBy(SEGMENT)
        carried = scan(
            ordered.rowsBetween(Window.unboundedPreceding, -1),
            ordered.rowsBetween(1, Window.unboundedFollowing),
            per_entity,
        )
        table = df.groupBy(*self.keys).agg(*summaries)
        # One at a time: a scan may refer to the columns named before it.
        for name, col in carried.items():
            table = table.withColumn(name, col)
        return df.join(table.select(*self.keys, *carried), self.keys, "left")

    def finish(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Drop the helper columns; joins may also have moved the key columns."""
        return df.select(*dict.fromkeys(columns))
