"""Panels derived from the driver's tables, in Spark and in SQL.

Averages are computed from integer cents, so both engines (and every Spark run)
get bit-identical inputs whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import PanelSpec
from panelloom.operators.gaps import exclude_incomplete, fill_gaps
from panelloom.operators.growth import add_chained_index, add_gap, add_growth
from panelloom.sources.shared import shared_folder
from panelloom.sources.sinks import write_view
from panelloom.sources.tables import Condition, read_parquet

# Nation-year panel: the declared range keeps one entity below one window segment.
NATION = PanelSpec(
    entity="entity", period="period", group="grp", category="category",
    first_period=1990, last_period=2010,
)
# User-day series: nothing is declared, so ordered operators work on segments.
USER_DAY = PanelSpec(entity="entity", period="period", group="grp", segment_span=7)

YEARS = list(range(1995, 2002))
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def cents(col: Column) -> Column:
    return F.round(col * 100).cast("long")


class Tables:
    """The given tables of one scale factor, and frames derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str, conditions: Sequence[Condition] = ()) -> DataFrame:
        return read_parquet(self.spark, f"{self.sf_dir}/{name}.parquet", conditions)

    def scratch(self) -> str:
        return shared_folder(self.spark)

    @cached_property
    def lookup(self) -> DataFrame:
        """Nations with their region: entity, grp, nk."""
        nation, region = self.read("nation"), self.read("region")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
            F.col("n_name").alias("entity"),
            F.col("r_name").alias("grp"),
            F.col("n_nationkey").alias("nk"),
        )

    def order_sums(self, *extra: str, **columns: Column) -> DataFrame:
        """Orders summed per nation and ``columns``; collapsed per customer first so
        that a busy customer is reduced before the join."""
        orders = self.read("orders")
        keys = ["o_custkey", *columns]
        per_customer = (
            orders.withColumns(columns)
            .groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sum(cents(F.col("o_totalprice"))).alias("price_c"),
                F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
                F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
            )
        )
        customer = self.read("customer").select("c_custkey", "c_nationkey", "c_acctbal", *extra)
        joined = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy(F.col("c_nationkey").alias("nk"), *columns, *extra).agg(
            F.sum("n").alias("n"),
            F.sum("price_c").alias("price_c"),
            F.sum("urgent").alias("urgent"),
            F.sum("finished").alias("finished"),
            F.sum(cents(F.col("c_acctbal")) * F.col("n")).alias("balance_c"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Nation-year panel: level, balance, rate, share."""
        sums = self.order_sums(period=F.year("o_orderdate").cast("int"))
        n = F.col("n")
        return sums.join(self.lookup, "nk").select(
            "entity",
            "grp",
            "nk",
            "period",
            (F.col("price_c").cast("double") / 100.0 / n).alias("level"),
            (F.col("balance_c").cast("double") / 100.0 / n).alias("balance"),
            (F.col("urgent") * 100.0 / n).alias("rate"),
            (F.col("finished") * 100.0 / n).alias("share"),
        )

    def stored(self, df: DataFrame) -> DataFrame:
        """Write a derived frame once and read it back: statistics that take several
        passes then scan stored columns instead of repeating the joins."""
        path = f"{self.scratch()}/stored"
        write_view(df, path)
        return read_parquet(self.spark, path)

    @cached_property
    def stored_panel(self) -> DataFrame:
        return self.stored(self.panel)

    @cached_property
    def stored_analytic_panel(self) -> DataFrame:
        return self.stored(analytic_panel(self))

    @cached_property
    def gappy(self) -> DataFrame:
        """The panel with deterministic gaps."""
        nk, yr = F.col("nk"), F.col("period")
        return self.panel.withColumns(
            {
                "level": F.when((nk * 7 + yr * 3) % 5 != 0, F.col("level")),
                "rate": F.when((nk * 3 + yr) % 7 != 0, F.col("rate")),
                "balance": F.when(~((nk * 5 + yr * 2) % 7).isin(0, 2, 4), F.col("balance")),
                "share": F.when((nk + yr * 2) % 9 >= 5, F.col("share")),
            }
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Nation-year-segment grid with the mean order price and some NULLs."""
        sums = self.order_sums("c_mktsegment", period=F.year("o_orderdate").cast("int"))
        value = F.col("price_c").cast("double") / 100.0 / F.col("n")
        return sums.join(self.lookup, "nk").select(
            "entity",
            "nk",
            "period",
            F.col("c_mktsegment").alias("category"),
            F.when((F.col("nk") + F.col("period")) % 11 != 0, value).alias("category_level"),
        )

    @cached_property
    def user_days(self) -> DataFrame:
        """User-day series of mean click value; NULL on days without a click."""
        events = self.read("events")
        click = F.col("event_type") == "click"
        n = F.count_if(click)
        return events.groupBy(
            F.col("user_id").alias("entity"),
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period"),
        ).agg(
            (
                F.sum(F.when(click, cents(F.col("value")))).cast("double")
                / 100.0
                / F.when(n > 0, n)
            ).alias("clicks"),
            F.count(F.lit(1)).alias("n_events"),
        )

    @cached_property
    def holed_items(self) -> DataFrame:
        """Line items with deterministic NULLs in two columns."""
        items = self.read("lineitem")
        return items.withColumns(
            {
                "l_discount": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_discount")),
                "l_tax": F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax")),
            }
        )

    def wide(self, value: str, periods: list[int], source: DataFrame, *ids: str) -> DataFrame:
        """A wide statistical table: geo column, one text column per year, ``:`` for
        a missing cell."""
        text = F.coalesce(F.first(F.col(value).cast("string")), F.lit(":"))
        wide = source.groupBy(F.col("entity").alias("geo\\TIME_PERIOD"), *ids)
        return wide.pivot("period", periods).agg(text)


# SQL twins of the frames above.
BASE_SQL = """base AS (
  SELECT n_name AS entity, r_name AS grp, n_nationkey AS nk,
         CAST(year(o_orderdate) AS INTEGER) AS period, c_mktsegment AS category,
         count(*) AS n,
         sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS price_c,
         sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS balance_c,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""
PANEL_SQL = BASE_SQL + """,
panel AS (
  SELECT entity, grp, nk, period,
         CAST(sum(price_c) AS DOUBLE) / 100.0::DOUBLE / CAST(sum(n) AS DOUBLE) AS level,
         CAST(sum(balance_c) AS DOUBLE) / 100.0::DOUBLE / CAST(sum(n) AS DOUBLE) AS balance,
         CAST(sum(urgent) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(n) AS DOUBLE) AS rate,
         CAST(sum(finished) AS DOUBLE) * 100.0::DOUBLE / CAST(sum(n) AS DOUBLE) AS share
  FROM base GROUP BY ALL
)"""
GAPPY_SQL = PANEL_SQL + """,
gappy AS (
  SELECT entity, grp, nk, period,
         CASE WHEN (nk * 7 + period * 3) % 5 <> 0 THEN level END AS level,
         CASE WHEN (nk * 5 + period * 2) % 7 NOT IN (0, 2, 4) THEN balance END AS balance,
         CASE WHEN (nk * 3 + period) % 7 <> 0 THEN rate END AS rate,
         CASE WHEN (nk + period * 2) % 9 >= 5 THEN share END AS share
  FROM panel
)"""
GRID_SQL = """grid AS (
  SELECT entity, nk, period, category,
         CASE WHEN (nk + period) % 11 <> 0
              THEN CAST(price_c AS DOUBLE) / 100.0::DOUBLE / CAST(n AS DOUBLE)
         END AS category_level
  FROM base
)"""
USER_DAYS_SQL = """user_days AS (
  SELECT user_id AS entity,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
         CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN
           CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (WHERE event_type = 'click')
                AS DOUBLE)
           / 100.0::DOUBLE / CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE)
         END AS clicks,
         count(*) AS n_events
  FROM events GROUP BY 1, 2
)"""
HOLED_SQL = """holed AS (
  SELECT * REPLACE (
    CASE WHEN l_linenumber % 7 <> 0 THEN l_discount END AS l_discount,
    CASE WHEN l_linenumber % 5 <> 0 THEN l_tax END AS l_tax)
  FROM lineitem
)"""


def fill_sql(source: str, strict: tuple[str, ...], soft: tuple[str, ...], name: str) -> str:
    """CTEs that fill the gaps of ``source`` into ``name``, by neighbour positions."""
    cols = [*strict, *soft]
    up = "PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    down = "PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    near = []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN i END"
        near += [
            f"last_value({at} IGNORE NULLS) OVER ({up}) AS pi_{c}",
            f"last_value({c} IGNORE NULLS) OVER ({up}) AS pv_{c}",
            f"first_value({at} IGNORE NULLS) OVER ({down}) AS ni_{c}",
            f"first_value({c} IGNORE NULLS) OVER ({down}) AS nv_{c}",
        ]
    cells = []
    for c in cols:
        line = f"pv_{c} + (nv_{c} - pv_{c}) * {{k}} / CAST(ni_{c} - pi_{c} AS DOUBLE)"
        both = f"pi_{c} IS NOT NULL AND ni_{c} IS NOT NULL"
        first = 2 if c in strict else 3
        cases = [
            f"WHEN {c} IS NOT NULL THEN {c}",
            f"WHEN {both} AND i - pi_{c} <= {first} THEN " + line.format(k=f"(i - pi_{c})"),
        ]
        if c in soft:
            cases += [
                f"WHEN {both} AND i - pi_{c} <= 6 THEN " + line.format(k="3"),
                f"WHEN ni_{c} IS NULL AND i - pi_{c} <= 3 THEN pv_{c}",
                f"WHEN ni_{c} - i <= 3 THEN nv_{c}",
            ]
        cells.append(f"CASE {' '.join(cases)} END AS f_{c}")
    replaced = ", ".join(f"f_{c} AS {c}" for c in cols)
    dropped = ", ".join(
        ["i", *[f"{p}_{c}" for c in cols for p in ("pi", "pv", "ni", "nv", "f", "o")]]
    )
    flags = ", ".join(f"o_{c} IS NULL AND f_{c} IS NOT NULL AS {c}_imputed" for c in cols)
    originals = ", ".join(f"{c} AS o_{c}" for c in cols)
    return f"""{name}_1 AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS i FROM {source}
),
{name}_2 AS (SELECT *, {', '.join(near)} FROM {name}_1),
{name}_3 AS (SELECT *, {originals}, {', '.join(cells)} FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE ({dropped}) REPLACE ({replaced}), {flags}
  FROM {name}_3
)"""


FILLED_SQL = GAPPY_SQL + ",\n" + fill_sql(
    "gappy", ("level", "rate"), ("balance", "share"), "filled"
)
KEPT_SQL = FILLED_SQL + """,
kept AS (SELECT * FROM filled WHERE level IS NOT NULL AND rate IS NOT NULL),
excluded AS (SELECT * FROM filled WHERE level IS NULL OR rate IS NULL)"""
GROWN_SQL = KEPT_SQL + """,
grown_1 AS (
  SELECT *, lag(level) OVER w AS prev, lag(level_imputed) OVER w AS prev_imputed
  FROM kept WINDOW w AS (PARTITION BY entity ORDER BY period)
),
grown AS (
  SELECT * EXCLUDE (prev, prev_imputed),
         (level - prev) / prev * 100 AS growth,
         level_imputed OR coalesce(prev_imputed, false) AS growth_imputed
  FROM grown_1
),
gapped AS (
  SELECT *, rate - growth AS gap, rate_imputed OR growth_imputed AS gap_imputed FROM grown
),
chained AS (
  SELECT *, product(1 + rate / 100) OVER (
      PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
    ) AS chain
  FROM gapped
),
indexed AS (
  SELECT * EXCLUDE (chain),
         chain / max(CASE WHEN period = 1998 THEN chain END) OVER (PARTITION BY entity) * 100
           AS idx
  FROM chained
)"""


def analytic_panel(tables: Tables) -> DataFrame:
    """The flagship panel: fill, exclude, growth, gap, index (entity, grp, nk, period,
    measures and flags)."""
    filled = fill_gaps(tables.gappy, NATION, ["level", "rate"], ["balance", "share"])
    kept, _ = exclude_incomplete(filled, NATION, ["level", "rate"])
    grown = add_growth(kept, NATION, "level", "growth")
    gapped = add_gap(grown, "rate", "growth", "gap")
    return add_chained_index(gapped, NATION, "rate", "idx", 1998)
