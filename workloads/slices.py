"""Filters, slices and masks (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.combine import keep_listed
from panelloom.operators.gaps import imputed_counts, mask_imputed
from panelloom.operators.slicing import (
    Slice,
    default_groups,
    default_names,
    default_periods,
    default_slice,
    drop_missing,
    filter_panel,
    keep_finite,
    keep_positive,
    slice_views,
)
from workloads.registry import query
from workloads.tables import (
    GAPPY_SQL,
    GRID_SQL,
    GROWN_SQL,
    NATION,
    PANEL_SQL,
    USER_DAYS_SQL,
    analytic_panel,
)

CUT = Slice(
    periods=(1996, 2000),
    groups=["ASIA", "EUROPE", "AFRICA"],
    names=[f"NATION_{i}" for i in range(20)],
    reference_period=1999,
)
CUT_SQL = (
    "grp IN ('ASIA', 'EUROPE', 'AFRICA') AND entity IN ("
    + ", ".join(f"'NATION_{i}'" for i in range(20))
    + ")"
)


@query(
    "f1_open_slice_filter",
    f"""WITH {PANEL_SQL} SELECT entity, period, level FROM panel
WHERE period BETWEEN 1997 AND 1999 AND grp IN ('ASIA')""",
    "level",
    7,
)
def open_slice_filter(t):
    rows = filter_panel(t.panel, NATION, (1997, 1999), entities=[], groups=["ASIA"])
    return rows.select("entity", "period", "level")


@query(
    "f2_dashboard_slice",
    f"WITH {PANEL_SQL} SELECT entity, period, level FROM panel "
    f"WHERE period BETWEEN 1996 AND 2000 AND {CUT_SQL}",
    "level",
    7,
)
def dashboard_slice(t):
    views = slice_views(t.panel, NATION, CUT, "entity")
    return views.panel.select("entity", "period", "level")


@query(
    "f2_empty_list_selects_nothing",
    f"""WITH {PANEL_SQL}
SELECT count(*) AS all_rows, count(*) FILTER (WHERE false) AS selected FROM panel""",
)
def empty_list(t):
    nothing = Slice((1996, 2000), [], ["NATION_1"], 1999)
    chosen = slice_views(t.panel, NATION, nothing, "entity").panel
    selected = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = t.panel.agg(F.count(F.lit(1)).alias("all_rows"))
    return whole.withColumn("selected", selected)


@query(
    "f3_four_slices",
    f"""WITH {PANEL_SQL}, {GRID_SQL},
g AS (SELECT grid.*, grp FROM grid JOIN (SELECT DISTINCT entity, grp FROM panel) USING (entity))
SELECT 'panel' AS view, count(*) AS n_rows FROM panel
WHERE period BETWEEN 1996 AND 2000 AND {CUT_SQL}
UNION ALL SELECT 'categories', count(*) FROM g WHERE period BETWEEN 1996 AND 2000 AND {CUT_SQL}
UNION ALL SELECT 'scope', count(*) FROM panel WHERE {CUT_SQL}
UNION ALL SELECT 'reference', count(*) FROM panel WHERE period = 1999 AND {CUT_SQL}""",
)
def four_slices(t):
    grid = t.grid.join(t.lookup.select("entity", "grp"), "entity")
    views = slice_views(t.panel, NATION, CUT, "entity", grid)
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(view).alias("view"), "n_rows")
        for view, frame in (
            ("panel", views.panel),
            ("categories", views.categories),
            ("scope", views.scope),
            ("reference", views.reference),
        )
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "f3_reference_cross_section",
    f"WITH {GROWN_SQL} SELECT entity, level, rate, gap FROM indexed "
    f"WHERE period = 1999 AND {CUT_SQL}",
    "level rate gap",
    7,
)
def reference_cross_section(t):
    views = slice_views(analytic_panel(t), NATION, CUT, "entity")
    return views.reference.select("entity", "level", "rate", "gap")


@query(
    "f4_default_periods",
    """SELECT CAST(min(period) AS INTEGER) AS min_period, CAST(max(period) AS INTEGER) AS max_period,
       CAST(greatest(min(period), max(period) - 9) AS INTEGER) AS from_period,
       CAST(max(period) AS INTEGER) AS to_period, CAST(max(period) AS INTEGER) AS reference_period
FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS period FROM events)""",
)
def default_period_row(t):
    return default_periods(t.user_days, NATION)


@query(
    "f4_default_groups",
    "SELECT DISTINCT r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def default_group_list(t):
    return default_groups(t.panel, NATION)


@query(
    "f4_default_names",
    "SELECT n_name AS entity FROM nation JOIN region ON n_regionkey = r_regionkey "
    "WHERE r_name IN ('ASIA', 'AMERICA')",
)
def default_name_list(t):
    return default_names(t.panel, NATION, "entity", ["ASIA", "AMERICA"])


@query(
    "f4_default_slice",
    f"WITH {PANEL_SQL} SELECT entity, period, rate FROM panel",
    "rate",
    7,
)
def default_selection(t):
    cut = default_slice(t.panel, NATION, "entity")
    return slice_views(t.panel, NATION, cut, "entity").panel.select("entity", "period", "rate")


@query(
    "f5_whitelist",
    """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
)
def whitelist(t):
    nations = t.read("nation").where(F.col("n_regionkey") == 2)
    customer = keep_listed(
        t.read("customer").select("c_custkey", "c_nationkey"),
        nations.select(F.col("n_nationkey").alias("c_nationkey")),
        "c_nationkey",
    )
    orders = t.read("orders").select("o_orderkey", "o_custkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")


@query(
    "f6_drop_missing",
    f"WITH {GAPPY_SQL} SELECT entity, period, level, share FROM gappy "
    "WHERE level IS NOT NULL AND share IS NOT NULL",
    "level share",
    7,
)
def drop_missing_rows(t):
    rows = drop_missing(t.gappy, ["level", "share"])
    return rows.select("entity", "period", "level", "share")


@query(
    "f7_finite_filter",
    f"""WITH {USER_DAYS_SQL}
SELECT entity, period, n_events, 100.0::DOUBLE / (n_events - 1) AS inverse FROM user_days
WHERE n_events > 1 AND clicks IS NOT NULL""",
    "inverse",
    9,
)
def finite_filter(t):
    n = F.col("n_events") - 1
    infinite = F.lit(float("inf"))
    inverse = F.when(n == 0, infinite).otherwise(F.lit(100.0) / F.when(n != 0, n))
    rows = t.user_days.withColumn("inverse", inverse)
    return keep_finite(rows, ["inverse", "clicks"]).drop("clicks")


@query(
    "f8_positive_base",
    "SELECT c_custkey, c_acctbal, c_nationkey FROM customer "
    "WHERE c_acctbal > 0 AND c_nationkey > 0",
    "c_acctbal",
)
def positive_base(t):
    rows = keep_positive(t.read("customer"), ["c_acctbal", "c_nationkey"])
    return rows.select("c_custkey", "c_acctbal", "c_nationkey")


@query(
    "f9_mask_imputed",
    f"""WITH {GROWN_SQL}
SELECT entity, period, CASE WHEN NOT level_imputed THEN level END AS level,
       CASE WHEN NOT share_imputed THEN share END AS share, idx
FROM indexed""",
    "level share idx",
    7,
)
def mask_imputed_cells(t):
    masked = mask_imputed(analytic_panel(t), ["level", "share", "idx"])
    return masked.select("entity", "period", "level", "share", "idx")


@query(
    "f9_imputed_counts",
    f"""WITH {GROWN_SQL}
SELECT unnest(['level', 'share', 'idx']) AS metric,
       unnest([count(*) FILTER (WHERE level_imputed), count(*) FILTER (WHERE share_imputed), 0])
         AS excluded FROM indexed""",
)
def imputed_cell_counts(t):
    return imputed_counts(analytic_panel(t), ["level", "share", "idx"])
