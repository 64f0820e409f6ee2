"""Reshape and projection operators (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.reshape import (
    average_subperiods,
    for_display,
    in_order,
    normalise_codes,
    select_dimension_profile,
    wide_to_category_grid,
    wide_to_long,
    wide_to_panel,
)
from workloads.registry import query
from workloads.tables import BASE_SQL, GAPPY_SQL, GRID_SQL, NATION, PANEL_SQL, SEGMENTS, YEARS

CODES = {"NATION_3": "THREE", "NATION_7": "SEVEN"}
CODE_SQL = (
    "CASE entity WHEN 'NATION_3' THEN 'THREE' WHEN 'NATION_7' THEN 'SEVEN' ELSE entity END"
)


@query(
    "r1_wide_to_long",
    f"""WITH {GAPPY_SQL},
cells AS (
  SELECT entity, CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS period
  FROM (SELECT DISTINCT entity FROM gappy)
)
SELECT {CODE_SQL} AS entity, period, level FROM cells LEFT JOIN gappy USING (entity, period)""",
    "level",
    7,
)
def wide_to_long_panel(t):
    return wide_to_panel(t.wide("level", YEARS, t.gappy), NATION, "level", CODES)


NAMES = {s: s.title() for s in SEGMENTS if s != "HOUSEHOLD"}


@query(
    "r2_wide_category_grid",
    f"""WITH {BASE_SQL}, {GRID_SQL},
cells AS (
  SELECT entity, category, CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS period
  FROM (SELECT DISTINCT entity, category FROM grid)
)
SELECT entity, period, category, upper(category[1]) || lower(category[2:]) AS category_name,
       category_level
FROM cells LEFT JOIN grid USING (entity, category, period) WHERE category <> 'HOUSEHOLD'""",
    "category_level",
    7,
)
def wide_category_grid(t):
    wide = t.wide("category_level", YEARS, t.grid, "category").withColumnRenamed(
        "category", "segment"
    )
    return wide_to_category_grid(
        wide, NATION, "category_level", "segment", NAMES, "category_name"
    )


@query(
    "r3_subperiod_mean",
    """WITH half AS (
  SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
         CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half,
         sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100 / count(*)::DOUBLE AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL
),
cells AS (
  SELECT entity, CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS period
  FROM (SELECT DISTINCT entity FROM half)
)
SELECT entity, period, avg(v) AS level FROM cells LEFT JOIN half USING (entity, period)
GROUP BY ALL""",
    "level",
)
def subperiod_mean(t):
    halves = t.order_sums(
        label=F.concat(
            F.year("o_orderdate").cast("string"),
            F.when(F.month("o_orderdate") <= 6, "-S1").otherwise("-S2"),
        )
    )
    value = F.col("price_c").cast("double") / 100.0 / F.col("n")
    rows = halves.join(t.lookup, "nk").select("entity", "label", value.alias("v"))
    labels = [f"{y}-S{h}" for y in YEARS for h in (1, 2)]
    wide = rows.groupBy(F.col("entity").alias("GEO_code")).pivot("label", labels)
    long = wide_to_long(wide.agg(F.first("v")), NATION, "level")
    return average_subperiods(long, NATION, "level")


PROFILES = [
    {"o_orderstatus": {"F"}, "no_such_dimension": {"X"}},
    {"o_orderstatus": {"no such status"}},
    {"o_orderstatus": {"F", "P"}, "o_orderpriority": {"1-URGENT"}},
]


@query(
    "r4_dimension_profile",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
    "WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'",
)
def dimension_profile(t):
    rows = t.read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return select_dimension_profile(rows, PROFILES, "orders")


@query(
    "r5_code_normalisation",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'X' WHEN 'R' THEN 'Y' ELSE l_returnflag END
         AS l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY 1""",
)
def code_normalisation(t):
    rows = normalise_codes(t.read("lineitem"), "l_returnflag", {"A": "X", "R": "Y"})
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"))


@query("r6_fixed_column_order", "SELECT p_brand, p_partkey, p_size FROM part")
def fixed_column_order(t):
    return in_order(t.read("part"), ["p_brand", "absent_column", "p_partkey", "p_size"])


@query(
    "r7_display_names",
    f"""WITH {PANEL_SQL}
SELECT entity AS "Nation", period AS "Year", round(level, 7) + 0.0::DOUBLE AS "Mean price",
       CASE grp WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE grp END AS "Region"
FROM panel""",
    digits=7,
)
def display_names(t):
    rows = t.panel.select("entity", "grp", "period", "level")
    labels = {"entity": "Nation", "grp": "Region", "period": "Year", "level": "Mean price"}
    return for_display(rows, labels, "grp", {"ASIA": "Asia", "EUROPE": "Europe"})
