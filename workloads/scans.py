"""Sources and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators.combine import merge_measures
from panelloom.sources.catalogue import (
    SourceSpec,
    first_working,
    load_measure,
    load_with_fallback,
)
from panelloom.sources.sinks import write_report, write_view
from panelloom.sources.tables import (
    cached_table,
    filter_dimensions,
    read_contract,
    read_csv,
    read_csv_or_empty,
    read_parquet,
)
from workloads.registry import query
from workloads.tables import GAPPY_SQL, NATION, PANEL_SQL, YEARS


@query(
    "s1_parquet_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "o_totalprice",
)
def parquet_scan(t):
    return t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(
    "s1_filtered_scan",
    """SELECT l_returnflag, count(*) AS n_rows, min(l_extendedprice) AS least,
       max(l_discount) AS most FROM lineitem
WHERE l_extendedprice > 30000 AND l_discount <= 0.05 AND l_quantity IN (10, 20, 30)
GROUP BY l_returnflag""",
    "least most",
)
def filtered_scan(t):
    conditions = [
        ("l_extendedprice", ">", 30000.0), ("l_discount", "<=", 0.05), ("l_quantity", "in", [10, 20, 30]),
    ]
    return t.read("lineitem", conditions).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("l_extendedprice").alias("least"),
        F.max("l_discount").alias("most"),
    )


PART_COLUMNS = ["p_partkey", "p_brand", "p_type", "p_size"]


@query("s2_parquet_contract", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def parquet_contract(t):
    part = read_contract(t.spark, f"{t.sf_dir}/part.parquet", PART_COLUMNS)
    return part.select(*PART_COLUMNS)


@query(
    "s3_csv_scan",
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "c_acctbal",
)
def csv_scan(t):
    path = f"{t.scratch()}/customer_csv"
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    write_report(t.read("customer").select(*columns), path)
    schema = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"
    return read_csv(t.spark, path, schema)


@query(
    "s3_absent_report_is_empty",
    "SELECT entity, count(*) AS n_rows FROM (SELECT n_name AS entity FROM nation) "
    "GROUP BY entity",
)
def absent_report(t):
    schema = "entity string, year int, missing_columns string"
    report = read_csv_or_empty(t.spark, f"{t.scratch()}/no_such_report", schema)
    both = t.lookup.select("entity").unionByName(report.select("entity"))
    return both.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "s4_partitioned_parquet_sink",
    f"WITH {PANEL_SQL} SELECT entity, grp, nk, level, rate, period FROM panel",
    "level rate",
    7,
)
def partitioned_sink(t):
    path = f"{t.scratch()}/panel"
    rows = t.panel.select("entity", "grp", "nk", "period", "level", "rate")
    write_view(rows, path, ["period"])
    return read_parquet(t.spark, path)


@query(
    "s5_csv_report_sink",
    f"WITH {PANEL_SQL} SELECT entity, period, round(level, 2) AS level FROM panel",
    "level",
)
def csv_sink(t):
    path = f"{t.scratch()}/report"
    rows = t.panel.select("entity", "period", F.round("level", 2).alias("level"))
    write_report(rows, path, ["period", "entity"])
    return read_csv(t.spark, path, "entity string, period int, level double")


@query(
    "s6_source_filter",
    """SELECT l_shipyear, count(*) AS n_rows FROM (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipyear FROM lineitem
  WHERE l_returnflag IN ('A') AND l_linestatus IN ('O')) GROUP BY 1""",
)
def source_filter(t):
    rows = filter_dimensions(
        t.read("lineitem"), {"l_returnflag": ["A"], "l_linestatus": ["O"], "no_such": ["X"]}
    )
    year = F.year("l_shipdate").cast("int").alias("l_shipyear")
    return rows.groupBy(year).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "s7_materialise_once",
    "SELECT p_type, count(*) AS n_parts FROM part GROUP BY p_type",
)
def materialise_once(t):
    path = f"{t.scratch()}/bronze/parts"
    builds = []

    def build():
        builds.append(path)
        counted = t.read("part").groupBy("p_type")
        return counted.agg(F.count(F.lit(1)).alias("n_parts"))

    cached_table(t.spark, path, build)
    again = cached_table(t.spark, path, build)
    if len(builds) != 1:
        raise RuntimeError("the cached table was built more than once")
    return again


def raw_tables(t):
    """Wide raw tables as a source would deliver them."""
    tables = {
        "level": lambda: t.wide("level", YEARS, t.gappy),
        "rate": lambda: t.wide("rate", YEARS, t.gappy),
        "share_recent": lambda: t.wide("share", YEARS[3:], t.gappy),
        "share_old": lambda: t.wide("balance", YEARS, t.gappy),
        "by_segment": lambda: t.wide("category_level", YEARS, t.grid, "category"),
    }
    return lambda name: tables[name]()


@query(
    "s8_source_catalogue",
    f"WITH {GAPPY_SQL} SELECT entity, period, level, rate FROM gappy",
    "level rate",
    7,
)
def source_catalogue(t):
    read = raw_tables(t)
    specs = [SourceSpec("level", "level"), SourceSpec("rate", "rate")]
    merged = merge_measures([load_measure(read, s, NATION) for s in specs], NATION.key)
    # Every nation-year with orders is a cell of the wide table.
    return merged.join(t.panel.select("entity", "period"), ["entity", "period"], "left_semi")


@query(
    "s8_first_working_variant",
    """SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS period,
       sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100 / count(*)::DOUBLE
         AS category_level
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' AND (n_nationkey + year(o_orderdate)) % 11 <> 0
GROUP BY ALL""",
    "category_level",
    7,
)
def first_working_variant(t):
    """The first two variants fail (unknown dimension, duplicate keys)."""
    variants = [
        SourceSpec("by_segment", "category_level", profiles=({"statinfo": {"X"}},)),
        SourceSpec("by_segment", "category_level"),
        SourceSpec(
            "by_segment", "category_level", profiles=({"category": {"BUILDING"}},)
        ),
    ]
    loaded = first_working(raw_tables(t), variants, NATION)
    return loaded.where(F.col("category_level").isNotNull())


@query(
    "s8_value_level_fallback",
    f"""WITH {GAPPY_SQL}
SELECT entity, period,
       CASE WHEN period >= 1998 AND share IS NOT NULL THEN share ELSE balance END AS share,
       CASE WHEN period >= 1998 AND share IS NOT NULL THEN 'recent'
            WHEN balance IS NOT NULL THEN 'old' END AS origin
FROM gappy""",
    "share",
    7,
)
def value_level_fallback(t):
    variants = [
        SourceSpec("share_recent", "share", dataset="recent"),
        SourceSpec("no_table", "share"),
        SourceSpec("share_old", "share", dataset="old"),
    ]
    tables = raw_tables(t)

    def read(name):
        if name == "no_table":
            raise ValueError("source not available")
        return tables(name)

    merged = load_with_fallback(read, variants, NATION, "origin")
    return merged.join(t.panel.select("entity", "period"), ["entity", "period"], "left_semi")
