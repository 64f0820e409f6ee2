"""Sources, reshaping, merging and validation on the expected scenarios."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelloom import PanelSpec
from panelloom.operators.combine import (
    attach_context,
    first_per_key,
    merge_measures,
    merge_measures_by_join,
    pick_by_priority,
)
from panelloom.operators.describe import period_pivot
from panelloom.operators.quality import (
    contract_report,
    profile_columns,
    reconcile_flags,
    require_contract,
)
from panelloom.operators.ranking import top_list
from panelloom.operators.reshape import (
    average_subperiods,
    entity_column,
    period_columns,
    select_dimension_profile,
    wide_to_long,
    wide_to_panel,
)
from panelloom.operators.slicing import default_slice, filter_panel, keep_finite
from panelloom.plans import food_panel
from panelloom.sources.catalogue import (
    SourceSpec, first_working, load_measure, load_with_fallback,
)
from panelloom.sources.sinks import write_report
from panelloom.sources.tables import (
    EXCLUSION_SCHEMA,
    cached_table,
    filter_dimensions,
    read_contract,
    read_csv,
    read_csv_or_empty,
    read_parquet,
)

SPEC = PanelSpec(first_period=2010, last_period=2024)
GEO = "geo\\TIME_PERIOD"


def part(spark, value, source, priority):
    return spark.createDataFrame(
        [("PL", 2020, value, source, priority)],
        "country_code string, year int, v double, src string, prio int",
    )


@pytest.mark.parametrize(
    "new,old,want",
    [(110.0, 95.0, (110.0, "new")), (None, 95.0, (95.0, "old")), (None, None, (None, None))],
)
def test_source_priority(spark, new, old, want):
    parts = [part(spark, new, "new", 0), part(spark, old, "old", 1)]
    row = pick_by_priority(parts, SPEC, "v", "src", "prio").first()
    assert (row["v"], row["src"]) == want


@pytest.mark.parametrize("dimension,selected,other",
                         [("indic_il", "MED_E", "MEAN_E"), ("statinfo", "MED_EI", "MEAN_EI")])
def test_income_supports_old_and_new_dimensions(spark, dimension, selected, other):
    raw = spark.createDataFrame(
        [("A", "TOTAL", "T", other, "EUR", "PL", 30000.0),
         ("A", "TOTAL", "T", selected, "EUR", "PL", 20000.0)],
        ["freq", "age", "sex", dimension, "unit", GEO, "2024"],
    )
    got = load_measure(lambda _: raw, food_panel.MEDIAN_INCOME, SPEC).collect()
    assert [tuple(r) for r in got] == [("PL", 2024, 20000.0)]


@pytest.mark.parametrize("household,risk", [("hhtyp", "incgrp"), ("hhcomp", "rskpovth")])
def test_deprivation_supports_old_and_new_dimensions(spark, household, risk):
    raw = spark.createDataFrame(
        [("A", "TOTAL", "TOTAL", "PC", "PL", 4.5), ("A", "TOTAL", "A_60", "PC", "PL", 8.0),
         ("A", "A1", "TOTAL", "PC", "PL", 6.0)],
        ["freq", household, risk, "unit", GEO, "2024"],
    )
    got = load_measure(lambda _: raw, food_panel.MEAL_DEPRIVATION, SPEC).collect()
    assert [tuple(r) for r in got] == [("PL", 2024, 4.5)]


def test_profile_errors_are_distinct(spark):
    raw = spark.createDataFrame([("A", "PL", 1.0)], ["unit", GEO, "2024"])
    with pytest.raises(ValueError, match="no rows match"):
        select_dimension_profile(raw, [{"unit": {"B"}}], "x")
    with pytest.raises(ValueError, match="unsupported dimensions"):
        select_dimension_profile(raw, [{"other": {"B"}}], "x")
    with pytest.raises(ValueError, match="no rows match.*|unsupported"):
        first_working(lambda _: raw, [food_panel.MEDIAN_INCOME], SPEC)


def test_failing_jobs_are_not_passed_over(spark):
    raw = spark.createDataFrame([("PL", 1.0)], [GEO, "2024"])
    broken = raw.withColumn(GEO, F.raise_error(F.lit("disk gone")).cast("string"))
    tables = {"first": broken, "second": raw}
    variants = [SourceSpec("first", "value"), SourceSpec("second", "value")]
    with pytest.raises(Exception, match="disk gone"):
        first_working(tables.__getitem__, variants, SPEC)
    with pytest.raises(Exception, match="disk gone"):
        load_with_fallback(tables.__getitem__, variants, SPEC, "origin")


def test_duplicate_keys_are_raised_and_not_passed_over(spark):
    tables = {
        "first": spark.createDataFrame([("PL", 1.0), ("PL", 2.0), ("BB", 3.0)], [GEO, "2024"]),
        "second": spark.createDataFrame([("PL", 5.0)], [GEO, "2024"]),
    }
    variants = [SourceSpec("first", "value"), SourceSpec("second", "value")]
    with pytest.raises(ValueError, match="not unique.*PL"):
        first_working(tables.__getitem__, variants, SPEC)
    with pytest.raises(ValueError, match="not unique.*PL"):
        load_with_fallback(tables.__getitem__, variants, SPEC, "origin")


def test_open_dimensions_are_passed_over_and_duplicates_within_them_are_not(spark, caplog):
    rows = [("A", "PL", 1.0), ("B", "PL", 2.0), (None, "PL", 3.0)]
    names = ["category", GEO, "2024"]
    raw = spark.createDataFrame(rows, names)
    variants = [
        SourceSpec("t", "value"), SourceSpec("t", "value", profiles=({"category": {"B"}},)),
    ]
    got = first_working(lambda _: raw, variants, SPEC).collect()
    assert [tuple(r) for r in got] == [("PL", 2024, 2.0)]
    assert "open dimensions: ['category']" in caplog.text
    got = load_with_fallback(lambda _: raw, variants, SPEC, "origin").collect()
    assert [r["value"] for r in got] == [2.0]

    # One row twice: wrong data, whatever its dimensions.
    twice = spark.createDataFrame([*rows, ("A", "PL", 1.0)], names)
    with pytest.raises(ValueError, match="not unique.*PL"):
        first_working(lambda _: twice, variants, SPEC)
    # A declared dimension with two values left is a fault of the variant's own selection.
    both = [SourceSpec("t", "value", dimensions={"category": ["A", "B"]}), variants[1]]
    with pytest.raises(ValueError, match="not unique.*PL"):
        first_working(lambda _: raw, both, SPEC)


def test_first_working_variant_query(spark, tmp_path):
    """The variant without a selected segment is passed over, the next one is read."""
    from workloads import QUERIES

    tables = {
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame(
            [(1, "N1", 0)], "n_nationkey int, n_name string, n_regionkey int"
        ),
        "customer": spark.createDataFrame(
            [(1, 1, 5.0, "BUILDING"), (2, 1, 7.0, "MACHINERY")],
            "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string",
        ),
        "orders": spark.sql(
            "SELECT * FROM VALUES (1L, 100D, DATE '1995-03-01'), (1L, 200D, DATE '1995-04-01'), "
            "(2L, 900D, DATE '1995-05-01') AS t(o_custkey, o_totalprice, o_orderdate)"
        ).selectExpr("*", "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["s8_first_working_variant"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("N1", 1995, 150.0)]


def test_absent_tables_are_passed_over(spark, tmp_path, caplog):
    raw = spark.createDataFrame([("PL", 1.0)], [GEO, "2024"])
    raw.write.parquet(str(tmp_path / "second"))

    def read(name):
        return spark.read.parquet(str(tmp_path / name))

    variants = [SourceSpec("first", "value"), SourceSpec("second", "value")]
    assert first_working(read, variants, SPEC).count() == 1
    assert "first" in caplog.text


def test_reshape_rejects_duplicate_keys(spark):
    raw = spark.createDataFrame([("A", "PL", 1.0), ("B", "PL", 2.0)], ["variant", GEO, "2024"])
    with pytest.raises(ValueError, match="not unique.*PL"):
        wide_to_panel(raw, SPEC, "value")


def test_reshape_codes_numbers_and_range(spark):
    raw = spark.createDataFrame(
        [("EL", "12.3 b", " 4.5 ", ":", "9"), ("PL", "NaN", "1e2", "7", "8")],
        ["GEO", "2009", "2010", "2011-S1", "note"],
    )
    assert period_columns(raw) == ["2009", "2010", "2011-S1"] and entity_column(raw) == "GEO"
    got = wide_to_long(raw, SPEC, "v", {"EL": "GR"}).orderBy("country_code", "year").collect()
    assert [tuple(r) for r in got] == [
        ("GR", 2010, 4.5), ("GR", 2011, None), ("PL", 2010, 100.0), ("PL", 2011, 7.0)]


def test_subperiods_average_and_keep_all_null(spark):
    raw = spark.createDataFrame([("PL", 1.0, 3.0, None, None), ("DE", 5.0, None, 1.0, 2.0)],
                                "geo string, `2020-S1` double, `2020-S2` double, "
                                "`2021-S1` double, `2021-S2` double")
    long = wide_to_long(raw, SPEC, "v")
    got = average_subperiods(long, SPEC, "v").orderBy("country_code", "year").collect()
    assert [tuple(r) for r in got] == [
        ("DE", 2020, 5.0), ("DE", 2021, 1.5), ("PL", 2020, 2.0), ("PL", 2021, None)]


def test_both_merges_agree(spark):
    schema = "country_code string, year int, {} double"
    a = spark.createDataFrame([("A", 2020, 1.0), ("A", 2021, None)], schema.format("a"))
    b = spark.createDataFrame([("A", 2021, 2.0), ("B", 2020, 3.0)], schema.format("b"))
    c = spark.createDataFrame([("C", 2020, 9.0)], schema.format("c"))
    one = merge_measures([a, b, c], SPEC.key).orderBy(*SPEC.key).collect()
    two = merge_measures_by_join([a, b, c], SPEC.key).orderBy(*SPEC.key).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and len(one) == 4


def test_key_filter_reaches_every_scan_of_the_merge(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([("A", 2020, 1.0)], f"country_code string, year int, {name} double"
                              ).write.parquet(str(tmp_path / name))
    parts = [spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")]
    plan = merge_measures(parts, SPEC.key).where("country_code = 'A'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("EqualTo(country_code,A)") == 2


def test_duplicate_context_is_rejected(spark):
    grid = spark.createDataFrame([("A", 2020)], "country_code string, year int")
    context = spark.createDataFrame([("A", 2020, 1), ("A", 2020, 2)],
                                    "country_code string, year int, x int")
    with pytest.raises(ValueError, match="not unique"):
        attach_context(grid, context, SPEC.key)


def test_contract_fails_in_order(spark):
    good = [("A", y, 1.0, 2.0, 3.0, 4.0) for y in (2010, 2011)]
    schema = "country_code string, year int, a double, b double, c double, d double"
    df = spark.createDataFrame(good, schema)
    require_contract(df, SPEC, SPEC.key, "t")
    assert all(r["passed"] for r in contract_report(df, SPEC, SPEC.key, "t").collect())
    for extra, check in (
        (("A", 2011, 1.0, 2.0, 3.0, 4.0), "duplicate_keys"),
        (("B", 2011, float("inf"), 2.0, 3.0, 4.0), "infinite_values"),
        (("B", 2031, 1.0, 2.0, 3.0, 4.0), "period_out_of_range"),
    ):
        broken = df.unionByName(spark.createDataFrame([extra], schema))
        with pytest.raises(ValueError, match=check):
            require_contract(broken, SPEC, SPEC.key, "t")
    with pytest.raises(ValueError, match="min_rows"):
        require_contract(df, SPEC, SPEC.key, "t", min_rows=3)
    with pytest.raises(ValueError, match="numeric_columns"):
        require_contract(df.drop("d"), SPEC, SPEC.key, "t")


def test_profile_counts(spark):
    df = spark.createDataFrame(
        [(1.0, True, "x"), (None, False, "x"), (-0.0, None, None), (0.0, True, "y")],
        "v double, v_imputed boolean, s string",
    )
    got = {r["column"]: r for r in profile_columns(df, "t", "s").collect()}
    v = got["v"]
    assert (v["missing_count"], v["missing_pct"], v["unique_count"], v["imputed_count"]) == (
        1, 25.0, 2, 2)
    assert got["v_imputed"]["imputed_count"] == 0 and got["s"]["unique_count"] == 2
    near = {r["column"]: tuple(r) for r in profile_columns(df, "t", "s", approximate=True).collect()}
    assert near == {name: tuple(r) for name, r in got.items()}
    flags = reconcile_flags(df, profile_columns(df, "t", "s")).collect()
    assert [(r["column"], r["agrees"]) for r in flags] == [("v", True)]


def test_scans_with_contracts(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, float("nan"))], "a int, b double").write.parquet(path)
    assert read_contract(spark, path, ["a", "b"]).first()["b"] is None
    with pytest.raises(ValueError, match="Missing columns: c, d"):
        read_contract(spark, path, ["a", "c", "d"])
    empty = read_csv_or_empty(spark, str(tmp_path / "absent.csv"), EXCLUSION_SCHEMA)
    assert empty.count() == 0 and empty.columns == ["country_code", "year", "missing_columns"]


def test_source_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("A", "x", 1.0)], "unit string, c string, v double").write.parquet(path)
    df = filter_dimensions(read_parquet(spark, path), {"unit": ["A", "B"], "none": ["x"]})
    plan = df.select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(unit, [A,B])]" in plan and "c:string" not in plan


def test_cache_builds_once_and_rejects_empty(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert cached_table(spark, path, build).count() == 3
    assert cached_table(spark, path, build).count() == 3 and len(calls) == 1
    with pytest.raises(ValueError, match="empty"):
        cached_table(spark, str(tmp_path / "none"), lambda: spark.range(0))
    assert cached_table(spark, str(tmp_path / "none"), lambda: spark.range(2)).count() == 2


NAN, INF = float("nan"), float("inf")
STORED = [(1, 5.0, 1.0), (2, NAN, 2.0), (3, None, 3.0), (4, INF, NAN), (5, -1.0, None), (6, 7.0, 6.0)]


@pytest.mark.parametrize(
    ("conditions", "ids"),
    [
        ([("x", ">", 4.0)], [1, 4, 6]),
        ([("x", ">=", -INF)], [1, 4, 5, 6]),
        ([("x", "<", 6.0)], [1, 5]),
        ([("x", "=", NAN)], []),
        ([("x", "in", [7.0, NAN, 5.0])], [1, 6]),
        ([("x", ">", 0.0), ("y", ">", 0.0)], [1, 6]),
        ([("x", "=", None)], []),
        ([], [1, 2, 3, 4, 5, 6]),
    ],
)
def test_conditions_see_cleaned_values(spark, tmp_path, conditions, ids):
    path = str(tmp_path / "stored")
    spark.createDataFrame(STORED, "id int, x double, y double").write.parquet(path)
    got = read_parquet(spark, path, conditions)
    assert sorted(r.id for r in got.collect()) == ids
    assert got.where("isnan(x) OR isnan(y)").count() == 0


def test_conditions_on_doubles_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.createDataFrame(STORED, "id int, x double, y double").write.parquet(path)
    got = read_parquet(spark, path, [("x", ">", 4.0), ("y", "<=", 6.0)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,4.0)" in plan and "LessThanOrEqual(y,6.0)" in plan
    with pytest.raises(ValueError, match="unknown comparison"):
        read_parquet(spark, path, [("x", "~", 4.0)])


def test_report_is_globally_ordered(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(50).repartition(7), path, ["id"])
    rows = [int(x) for f in sorted((tmp_path / "report").glob("part-*.csv"))
            for x in f.read_text().splitlines() if x != "id"]
    assert rows == list(range(50))
    assert read_csv(spark, path, "id bigint").count() == 50


def test_slices_and_lists(spark):
    df = spark.createDataFrame(
        [("A", "Alpha", "g", 2001, 1.0), ("B", "Beta", "h", 2012, None), ("C", "Ceta", None, 2012, 5.0)],
        "country_code string, country_name string, region string, year int, v double",
    )
    assert filter_panel(df, SPEC, None, [], []).count() == 3
    assert filter_panel(df, SPEC, (2002, 2012), None, ["h"]).count() == 1
    cut = default_slice(df, SPEC, "country_name")
    assert (cut.periods, cut.groups, cut.names) == ((2003, 2012), ["g", "h"], ["Alpha", "Beta"])
    assert cut.reference_period == 2012
    assert keep_finite(df, ["v"]).count() == 2
    assert top_list(df, "v", "country_name").first()[0] == "Ceta (+5.0), Alpha (+1.0)"
    assert top_list(df.limit(0), "v", "country_name").first()[0] is None
    wide = period_pivot(df, SPEC, "country_name", "v", [2001, 2012]).collect()
    assert [tuple(r) for r in wide] == [("Ceta", None, 5.0, 5.0), ("Alpha", 1.0, None, 1.0)]
    firsts = first_per_key(df, ["year"], ["country_code"]).select("country_code").collect()
    assert sorted(r[0] for r in firsts) == ["A", "B"]
    assert df.where(F.col("v") > 0).count() == 2
