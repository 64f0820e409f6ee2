"""The food-affordability panel: seven measures and a category grid to two views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.operators.combine import (
    attach_context,
    attach_lookup,
    keep_listed,
    label_interpolated,
    merge_measures,
    stack,
)
from panelloom.operators.gaps import exclude_incomplete, fill_gaps
from panelloom.operators.growth import (
    add_category_gap,
    add_chained_index,
    add_gap,
    add_growth,
)
from panelloom.operators.quality import profile_columns, require_contract
from panelloom.operators.reshape import for_display, in_order, wide_to_category_grid
from panelloom.sources.catalogue import SourceSpec, load_measure, load_with_fallback
from panelloom.sources.sinks import write_report, write_view
from panelloom.sources.tables import LOOKUP_SCHEMA, filter_dimensions, read_csv, read_parquet
from panelloom.spec import PanelSpec

# Period range, base period, code normalisation and categories.
SPEC = PanelSpec(first_period=2010, last_period=2024)
BASE_PERIOD = 2020
CODES = {"EL": "GR", "UK": "GB"}
CATEGORY_NAMES = {
    "CP0111": "Pieczywo i produkty zbożowe",
    "CP0112": "Mięso",
    "CP0113": "Ryby i owoce morza",
    "CP0114": "Mleko, sery i jaja",
    "CP0115": "Oleje i tłuszcze",
    "CP0116": "Owoce",
    "CP0117": "Warzywa",
    "CP0118": "Cukier, dżem, miód, czekolada i wyroby cukiernicze",
    "CP0119": "Pozostałe produkty żywnościowe",
    "CP012": "Napoje bezalkoholowe",
}

# Raw tables, their dimension filters and the measures they feed.
FOOD_INFLATION = SourceSpec(
    table="eurostat_food_inflation",
    dataset="prc_hicp_aind",
    value="food_inflation_pct",
    dimensions={"coicop": ["CP01"], "unit": ["RCH_A_AVG"]},
)
HEADLINE_INFLATION = SourceSpec(
    table="eurostat_headline_inflation",
    dataset="prc_hicp_aind",
    value="headline_inflation_pct",
    dimensions={"coicop": ["CP00"], "unit": ["RCH_A_AVG"]},
)
MEDIAN_INCOME = SourceSpec(
    table="eurostat_median_income",
    dataset="ilc_di03",
    value="median_income_eur",
    profiles=(
        {"age": {"TOTAL"}, "sex": {"T"}, "statinfo": {"MED_EI"}, "unit": {"EUR"}},
        {"age": {"TOTAL"}, "sex": {"T"}, "indic_il": {"MED_E"}, "unit": {"EUR"}},
    ),
)
MINIMUM_WAGE = SourceSpec(
    table="eurostat_minimum_wage",
    dataset="earn_mw_cur",
    value="minimum_wage_eur_month",
    dimensions={"currency": ["EUR"]},
    average=True,
)
PRICE_LEVEL = (
    SourceSpec(
        table="eurostat_food_price_level_coicop18",
        dataset="prc_ppp_ind_1",
        value="food_price_level_index",
        dimensions={"indic_ppp": ["PLI_EU27_2020"], "ppp_cat18": ["A0101"]},
    ),
    SourceSpec(
        table="eurostat_food_price_level",
        dataset="prc_ppp_ind",
        value="food_price_level_index",
        dimensions={"na_item": ["PLI_EU27_2020"], "ppp_cat": ["A0101"]},
    ),
)
FOOD_SHARE = SourceSpec(
    table="eurostat_food_share",
    dataset="nama_10_co3_p3",
    value="food_share_budget_pct",
    dimensions={"coicop": ["CP01"], "unit": ["PC_TOT"]},
)
MEAL_DEPRIVATION = SourceSpec(
    table="eurostat_meal_deprivation",
    dataset="ilc_mdes03",
    value="meal_deprivation_pct",
    profiles=(
        {"hhcomp": {"TOTAL"}, "rskpovth": {"TOTAL"}, "unit": {"PC"}},
        {"hhtyp": {"TOTAL"}, "incgrp": {"TOTAL"}, "unit": {"PC"}},
    ),
)
CATEGORY_TABLE = "eurostat_food_categories"
CATEGORY_DIMENSIONS = {"coicop": list(CATEGORY_NAMES), "unit": ["RCH_A_AVG"]}

STRICT = ["food_inflation_pct", "headline_inflation_pct", "median_income_eur"]
SOFT = [
    "minimum_wage_eur_month",
    "food_price_level_index",
    "food_share_budget_pct",
    "meal_deprivation_pct",
]
IDENTITY = ["country_code", "country_name", "iso3", "region", "year"]


def _flagged(*measures: str) -> list[str]:
    return [c for m in measures for c in (m, f"{m}_imputed")]


# Column order of the two views.
COUNTRY_YEAR_COLUMNS = [
    *IDENTITY,
    *_flagged(*STRICT, "income_growth_pct", "minimum_wage_eur_month", "food_price_level_index"),
    "food_price_level_source",
    *_flagged("food_share_budget_pct", "meal_deprivation_pct", "food_affordability_gap_pct"),
    "food_inflation_index_2020",
]
CONTEXT_COLUMNS = [
    *IDENTITY,
    *_flagged(
        "headline_inflation_pct",
        "median_income_eur",
        "income_growth_pct",
        "food_price_level_index",
    ),
    "food_price_level_source",
    *_flagged("food_share_budget_pct", "meal_deprivation_pct"),
]
REQUIRED_COLUMNS = [c for c in COUNTRY_YEAR_COLUMNS if c != "food_price_level_source"]

# Measures of the country export.
KEY_METRICS = [
    "food_inflation_pct",
    "headline_inflation_pct",
    "median_income_eur",
    "income_growth_pct",
    "food_share_budget_pct",
    "food_price_level_index",
    "meal_deprivation_pct",
    "food_affordability_gap_pct",
]
CATEGORY_EXPORT_COLUMNS = [
    "country_name",
    "country_code",
    "region",
    "year",
    "food_category_code",
    "food_category_name",
    "category_food_inflation_pct",
    "category_affordability_gap_pct",
    "category_affordability_gap_pct_imputed",
    "income_growth_pct",
    "income_growth_pct_imputed",
    "headline_inflation_pct_imputed",
    "median_income_eur_imputed",
    "food_price_level_index_imputed",
    "food_share_budget_pct_imputed",
    "meal_deprivation_pct_imputed",
]
MIN_CATEGORY_ROWS = 1000

# Display labels of exported columns and of groups.
GROUP_LABELS = {
    "Northern": "Europa Północna",
    "Western": "Europa Zachodnia",
    "Southern": "Europa Południowa",
    "Eastern": "Europa Wschodnia",
}
COLUMN_LABELS = {
    "country_name": "Kraj",
    "country_code": "Kod kraju",
    "iso3": "ISO-3",
    "region": "Region",
    "year": "Rok",
    "food_category_code": "Kod kategorii",
    "food_category_name": "Kategoria żywności",
    "iqr_distance": "Odległość poza granicą IQR",
    "iqr_lower": "Dolna granica IQR",
    "iqr_upper": "Górna granica IQR",
    "food_inflation_pct": "Inflacja żywności (HICP CP01)",
    "headline_inflation_pct": "Inflacja ogólna (HICP CP00)",
    "food_share_budget_pct": "Udział żywności w wydatkach gospodarstw",
    "median_income_eur": "Mediana dochodu ekwiwalentnego",
    "income_growth_pct": "Wzrost mediany dochodu",
    "minimum_wage_eur_month": "Płaca minimalna",
    "food_price_level_index": "Poziom cen żywności (UE=100)",
    "meal_deprivation_pct": "Brak możliwości pełnowartościowego posiłku",
    "food_affordability_gap_pct": "Luka dostępności żywności",
    "food_inflation_index_2020": "Skumulowany indeks cen żywności (2020=100)",
    "food_price_growth_2020_2024_pct": "Skumulowany wzrost cen żywności 2020-2024",
    "income_growth_2020_2024_pct": "Skumulowany wzrost dochodu 2020-2024",
    "cumulative_affordability_gap_pct": "Skumulowana luka dostępności 2020-2024",
    "category_food_inflation_pct": "Inflacja kategorii żywności",
    "category_affordability_gap_pct": "Luka dostępności kategorii",
}

Reader = Callable[[str], DataFrame]


@dataclass(frozen=True)
class FoodPanel:
    country_year: DataFrame
    category_view: DataFrame
    exclusions: DataFrame
    quality: DataFrame
    raw_grid: DataFrame


def bronze_reader(spark: SparkSession, bronze: str) -> Reader:
    """Raw wide tables stored as ``<bronze>/<table>.parquet``."""
    return lambda table: read_parquet(spark, f"{bronze}/{table}.parquet")


def load_measures(read: Reader, spec: PanelSpec = SPEC) -> list[DataFrame]:
    def one(source: SourceSpec) -> DataFrame:
        return load_measure(read, source, spec, CODES)

    return [
        one(FOOD_INFLATION),
        one(HEADLINE_INFLATION),
        one(MEDIAN_INCOME),
        one(MINIMUM_WAGE),
        load_with_fallback(read, PRICE_LEVEL, spec, "food_price_level_source", CODES),
        one(FOOD_SHARE),
        one(MEAL_DEPRIVATION),
    ]


def load_grid(read: Reader, spec: PanelSpec = SPEC) -> DataFrame:
    raw = filter_dimensions(read(CATEGORY_TABLE), CATEGORY_DIMENSIONS)
    return wide_to_category_grid(
        raw,
        spec,
        "category_food_inflation_pct",
        "coicop",
        CATEGORY_NAMES,
        "food_category_name",
        CODES,
    )


def build_food_panel(read: Reader, lookup: DataFrame, spec: PanelSpec = SPEC) -> FoodPanel:
    """All tables of the panel as lazy frames."""
    grid = keep_listed(load_grid(read, spec), lookup, spec.entity)
    measures = [keep_listed(m, lookup, spec.entity) for m in load_measures(read, spec)]
    merged = merge_measures(measures, spec.key)
    filled = fill_gaps(merged, spec, STRICT, SOFT)
    panel, exclusions = exclude_incomplete(filled, spec, STRICT)
    panel = label_interpolated(panel, "food_price_level_index", "food_price_level_source")
    panel = add_growth(panel, spec, "median_income_eur", "income_growth_pct")
    panel = add_gap(
        panel, "food_inflation_pct", "income_growth_pct", "food_affordability_gap_pct"
    )
    panel = add_chained_index(
        panel, spec, "food_inflation_pct", "food_inflation_index_2020", BASE_PERIOD
    )
    country_year = in_order(attach_lookup(panel, lookup, spec.entity), COUNTRY_YEAR_COLUMNS)
    observed = grid.where(F.col("category_food_inflation_pct").isNotNull())
    # The context is an aggregate on its key, so many-to-one holds by construction.
    category = attach_context(
        observed, country_year.select(*CONTEXT_COLUMNS), spec.key, validate=False
    )
    category = add_category_gap(
        category,
        "category_food_inflation_pct",
        "income_growth_pct",
        "category_affordability_gap_pct",
    )
    quality = stack(
        [
            profile_columns(merged, "country_year", "before_missing_policy"),
            profile_columns(country_year, "country_year", "after_etl"),
            profile_columns(grid, "country_year_category", "raw_grid_before_etl"),
            profile_columns(category, "country_year_category", "after_etl"),
        ]
    )
    return FoodPanel(country_year, category, exclusions, quality, grid)


def publish_food_panel(
    spark: SparkSession,
    bronze: str,
    lookup_path: str,
    out: str,
    spec: PanelSpec = SPEC,
    min_category_rows: int = MIN_CATEGORY_ROWS,
) -> FoodPanel:
    """Build, validate and write the two views and the two reports.

    The views are written first and checked as written, so the checks and the
    category join read stored columns instead of repeating the plan.
    """
    lookup = read_csv(spark, lookup_path, LOOKUP_SCHEMA)
    panel = build_food_panel(bronze_reader(spark, bronze), lookup, spec)
    staged = f"{out}/_staged"
    write_view(panel.country_year, f"{staged}/country_year")
    write_view(panel.category_view, f"{staged}/country_year_category")
    country_year = read_parquet(spark, f"{staged}/country_year")
    category = read_parquet(spark, f"{staged}/country_year_category")
    require_contract(country_year, spec, spec.key, "country_year")
    require_contract(
        category,
        spec,
        [*spec.key, spec.category],
        "country_year_category",
        min_rows=min_category_rows,
    )
    write_view(country_year.orderBy(*spec.key), f"{out}/country_year")
    write_view(
        category.orderBy(*spec.key, spec.category), f"{out}/country_year_category"
    )
    write_report(panel.quality, f"{out}/data_quality")
    write_report(panel.exclusions, f"{out}/exclusions", spec.key)
    return panel


def country_export(view: DataFrame) -> DataFrame:
    """Country rows as exported: eight measures and all provenance flags."""
    flags = [c for c in view.columns if c.endswith("_imputed")]
    rows = view.select("country_name", "country_code", "region", "year", *KEY_METRICS, *flags)
    return rows.orderBy("year", "country_name")


def category_export(view: DataFrame) -> DataFrame:
    rows = view.select(*CATEGORY_EXPORT_COLUMNS)
    return rows.orderBy("year", "food_category_code", "country_name")


def with_display_names(export: DataFrame) -> DataFrame:
    return for_display(export, COLUMN_LABELS, "region", GROUP_LABELS)
