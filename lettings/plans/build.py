"""The whole build over a folder of tables: each layer is written, then read.

Reading written tables gives the planner their true sizes, so it broadcasts a
side only below the configured size and otherwise shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lettings.operators import reports
from lettings.plans import marts, scores, silver, star
from lettings.sources import tables

Tables = Mapping[str, DataFrame]

# table -> (inputs, builder); a builder takes its inputs in this order
STEPS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "listings": (("raw_listings",), silver.clean_listings),
    "calendar": (("raw_calendar",), silver.clean_calendar),
    "reviews": (("raw_reviews",), silver.clean_reviews),
    "areas": (("raw_neighbourhoods",), silver.clean_areas),
    "area_shapes": (("raw_neighbourhoods_geo",), silver.clean_area_shapes),
    "sales": (("raw_price_paid",), silver.clean_sales),
    "pois": (("raw_poi", "area_shapes"), silver.clean_pois),
    "postcodes": (("raw_code_point",), silver.clean_postcodes),
    "property_map": (("listings",), silver.property_map),
    "listing_amenities": (("listings",), silver.listing_amenities),
    "postcode_area_map": (("postcodes", "area_shapes"), silver.postcode_area_map),
    "rents": (("raw_rent_cells",), silver.clean_rents),
    "area_rent_crosswalk": (("area_shapes", "rents"), silver.area_rent_crosswalk),
    "dim_listing": (("listings", "property_map"), star.dim_listing),
    "dim_property_group": (("property_map",), star.dim_property_group),
    "dim_host": (("listings",), star.dim_host),
    "dim_area": (("area_shapes",), star.dim_area),
    "dim_poi": (("pois",), star.dim_poi),
    "dim_date": (("calendar",), star.dim_date),
    "fct_calendar": (("calendar",), star.fct_calendar),
    "fct_listing": (("dim_listing",), star.fct_listing),
    "fct_listing_poi": (("dim_listing", "dim_poi"), star.fct_listing_poi),
    "fct_area_sales": (("sales", "postcode_area_map"), star.fct_area_sales),
    "fct_area_rent": (("rents", "area_rent_crosswalk"), star.fct_area_rent),
    "mart_listing": (("dim_listing", "dim_host", "fct_listing_poi", "fct_area_sales"), marts.mart_listing),
    "mart_area": (("mart_listing", "dim_area", "fct_area_sales", "dim_poi"), marts.mart_area),
    "mart_area_poi": (("dim_area", "dim_poi"), marts.mart_area_poi),
    "mart_area_seasonal": (("fct_calendar", "dim_listing", "dim_area"), marts.mart_area_seasonal),
    "mart_property_type": (("mart_listing", "dim_area", "fct_area_sales"), marts.mart_property_type),
    "mart_bedrooms": (("mart_listing", "dim_area"), marts.mart_bedrooms),
    "mart_property_seasonal": (("fct_calendar", "mart_listing", "dim_area"), marts.mart_property_seasonal),
    "mart_st_vs_lt": (
        ("mart_listing", "dim_area", "fct_area_sales", "fct_area_rent", "dim_city_assumptions"),
        marts.mart_st_vs_lt),
    "mart_amenities": (("listing_amenities", "dim_listing", "dim_area"), marts.mart_amenities),
    "mart_amenity_gap": (("fct_listing", "listing_amenities", "dim_area"), marts.mart_amenity_gap),
    "area_metrics": (("listings",), scores.area_metrics),
    "area_persona_scores": (("area_metrics", "area_shapes", "pois"), scores.area_persona_scores),
    "listing_yield": (("mart_listing",), scores.listing_yield),
    "listing_persona_scores": (("listings", "area_shapes", "pois", "listing_yield"), scores.listing_persona_scores),
    "review_themes": (("reviews", "listings"), scores.review_themes),
}


class Lazy(dict):
    """Tables by name; one that is missing is derived from its inputs.

    Inputs are taken from ``store`` where one is given: it writes a table once
    and reads it back, as the layers of a build do.  ``makers`` open raw tables
    on first use.
    """

    def __init__(
        self, raw: Tables, spark: SparkSession, makers: Mapping[str, Callable[[], DataFrame]] | None = None,
        store: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
    ):
        super().__init__(raw)
        self.spark = spark
        self.makers = dict(makers or {})
        self.store = store

    def __missing__(self, name: str) -> DataFrame:
        if name == "dim_city_assumptions":
            self[name] = star.dim_city_assumptions(self.spark)
        elif name in self.makers:
            self[name] = self.makers[name]()
        else:
            inputs, build = STEPS[name]
            self[name] = build(*[self.at(i) for i in inputs])
        return self[name]

    def at(self, name: str) -> DataFrame:
        """The table as a later layer reads it."""
        if self.store is None or name not in STEPS or name in self.makers:
            return self[name]
        return self.store(name, lambda: self[name])


# cleaned table -> (raw table, rows that one raw row gives)
AUDITED = {
    "listings": ("raw_listings", 1), "calendar": ("raw_calendar", 1), "reviews": ("raw_reviews", 1),
    "sales": ("raw_price_paid", 1), "postcodes": ("raw_code_point", 1), "pois": ("raw_poi", 1),
}
COMPUTED = ("area_metrics", "area_persona_scores", "listing_yield", "listing_persona_scores", "review_themes")


def build_all(
    spark: SparkSession, raw: Tables, folder: str, only: tuple[str, ...] | None = None, run_at: datetime | None = None,
) -> DataFrame:
    """Writes every table under ``folder`` and returns the row counts.

    Cleaned tables add a row each to ``folder``/clean_audit, with the time of the run, so
    the audits of all builds are kept.  Scores and themes carry ``computed_at``.
    """
    done = Lazy(raw, spark)
    names = [n for n in STEPS if only is None or n in only]
    for name in names:
        path = f"{folder}/{name}"
        table = done[name]
        if name in COMPUTED:
            table = reports.with_run_time(table.drop("computed_at"), run_at, "computed_at")
        tables.write_replace(table, path)
        done[name] = spark.read.parquet(path)
        if name in AUDITED and AUDITED[name][0] in raw:
            source, fan = AUDITED[name]
            audit = reports.clean_audit(name, source, raw[source], done[name], fan)
            tables.write_append(reports.with_run_time(audit, run_at), f"{folder}/clean_audit")
    return reports.verify_counts({n: done[n] for n in names})
