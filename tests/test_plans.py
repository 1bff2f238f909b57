"""Plans and a spread of registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
from checks import views
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = [
    "m01_clean_listings", "m07_clean_pois", "m12_clean_rents", "m25_fct_listing_poi", "m26_fct_area_sales",
    "m29_mart_area", "m33_mart_bedrooms", "m35_mart_st_vs_lt", "m37_mart_amenity_gap", "m42_listing_persona_scores",
    "s01_read_csv_text", "s05_latest_partition", "a20_profile", "w03_tiles", "v05_compare_segments",
    "t01_refresh_incremental", "t02_append_projection",
]


SPREAD += [n for n in entry.queries() if n[:1] in "sab" and n[1:3].isdigit() and n not in SPREAD]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    line = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line
    assert "TYPES" not in line, line


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["m02_clean_calendar", "m06_clean_sales", "w01_dedup_latest", "l03_top_k_per"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert plan.index("Partial") > plan.index("Exchange hashpartitioning") and "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["m07_clean_pois", "j08_point_in_area", "j09_within_distance", "m25_fct_listing_poi", "m30_mart_area_poi"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_amenities_need_no_shuffle(spark):
    assert "Exchange" not in plan_of(spark, "m10_listing_amenities")


def test_no_python_in_plans(spark):
    for name in ("m28_mart_listing", "m35_mart_st_vs_lt", "m42_listing_persona_scores", "m43_review_themes"):
        plan = plan_of(spark, name)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(spark, "m10_listing_amenities")
    schema = plan[plan.index("ReadSchema"):]
    assert "description" not in schema[: schema.index(">")]


def test_bedroom_figures_come_from_one_count(spark):
    plan = plan_of(spark, "m33_mart_bedrooms")
    assert plan.count("Exchange hashpartitioning") <= 11


def test_listings_are_cleaned_in_many_tasks(spark):
    raw = views.view(spark, SF, "raw_listings")
    parts = raw.rdd.getNumPartitions()
    assert parts >= 2 * spark.sparkContext.defaultParallelism > views.read(spark, SF, "part").rdd.getNumPartitions()
