"""Composite tables: silver, star, marts and scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks import views
from checks.registry import query, scratch, table
from checks import sql
from lettings import rules
from lettings.functions import spatial as geo
from lettings.operators import reports
from lettings.plans import bronze, build, scores, silver, star

LISTING = [
    "listing_id", "host_id", "name", "property_type", "room_type", "neighbourhood", "price", "bedrooms",
    "accommodates", "host_response_rate_pct", "host_acceptance_rate_pct", "host_is_superhost",
    "instant_bookable", "estimated_occupancy_l365d", "estimated_revenue_l365d", "review_scores_rating",
    "number_of_reviews", "latitude", "longitude", "last_scraped",
]
table("m01_clean_listings", "listings", LISTING, "q_listings")
table("m02_clean_calendar", "calendar", ["listing_id", "calendar_date", "available", "minimum_nights", "maximum_nights"], "q_calendar")
table("m03_clean_reviews", "reviews", ["review_id", "listing_id", "reviewer_id", "review_date", "reviewer_name", "comments"], "q_reviews")
table("m04_clean_areas", "areas", ["neighbourhood", "neighbourhood_group"], "q_areas")
table("m06_clean_sales", "sales", [
    "transaction_uid", "price", "date_of_transfer", "postcode", "county", "property_type_code", "property_type",
    "property_class", "build_status", "tenure", "ppd_category", "record_status", "quality_flag"], "q_sales")
table("m07_clean_pois", "pois", ["poi_id", "name", "category", "amenity_group", "confidence", "latitude", "longitude",
                                 "neighbourhood", "neighbourhood_group"], "q_pois")
table("m08_clean_postcodes", "postcodes", ["postcode_key", "postcode", "latitude", "longitude", "positional_quality_indicator"], "q_postcodes")
table("m09_property_map", "property_map", ["property_type", "property_group", "property_class"], "q_property_map")
table("m10_listing_amenities", "listing_amenities", ["listing_id", "raw_amenity", "base_type", "amenity_group"], "q_amenities")
table("m11_postcode_area_map", "postcode_area_map", ["postcode_key", "neighbourhood", "city"], "q_postcode_map")
table("m12_clean_rents", "rents", [
    "period", "area_code", "area_name", "region_name", "geo_level", "category", "category_type", "property_class",
    "rent_index", "monthly_change", "annual_change", "rental_price"], "q_rents")
table("m13_area_rent_crosswalk", "area_rent_crosswalk", ["neighbourhood", "city", "ons_area_name", "ons_area_code", "rent_grain"], "q_crosswalk")

FIRST, LAST = "1996-01-01", "2001-06-30"
BOOKED = sql.CTE["q_booked"] = f"""
select * from (select cast(listing_id as bigint) as listing_id, cast(date as date) as date,
  case when lower(is_booked) in {sql.in_values(rules.TRUE_WORDS)} then true when lower(is_booked) in {sql.in_values(rules.FALSE_WORDS)} then false end as is_booked,
  cast(minimum_nights as bigint) as minimum_nights, cast(maximum_nights as bigint) as maximum_nights, _file_row_number from q_raw_calendar) t
where is_booked is not null qualify row_number() over (partition by listing_id, date order by _file_row_number) = 1"""
sql.CTE["q_booked_ok"] = f"""
select * from q_booked where listing_id > 0 and date between date '{FIRST}' and date '{LAST}' and minimum_nights > 0 and maximum_nights > 0
 and minimum_nights <= maximum_nights and minimum_nights <= 365"""


@query("m14_calendar_summary", f"""
select listing_id, total_calendar_days, days_booked, occupancy_rate, calendar_start_date, calendar_end_date, avg_minimum_nights, avg_maximum_nights,
 strftime(calendar_start_date, '%d/%m/%Y') || ' - ' || strftime(calendar_end_date, '%d/%m/%Y') as date_range,
 case occupancy_rate when 1 then 'FULLY_BOOKED_CHECK' when 0 then 'ZERO_BOOKINGS' else 'OK' end as occupancy_quality_flag
from (select listing_id, count(*) as total_calendar_days, count(*) filter (where is_booked) as days_booked, min(date) as calendar_start_date,
  max(date) as calendar_end_date, avg(minimum_nights) as avg_minimum_nights, avg(maximum_nights) as avg_maximum_nights,
  {sql.rd(sql.div('count(*) filter (where is_booked)', 'count(*)'), 4)} as occupancy_rate from q_booked_ok group by listing_id) g""")
def _(w):
    return silver.calendar_summary(w["raw_calendar"], FIRST, LAST)


sql.CTE["q_reviews_ok"] = """
select review_id as id, listing_id, reviewer_id, review_date as date, comments from q_reviews where review_id > 0 and listing_id > 0 and reviewer_id > 0
 and review_date between date '2008-01-01' and date '2021-06-30' and (comments is null or length(comments) >= 5)"""


@query("m15_review_summary", """
select listing_id, count(*) as total_reviews, count(distinct reviewer_id) as unique_reviewers, min(date) as first_review_date, max(date) as last_review_date,
 nullif(count(comments), 0) as comment_count, strftime(min(date), '%d/%m/%Y') || ' - ' || strftime(max(date), '%d/%m/%Y') as date_range,
 case when count(comments) = 0 then 'NO_COMMENTS' else 'OK' end as comment_coverage_flag from q_reviews_ok group by listing_id""")
def _(w):
    return silver.review_summary(w["raw_reviews"], last="2021-06-30")


@query("m15_review_comments", """
select listing_id, id as review_id, comments, count(*) over (partition by listing_id) as n_values from q_reviews_ok where comments is not null""")
def _(w):
    return silver.review_comments(w["raw_reviews"], last="2021-06-30").withColumnRenamed("id", "review_id")


DIM = ["listing_id", "host_id", "property_type", "structure_class", "property_group", "price", "bedrooms", "neighbourhood",
       "latitude", "longitude"]
table("m16_dim_listing", "dim_listing", DIM, "q_dim_listing")


@query("m17_dim_property_group", "select property_group, " + sql.case_map("property_group", {k: "@" + str(v) for k, v in rules.PROPERTY_GROUP_ORDER.items()}).replace("'@", "").replace("' when", " when").replace("' else null", " else 99") + "::bigint as display_order, "
       + sql.case_map("property_group", rules.PROPERTY_GROUP_TEXT) + " as description from (select distinct property_group from q_property_map) g")
def _(w):
    return w["dim_property_group"]


table("m18_dim_host", "dim_host", ["host_id", "host_name", "host_is_superhost", "host_response_rate_pct", "host_acceptance_rate_pct"], "q_dim_host")
table("m19_dim_area", "dim_area", ["neighbourhood", "city", "area_sqkm"], "q_sizes", {"area_sqkm": 6})
table("m20_dim_poi", "dim_poi", ["name", "category", "amenity_group", "confidence", "longitude", "latitude", "is_transport", "is_dining"], "q_dim_poi")


@query("m21_dim_city_assumptions", """
select a.city, a.cap_nights, a.assumed_lt_gross_yield_pct, a.realistic_occ_nights, a.st_cost_pct, a.lt_cost_pct, count(*) as listings
from q_assumptions a join q_areas r using (city) join q_listings l using (neighbourhood) group by all""".replace(
    "a.cap_nights", "cast(a.cap_nights as bigint) as cap_nights").replace(
    "a.realistic_occ_nights", "cast(a.realistic_occ_nights as bigint) as realistic_occ_nights").replace(
    "a.st_cost_pct", "cast(a.st_cost_pct as bigint) as st_cost_pct").replace(
    "a.lt_cost_pct", "cast(a.lt_cost_pct as bigint) as lt_cost_pct"))
def _(w):
    assumptions = star.dim_city_assumptions(w.spark)
    placed = w["listings"].join(w["dim_area"].select("neighbourhood", "city"), "neighbourhood")
    counts = placed.groupBy("city").agg(F.count(F.lit(1)).alias("listings"))
    return counts.join(assumptions, "city")


@query("m22_dim_date", """
select d as date_key, year(d) as year, quarter(d) as quarter, month(d) as month, strftime(d, '%b') as month_name, day(d) as day_of_month,
 dayofweek(d) as day_of_week, strftime(d, '%a') as day_name, dayofweek(d) in (0, 6) as is_weekend, weekofyear(d) as week_of_year
from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from (
 select min(calendar_date) - interval 30 day as lo, max(calendar_date) + interval 30 day as hi from q_calendar) s) g""")
def _(w):
    return w["dim_date"]


table("m23_fct_calendar", "fct_calendar", ["listing_id", "calendar_date", "available", "minimum_nights", "maximum_nights"], "q_calendar")
table("m24_fct_listing", "fct_listing", [
    "listing_id", "host_id", "neighbourhood", "room_type", "structure_class", "property_group", "adr", "occupancy_nights",
    "is_active", "occupancy_rate", "annual_revenue", "revpar", "review_scores_rating", "number_of_reviews"], "q_dim_listing")
table("m25_fct_listing_poi", "fct_listing_poi", ["listing_id", "poi_count_500m", "transport_count_500m", "dining_count_500m"], "q_listing_poi")
table("m26_fct_area_sales", "fct_area_sales", ["neighbourhood", "city", "structure_class", "median_sale_price", "avg_sale_price", "sale_txn_count"], "q_area_sales")
table("m27_fct_area_rent", "fct_area_rent", ["neighbourhood", "city", "rent_category", "category_type", "monthly_rent", "annual_rent", "rent_period", "rent_grain"], "q_area_rent")
table("m28_mart_listing", "mart_listing", [
    "listing_id", "host_id", "neighbourhood", "room_type", "property_type", "structure_class", "property_group", "bedrooms", "adr",
    "occupancy_nights", "occupancy_rate", "is_active", "annual_revenue", "revpar", "has_revenue_data", "area_median_sale_price",
    "review_scores_rating", "number_of_reviews", "host_is_superhost", "poi_count_500m", "transport_count_500m", "dining_count_500m"],
    "q_mart_listing", rename={"host_is_superhost": "owner_is_superhost"})
OPER = ["listing_count", "avg_adr", "median_adr", "avg_occupancy_rate", "avg_annual_revenue", "median_annual_revenue", "avg_rating"]
table("m29_mart_area", "mart_area", ["neighbourhood", "city", *OPER, "avg_bedrooms", "median_sale_price", "poi_count", "transport_count",
                                     "dining_count", "poi_density_sqkm", "area_sqkm"], "q_mart_area", {"area_sqkm": 6})
table("m30_mart_area_poi", "mart_area_poi", ["neighbourhood", "city", "poi_name", "category", "amenity_group", "is_transport", "is_dining",
                                             "latitude", "longitude"], "q_area_poi", rename={"neighbourhood": "in_area", "poi_name": "name"})
SEASON = ["month", "listing_count", "total_nights", "booked_nights", "occupancy_rate"]
table("m31_mart_area_seasonal", "mart_area_seasonal", ["neighbourhood", "city", *SEASON], "q_area_seasonal")
table("m32_mart_property_type", "mart_property_type", ["neighbourhood", "city", "structure_class", *OPER, "avg_bedrooms", "median_sale_price",
                                                       "sale_txn_count", "sufficient_sample"], "q_property_type")
CELL = ["neighbourhood", "city", "structure_class", "bedroom_bucket", "bedroom_sort"]
table("m33_mart_bedrooms", "mart_bedrooms", [*CELL, *OPER, "city_listing_count", "city_median_adr", "city_avg_occupancy_rate",
                                             "city_median_annual_revenue", "sufficient_sample", "robust_sample"], "q_bedrooms")
table("m34_mart_property_seasonal", "mart_property_seasonal", [*CELL, *SEASON, "sufficient_sample"], "q_property_seasonal")
STLT = [*CELL, "listing_count", "occupancy_cap_nights", "median_sale_price", "st_annual_income", "st_gross_yield_pct",
        "assumed_lt_gross_yield_pct", "lt_annual_income", "lt_gross_yield_pct", "lt_rent_source", "st_vs_lt_income_uplift",
        "st_vs_lt_yield_uplift_ppt", "st_to_lt_income_ratio", "st_wins", "sufficient_sample"]
table("m35_mart_st_vs_lt", "mart_st_vs_lt", STLT, "q_st_vs_lt")
table("m36_mart_amenities", "mart_amenities", ["neighbourhood", "city", "amenity_group", "listings_with_group", "area_listings",
                                               "pct_listings_with_group"], "q_mart_amenities")
table("m37_mart_amenity_gap", "mart_amenity_gap", ["neighbourhood", "city", "amenity_group", "top_n", "rest_n", "pct_top", "pct_rest", "gap",
                                                   "area_active_listings", "sufficient_sample"], "q_amenity_gap")
METRICS = ["city", "neighbourhood_cleansed", "listing_count", "total_reviews", "avg_price", "min_price", "max_price", "avg_occupancy",
           "avg_revenue", "total_revenue", "avg_review_rating", "avg_cleanliness_score", "room_type_variety", "property_type_variety",
           "count_entire_home_apt", "count_private_room", "count_shared_room", "count_hotel_room", "avg_host_response_rate",
           "avg_host_acceptance_rate", "pct_superhost"]
table("m38_area_metrics", "area_metrics", METRICS, "q_metrics")
table("m39_location_score", "area_persona_scores", ["city", "neighbourhood_cleansed", "listing_density", "poi_transport", "poi_attractions",
                                                    "poi_dining", "poi_score", "location_score"], "q_area_location",
      {"listing_density": 6, "poi_score": 6, "location_score": 6}, rename={"poi_score": sql.POI_SCORE})
AREA_SCORE = list(rules.AREA_SCORE_WEIGHTS)
table("m40_area_persona_scores", "area_persona_scores", ["city", "neighbourhood_cleansed", *AREA_SCORE], "q_area_scores")
table("m41_listing_yield", "listing_yield", ["listing_id", "gross_yield"], "q_yield", {"gross_yield": 8})
NORMS = ["norm_price", "norm_occupancy", "norm_revenue", "norm_rating", "norm_review_vol", "norm_location", "norm_yield"]
table("m42_listing_persona_scores", "listing_persona_scores", [
    "listing_id", "city", "neighbourhood_cleansed", "property_type", "room_type", "bedrooms", "price", "estimated_occupancy",
    "estimated_revenue", "number_of_reviews", "review_scores_rating", "listing_density", "poi_transport", "poi_attractions", "poi_dining",
    "location_score", "gross_yield", *NORMS, *AREA_SCORE, "score_confidence"], "q_listing_scores",
    {"listing_density": 6, "location_score": 6, "gross_yield": 6, **{n: 6 for n in NORMS}})
THEMES = list(rules.THEME_KEYWORDS)
THEME_COLS = ["city", "neighbourhood_cleansed", "total_reviews", *[f"mentions_{t}_count" for t in THEMES], *[f"pct_mentions_{t}" for t in THEMES], "top_theme"]
table("m43_review_themes", "", THEME_COLS, "q_themes", fn=lambda w: scores.review_themes(w["reviews"], w["listings"], views.TEST_WORDS))


# Literal expectation, on purpose not read from the library's rules.
WORDED = {
    0: ("a cheap and CLEAN place", "price cleanliness"), 1: ("near the tube station", "location"), 2: ("the lockbox was easy", "checkin"),
    3: ("overpriced, dusty, a long walk; no arrival help", "price cleanliness location checkin"), 4: ("nothing of note", ""),
    5: ("filthy mess", "cleanliness"), 6: ("affordable", "price"),
}
_WORDED = " ".join(f"when {k} then '{v[1]}'" for k, v in WORDED.items())


@query("m43_default_themes", f"""
select city, neighbourhood_cleansed, count(*) as total_reviews, {', '.join(f"count(*) filter (where contains(found, '{t}')) as mentions_{t}_count" for t in ("price", "cleanliness", "location", "checkin"))},
 {sql.re_('cast(sum(mood) as double) / count(mood)', 4)} as avg_sentiment_score
from (select {sql.city_of('l._filename')} as city, l.neighbourhood as neighbourhood_cleansed, case r.review_id % 7 {_WORDED} end as found, (r.listing_id % 10) / 10e0 as mood
 from q_reviews r join q_listings l using (listing_id) where trim(r.comments) <> '') g group by all""")
def _(w):
    text = F.lit(None).cast("string")
    for k, (words, _) in WORDED.items():
        text = F.when(F.col("review_id") % 7 == k, F.lit(words)).otherwise(text)
    reviews = w["reviews"].where(F.trim("comments") != "").withColumn("comments", text)
    sentiment = reviews.select("listing_id", (F.col("listing_id") % 10 / 10.0).alias("avg_sentiment_score"))
    themes = scores.review_themes(reviews, w["listings"], sentiment=sentiment)
    return themes.select("city", "neighbourhood_cleansed", "total_reviews", *[f"mentions_{t}_count" for t in THEMES], "avg_sentiment_score")


@query("m05_clean_area_shapes", """
select neighbourhood, neighbourhood_group, area_sqkm, n_edges, lat, lon from (
 select z.neighbourhood, a.neighbourhood_group, cast(round(cast(z.area_sqkm as decimal(28,8)), 6) as double) as area_sqkm, 8 as n_edges,
  cast(round(cast(a.y + 1e-2 as decimal(28,8)), 6) as double) as lat, cast(round(cast(a.x + 15e-3 as decimal(28,8)), 6) as double) as lon
 from q_sizes z join q_areas a using (area_key)) s""".replace("8 as n_edges", "cast(8 as bigint) as n_edges"))
def _(w):
    shapes = silver.clean_area_shapes(geojson_documents(w))
    centre = geo.centroid("boundary")
    return shapes.select(
        "neighbourhood", "neighbourhood_group", F.round("area_sqkm", 6).alias("area_sqkm"),
        F.size(geo.edges("boundary")).alias("n_edges"), F.round(centre["y"], 6).alias("lat"), F.round(centre["x"], 6).alias("lon"))


def geojson_documents(w):
    """One FeatureCollection text per file of areas; a file is one city."""
    areas = views.boundary(w["raw_areas"])
    feature = F.struct(
        F.struct("neighbourhood", "neighbourhood_group").alias("properties"), geo.boundary_json("boundary").alias("geometry"))
    docs = areas.groupBy("_filename").agg(F.sort_array(F.collect_list(F.struct("area_key", feature.alias("f")))).alias("fs"))
    return docs.select(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda f: f["f"]).alias("features"))).alias("raw"),
        "_filename")


# --- landing and audits ------------------------------------------------------
LANDED = ["id", "name", "price", "property_type"]


def _snapshots(w) -> str:
    """Listings of three cities as CSV in an older (half the rows) and a newer snapshot folder."""
    folder = scratch(w)
    rows = w["raw_listings"].select(*LANDED, (F.col("id").cast("bigint") % 3).alias("city"))
    for day, part in (("2025-01-15", rows.where("cast(id as bigint) % 2 = 0")), ("2025-06-15", rows)):
        part.withColumn("snapshot_date", F.lit(day)).repartition("city").write.mode("append").partitionBy(
            "city", "snapshot_date").csv(folder, header=True, escape='"')
    return folder


MARKED = "case when trim({0}) not in ('', 'NULL', 'null', 'N/A') then trim({0}) end"


@query("b01_bronze_load", "select " + ", ".join(f"{MARKED.format(c)} as {c}" for c in LANDED)
       + ", concat('city=', cast(cast(id as bigint) % 3 as varchar)) as city, true as numbered from q_raw_listings")
def _(w):
    landed = bronze.land(w.spark, _snapshots(w), "(city=[0-9]+)/", "raw_listings", scratch(w))
    return landed.select(*LANDED, F.regexp_extract("_filename", "(city=[0-9]+)/", 1).alias("city"), (F.col("_file_row_number") > 0).alias("numbered"))


@query("s15_load_audits_kept", "select 'raw_listings' as table_name, 'LOADED' as status, cast(2 as bigint) as runs, 2 * count(*) as rows_loaded, cast(0 as bigint) as errors from q_raw_listings")
def _(w):
    folder, store = _snapshots(w), scratch(w)
    for day in (1, 2):
        bronze.land(w.spark, folder, "(city=[0-9]+)/", "raw_listings", store, run_at=datetime(2025, 7, day))
    audits = bronze.load_audits(w.spark, store, ["raw_listings"])
    return audits.groupBy("table_name", "status").agg(
        F.countDistinct("run_at").alias("runs"), F.sum("rows_loaded").alias("rows_loaded"), F.sum("errors_seen").alias("errors"))


@query("s16_clean_audits_kept", "select name as table_name, cast(2 as bigint) as runs, 2 * a as rows_in, 2 * b as rows_out from ("
       "select 'calendar' as name, (select count(*) from q_raw_calendar) as a, (select count(*) from q_calendar) as b union all "
       "select 'postcodes', (select count(*) from q_raw_code_point), (select count(*) from q_postcodes)) c")
def _(w):
    store = scratch(w)
    raw = {n: w[n] for n in ("raw_calendar", "raw_code_point")}
    for day in (1, 2):
        build.build_all(w.spark, raw, store, only=("calendar", "postcodes"), run_at=datetime(2025, 7, day))
    audits = w.spark.read.parquet(f"{store}/clean_audit")
    return audits.groupBy("table_name").agg(
        F.countDistinct("run_at").alias("runs"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"))
