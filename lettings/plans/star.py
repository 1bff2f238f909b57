"""Dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettings import rules
from lettings.functions import classify, clean, measures, spatial as geo
from lettings.operators import joins, quantiles, spatial, windows


def dim_listing(listings: DataFrame, property_map: DataFrame) -> DataFrame:
    """Listings with point, dwelling class and property group."""
    types = property_map.select(
        clean.name_key("property_type").alias("__type"),
        F.col("property_class").alias("structure_class"), "property_group",
    )
    both = listings.join(types, clean.name_key("property_type") == F.col("__type"), "left")
    return both.select(
        "listing_id", "host_id", "name", "room_type", "property_type", "structure_class",
        "property_group", "accommodates", "bedrooms", "beds", "bathrooms", "price",
        "neighbourhood", F.col("neighbourhood_group_cleansed").alias("neighbourhood_group"),
        "latitude", "longitude", geo.make_point("longitude", "latitude").alias("geo_point"),
        "review_scores_rating", "number_of_reviews", "reviews_per_month", "instant_bookable",
        "has_availability", "estimated_occupancy_l365d", "estimated_revenue_l365d",
        "listing_url", "picture_url",
    )


def dim_property_group(property_map: DataFrame) -> DataFrame:
    """Distinct groups with display order and description."""
    groups = property_map.select("property_group").distinct()
    order = text = F
    for label, place in rules.PROPERTY_GROUP_ORDER.items():
        order = order.when(F.col("property_group") == label, F.lit(place))
        text = text.when(F.col("property_group") == label, F.lit(rules.PROPERTY_GROUP_TEXT[label]))
    return groups.select(
        "property_group", order.otherwise(F.lit(rules.PROPERTY_GROUP_LAST)).alias("display_order"),
        text.alias("description"),
    )


def dim_host(listings: DataFrame) -> DataFrame:
    """One row per host, from its newest scrape; the listing id decides ties."""
    cols = [
        "host_id", "host_name", "host_since", "host_is_superhost", "host_identity_verified",
        "host_response_rate_pct", "host_acceptance_rate_pct", "host_response_time",
        "host_listings_count", "host_total_listings_count", "host_location", "host_url",
    ]
    rows = listings.select(*cols, "last_scraped", "listing_id")
    order = [F.col("last_scraped").desc_nulls_last(), F.col("listing_id").asc()]
    return windows.dedup_latest(rows, ["host_id"], order).select(*cols)


def dim_area(area_shapes: DataFrame) -> DataFrame:
    return area_shapes.select(
        "neighbourhood", clean.path_city("_filename").alias("city"), "boundary", "area_sqkm"
    )


def dim_poi(pois: DataFrame) -> DataFrame:
    """Reasonably certain points with transport and dining marks."""
    kept = pois.where(F.col("confidence") >= rules.POI_MIN_CONFIDENCE)
    return kept.select(
        "name", "category", "amenity_group", "confidence", "longitude", "latitude",
        classify.is_transport("category").alias("is_transport"),
        classify.is_dining("amenity_group").alias("is_dining"),
    )


def dim_city_assumptions(spark: SparkSession) -> DataFrame:
    return joins.values_frame(spark, rules.CITY_ASSUMPTIONS, rules.CITY_ASSUMPTION_COLUMNS)


def date_spine(days: DataFrame, col: str, margin: int = rules.DATE_SPINE_MARGIN_DAYS) -> DataFrame:
    """Every day from ``margin`` before the first to ``margin`` after the last day."""
    span = days.agg(
        F.date_sub(F.min(col), margin).alias("first"), F.date_add(F.max(col), margin).alias("last")
    )
    return span.select(F.explode(F.sequence("first", "last")).alias("date_key"))


def dim_date(calendar: DataFrame) -> DataFrame:
    d = F.col("date_key")
    sunday_based = F.dayofweek(d) - 1
    return date_spine(calendar, "calendar_date").select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMM").alias("month_name"), F.day(d).alias("day_of_month"),
        sunday_based.alias("day_of_week"), F.date_format(d, "E").alias("day_name"),
        sunday_based.isin(0, 6).alias("is_weekend"), F.weekofyear(d).alias("week_of_year"),
    )


def fct_calendar(calendar: DataFrame) -> DataFrame:
    """Lean projection; stateless, so it can also be appended from a stream."""
    return calendar.select(
        "listing_id", "calendar_date", "available", "minimum_nights", "maximum_nights"
    )


def fct_listing(dim_listing: DataFrame) -> DataFrame:
    """Investment measures per listing."""
    return dim_listing.select(
        "listing_id", "host_id", "neighbourhood", "neighbourhood_group", "room_type",
        "structure_class", "property_group", "geo_point", *listing_measures(),
        "review_scores_rating", "number_of_reviews",
    )


def listing_measures() -> list:
    nights, revenue = "estimated_occupancy_l365d", "estimated_revenue_l365d"
    return [
        F.col("price").alias("adr"), F.col(nights).alias("occupancy_nights"),
        measures.is_active(nights).alias("is_active"),
        measures.occupancy_rate(nights).alias("occupancy_rate"),
        F.col(revenue).alias("annual_revenue"), measures.revpar(revenue).alias("revpar"),
    ]


def poi_counters(suffix: str = "") -> dict:
    """Counts of points, transport stops and dining places."""
    return {
        f"poi_count{suffix}": F.count("name"),
        f"transport_count{suffix}": F.count_if(F.col("is_transport")),
        f"dining_count{suffix}": F.count_if(F.col("is_dining")),
    }


def fct_listing_poi(dim_listing: DataFrame, dim_poi: DataFrame, metres: float = rules.NEARBY_METRES) -> DataFrame:
    """Points near each listing, zeros kept."""
    return spatial.nearby_counts(dim_listing, "listing_id", dim_poi, poi_counters("_500m"), metres)


def placed_sales(sales: DataFrame, postcode_map: DataFrame) -> DataFrame:
    """Usable sales with the area of their postcode and their dwelling class."""
    ok = sales.where((F.col("quality_flag") == "ok") & F.col("postcode").isNotNull())
    keyed = ok.select(
        "transaction_uid", clean.postcode_key("postcode").alias("postcode_key"), "price", "property_class",
        "property_type_code",
    )
    other = F.when(F.col("property_type_code") == "O", F.lit("Other"))
    return keyed.join(postcode_map, "postcode_key").select(
        "transaction_uid", "neighbourhood", "city", "price", "property_type_code",
        F.coalesce("property_class", other).alias("structure_class"),
    )


def fct_area_sales(sales: DataFrame, postcode_map: DataFrame) -> DataFrame:
    """Median and mean sale price per area and class, with an ``All`` level over
    the residential codes.

    Prices are counted once per area, class and code; both levels and their
    medians come from those counts.
    """
    return area_sales_from_placed(placed_sales(sales, postcode_map))


def area_sales_from_placed(placed: DataFrame) -> DataFrame:
    """The same from sales that already carry their area."""
    area = ["neighbourhood", "city", "structure_class"]
    priced = placed.groupBy(*area, "property_type_code", "price").agg(F.count(F.lit(1)).alias("__n"))
    residential = F.col("property_type_code").isin(*rules.RESIDENTIAL_CODES)
    levels = F.array(F.col("structure_class"), F.when(residential, F.lit("All")))
    rolled = priced.select(
        "neighbourhood", "city", F.explode(levels).alias("structure_class"), "price", "__n"
    ).where(F.col("structure_class").isNotNull())
    counts = rolled.groupBy(
        *area, F.lit("median_sale_price").alias("__name"), F.col("price").cast("double").alias("__value")
    ).agg(F.sum("__n").alias("__n"))
    middle = quantiles.quantiles_from_counts(counts, area, {"median_sale_price": 0.5}).drop("__name")
    plain = counts.groupBy(*area).agg(
        F.sum(F.col("__value").cast("decimal(18,0)") * F.col("__n")).cast("double").alias("__sum"),
        F.sum("__n").alias("sale_txn_count"),
    )
    stacked = plain.unionByName(middle, allowMissingColumns=True)
    both = stacked.groupBy(*area).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in area])
    return both.select(
        *area, "median_sale_price",
        measures.ratio("__sum", "sale_txn_count", 0).alias("avg_sale_price"), "sale_txn_count",
    )


def fct_area_rent(rents: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Newest observed rents per area: overall, by structure and by bedrooms.

    The four levels are one aggregate: a row carries the labels of the levels it
    belongs to, and ``House`` averages its three types.
    """
    newest = joins.join_latest(rents, "period").where(F.col("rental_price").isNotNull())
    kind, cls = F.col("category"), F.col("property_class")
    bedroom = F
    for name, label in rules.RENT_BEDROOM_LABEL.items():
        bedroom = bedroom.when(kind == name, F.lit(label))
    label = (
        F.when(kind == "All property types", F.struct(F.lit("All").alias("c"), F.lit("overall").alias("t")))
        .when(kind == "Flat/Maisonette", F.struct(F.lit("Flat").alias("c"), F.lit("structure").alias("t")))
        .when(cls == "House", F.struct(F.lit("House").alias("c"), F.lit("structure").alias("t")))
        .when(F.col("category_type") == "bedroom", F.struct(bedroom.alias("c"), F.lit("bedroom").alias("t")))
    )
    placed = crosswalk.where(F.col("ons_area_code").isNotNull()).join(
        newest, F.col("ons_area_code") == F.col("area_code")
    ).withColumn("__label", label).where(F.col("__label").isNotNull())
    rows = placed.groupBy(
        "neighbourhood", "city", F.col("__label.c").alias("rent_category"),
        F.col("__label.t").alias("category_type"),
        F.when(F.col("__label.c") != "House", F.col("ons_area_code")).alias("__code"),
    ).agg(
        measures.mean("rental_price").alias("__rent"), F.any_value("period").alias("rent_period"),
        F.any_value("rent_grain").alias("rent_grain"),
    )
    return rows.select(
        "neighbourhood", "city", "rent_category", "category_type",
        F.round("__rent", 0).alias("monthly_rent"), F.round(F.col("__rent") * 12.0, 0).alias("annual_rent"),
        "rent_period", "rent_grain",
    )
