"""Serving marts over the star."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lettings import rules
from lettings.functions import clean, measures
from lettings.operators import joins, quantiles, spatial, windows
from lettings.plans import star


def mart_listing(
    dim_listing: DataFrame, dim_host: DataFrame, listing_poi: DataFrame, area_sales: DataFrame
) -> DataFrame:
    """One wide row per listing.

    The listing fact is a projection of the listing dimension on the same unique
    key, so its measures are computed in place instead of joining the two.
    """
    price = area_sales.select(
        "neighbourhood", "structure_class", F.col("median_sale_price").alias("area_median_sale_price")
    )
    both = (
        dim_listing.join(dim_host.select("host_id", "host_is_superhost"), "host_id", "left")
        .join(listing_poi, "listing_id", "left")
        .join(price, ["neighbourhood", "structure_class"], "left")
    )
    return both.select(
        "listing_id", "host_id", "name", "neighbourhood", "latitude", "longitude", "geo_point",
        "room_type", "property_type", "structure_class", "property_group", "accommodates",
        "bedrooms", "beds", "bathrooms", *star.listing_measures(),
        F.col("estimated_revenue_l365d").isNotNull().alias("has_revenue_data"),
        "area_median_sale_price", "review_scores_rating", "number_of_reviews", "host_is_superhost",
        "poi_count_500m", "transport_count_500m", "dining_count_500m", "instant_bookable",
        "listing_url", "picture_url",
    )


def operating_measures() -> list[Column]:
    """Averages shared by the area, property and bedroom marts."""
    return [
        F.count(F.lit(1)).alias("listing_count"), measures.mean("adr", 2).alias("avg_adr"),
        measures.mean("occupancy_rate", 4).alias("avg_occupancy_rate"),
        measures.mean("annual_revenue", 2).alias("avg_annual_revenue"),
        measures.mean("review_scores_rating", 2).alias("avg_rating"),
    ]


def operating_medians(prefix: str = "") -> dict[str, Column]:
    return {
        f"{prefix}median_adr": F.col("adr"), f"{prefix}median_annual_revenue": F.col("annual_revenue"),
    }


def mart_area(mart_listing: DataFrame, dim_area: DataFrame, area_sales: DataFrame, dim_poi: DataFrame) -> DataFrame:
    """Area summary with in-area points and boundary."""
    per_area = quantiles.agg_with_medians(
        mart_listing, ["neighbourhood"],
        [*operating_measures(), measures.mean("bedrooms", 2).alias("avg_bedrooms")], operating_medians(),
    )
    poi = spatial.points_in_area_counts(dim_poi, dim_area, "neighbourhood", star.poi_counters())
    prices = area_sales.select("neighbourhood", "structure_class", "median_sale_price")
    both = per_area.join(dim_area, "neighbourhood", "left")
    both = joins.join_on_constant(both, prices, ["neighbourhood"], "structure_class", "All")
    both = both.join(poi, "neighbourhood", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("poi_count", "transport_count", "dining_count")}
    return both.select(
        "neighbourhood", "city", "listing_count", "avg_adr", "median_adr", "avg_occupancy_rate",
        "avg_annual_revenue", "median_annual_revenue", "avg_bedrooms", "avg_rating",
        "median_sale_price", *[c.alias(n) for n, c in counts.items()],
        measures.ratio(counts["poi_count"], "area_sqkm", 2).alias("poi_density_sqkm"),
        "area_sqkm", "boundary",
    )


def mart_area_poi(dim_area: DataFrame, dim_poi: DataFrame) -> DataFrame:
    """Every point next to the area that contains it."""
    return spatial.point_in_area(dim_poi, dim_area, ["neighbourhood", "city"]).select(
        "neighbourhood", "city", F.col("name").alias("poi_name"), "category", "amenity_group",
        "is_transport", "is_dining", "latitude", "longitude",
    )


def listing_months(calendar: DataFrame) -> DataFrame:
    """Nights and booked nights per listing and calendar month.

    The calendar is reduced about thirty-fold here, before any join.
    """
    return calendar.groupBy("listing_id", F.month("calendar_date").alias("month")).agg(
        F.count(F.lit(1)).alias("total_nights"),
        F.count_if(F.col("available") == F.lit(False)).alias("booked_nights"),
    )


def _month_sums() -> list[Column]:
    """A listing has one row per month, so its rows count the distinct listings."""
    return [
        F.count(F.lit(1)).alias("listing_count"), F.sum("total_nights").alias("total_nights"),
        F.sum("booked_nights").alias("booked_nights"),
    ]


def mart_area_seasonal(calendar: DataFrame, dim_listing: DataFrame, dim_area: DataFrame) -> DataFrame:
    """Occupancy per area and month."""
    months = listing_months(calendar).join(dim_listing.select("listing_id", "neighbourhood"), "listing_id")
    sums = months.groupBy("neighbourhood", "month").agg(*_month_sums())
    both = sums.join(dim_area.select("neighbourhood", "city"), "neighbourhood", "left")
    return both.select(
        "neighbourhood", "city", "month", "listing_count", "total_nights", "booked_nights",
        measures.ratio("booked_nights", "total_nights", 4).alias("occupancy_rate"),
    )


def dwellings(mart_listing: DataFrame, dim_area: DataFrame, bedrooms: bool = False) -> DataFrame:
    """Comparable listings with the city of their area."""
    kept = mart_listing.where(measures.like_for_like(bedrooms))
    return kept.join(dim_area.select("neighbourhood", "city"), "neighbourhood")


def mart_property_type(mart_listing: DataFrame, dim_area: DataFrame, area_sales: DataFrame) -> DataFrame:
    """Operating figures and sale price per area and dwelling class."""
    keys = ["neighbourhood", "city", "structure_class"]
    sums = quantiles.agg_with_medians(
        dwellings(mart_listing, dim_area), keys,
        [*operating_measures(), measures.mean("bedrooms", 2).alias("avg_bedrooms")], operating_medians(),
    )
    prices = area_sales.select("neighbourhood", "structure_class", "median_sale_price", "sale_txn_count")
    both = sums.join(prices, ["neighbourhood", "structure_class"], "left")
    return both.select(
        *keys, "listing_count", "avg_adr", "median_adr", "avg_occupancy_rate", "avg_annual_revenue",
        "median_annual_revenue", "avg_bedrooms", "avg_rating", "median_sale_price", "sale_txn_count",
        measures.sufficient("listing_count").alias("sufficient_sample"),
    )


def mart_bedrooms(mart_listing: DataFrame, dim_area: DataFrame) -> DataFrame:
    """Operating figures per area, class and bedroom bucket next to those of the city."""
    base = dwellings(mart_listing, dim_area, bedrooms=True).select(
        "*", measures.bedroom_bucket("bedrooms").alias("bedroom_bucket"),
        measures.bedroom_sort("bedrooms").alias("bedroom_sort"),
    )
    cell = ["neighbourhood", "city", "structure_class", "bedroom_bucket", "bedroom_sort"]
    wide = ["city", "structure_class", "bedroom_bucket"]
    figures = leveled_figures(base, cell, wide)
    over_city = Window.partitionBy(*wide)
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in wide])
    of_city = {
        f"city_{c}": F.when(named, F.max(F.when(F.col("__wide"), F.col(c))).over(over_city))
        for c in ("listing_count", "median_adr", "avg_occupancy_rate", "median_annual_revenue")
    }
    return figures.withColumns(of_city).where(~F.col("__wide")).select(
        *cell, "listing_count", "avg_adr", "median_adr", "avg_occupancy_rate", "avg_annual_revenue",
        "median_annual_revenue", "avg_rating", "city_listing_count", "city_median_adr",
        "city_avg_occupancy_rate", "city_median_annual_revenue",
        measures.sufficient("listing_count").alias("sufficient_sample"),
        measures.robust("listing_count").alias("robust_sample"),
    )


def leveled_figures(base: DataFrame, cell: list[str], wide: list[str]) -> DataFrame:
    """Operating figures per cell and, with ``__wide``, over all cells that agree in ``wide``.

    Each row is counted once per level, measure and value; averages, medians and the number
    of rows of both levels all come from these counts, so the input is read once.
    """
    level = base.withColumn("__wide", F.explode(F.array(F.lit(False), F.lit(True))))
    level = level.withColumns({c: F.when(~F.col("__wide"), F.col(c)) for c in cell if c not in wide})
    keys = ["__wide", *cell]
    means = {"avg_adr": ("adr", 2), "avg_occupancy_rate": ("occupancy_rate", 4), "avg_annual_revenue": ("annual_revenue", 2),
             "avg_rating": ("review_scores_rating", 2)}
    counts = quantiles.value_counts(level, keys, {"__rows": F.lit(0.0), **{c: F.col(c) for c, _ in means.values()}})

    def value(name: str) -> Column:
        return F.when(F.col("__name") == name, F.col("__value"))

    plain = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("__name") == "__rows", F.col("__n"))).alias("listing_count"),
        *[measures.counted_mean(value(c), "__n", digits).alias(out) for out, (c, digits) in means.items()],
    )
    halves = {"median_adr": "adr", "median_annual_revenue": "annual_revenue"}
    near = quantiles.ranked_values(counts.where(F.col("__name").isin(list(halves.values()))), keys, [0.5])
    middle = near.groupBy(*keys).agg(*[quantiles.interpolated(c, 0.5).alias(out) for out, c in halves.items()])
    stacked = plain.unionByName(middle, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])


def city_benchmark(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same figures at a coarser grain, for cells with few listings."""
    return quantiles.agg_with_medians(
        base, keys,
        [
            F.count(F.lit(1)).alias("city_listing_count"),
            measures.mean("occupancy_rate", 4).alias("city_avg_occupancy_rate"),
        ],
        operating_medians("city_"),
    )


def mart_property_seasonal(calendar: DataFrame, mart_listing: DataFrame, dim_area: DataFrame) -> DataFrame:
    """Occupancy per area, class, bedroom bucket (and ``All``) and month.

    ``All`` also counts studios and unknown sizes, so it is its own level over
    the same per-listing months.
    """
    homes = dwellings(mart_listing, dim_area).select(
        "listing_id", "neighbourhood", "city", "structure_class", "bedrooms"
    )
    months = listing_months(calendar).join(homes, "listing_id")
    beds = F.col("bedrooms")
    levels = F.array(
        F.struct(F.lit("All").alias("bucket"), F.lit(-1).cast("bigint").alias("sort")),
        F.when(beds >= 1, F.struct(
            measures.bedroom_bucket(beds).alias("bucket"), measures.bedroom_sort(beds).alias("sort"))),
    )
    leveled = months.select("*", F.explode(levels).alias("__level")).where(F.col("__level").isNotNull())
    keys = ["neighbourhood", "city", "structure_class"]
    sums = leveled.groupBy(
        *keys, F.col("__level.bucket").alias("bedroom_bucket"), F.col("__level.sort").alias("bedroom_sort"), "month"
    ).agg(*_month_sums())
    return sums.select(
        *keys, "bedroom_bucket", "bedroom_sort", "month", "listing_count", "total_nights",
        "booked_nights", measures.ratio("booked_nights", "total_nights", 4).alias("occupancy_rate"),
        measures.sufficient("listing_count").alias("sufficient_sample"),
    )


def mart_st_vs_lt(
    mart_listing: DataFrame, dim_area: DataFrame, area_sales: DataFrame, area_rent: DataFrame,
    assumptions: DataFrame,
) -> DataFrame:
    """Short-term against long-term income per area, class and bedroom bucket."""
    city = dim_area.select("neighbourhood", "city").join(
        F.broadcast(assumptions.select("city", "cap_nights", "assumed_lt_gross_yield_pct")), "city", "left"
    )
    kept = mart_listing.where(measures.like_for_like(True) & F.col("adr").isNotNull())
    cap = F.coalesce(F.col("cap_nights"), F.lit(rules.DEFAULT_CAP_NIGHTS)).cast("bigint")
    base = kept.join(city, "neighbourhood").select(
        "neighbourhood", "city", "structure_class",
        measures.bedroom_bucket("bedrooms").alias("bedroom_bucket"),
        measures.bedroom_sort("bedrooms").alias("bedroom_sort"),
        cap.alias("occupancy_cap_nights"), "assumed_lt_gross_yield_pct",
        (F.col("adr") * measures.least_or_null(F.col("occupancy_nights"), cap)).alias("__income"),
    )
    keys = ["neighbourhood", "city", "structure_class", "bedroom_bucket", "bedroom_sort",
            "occupancy_cap_nights", "assumed_lt_gross_yield_pct"]
    cells = quantiles.agg_with_medians(
        base, keys, [F.count(F.lit(1)).alias("listing_count")], {"__st": F.col("__income")}
    )
    prices = area_sales.select("neighbourhood", "structure_class", "median_sale_price")
    by_beds = area_rent.where(F.col("category_type") == "bedroom").select(
        "neighbourhood", F.col("rent_category").alias("bedroom_bucket"), F.col("annual_rent").alias("__bed_rent")
    )
    by_class = area_rent.where(F.col("category_type") == "structure").select(
        "neighbourhood", F.col("rent_category").alias("structure_class"), F.col("annual_rent").alias("__class_rent")
    )
    both = (
        cells.join(prices, ["neighbourhood", "structure_class"], "left")
        .join(by_beds, ["neighbourhood", "bedroom_bucket"], "left")
        .join(by_class, ["neighbourhood", "structure_class"], "left")
    )
    assumed = F.round(F.col("median_sale_price") * F.col("assumed_lt_gross_yield_pct") / 100.0, 0)
    rent, source = clean.first_available(
        [("__bed_rent", "observed_bedroom"), ("__class_rent", "observed_structure")], (assumed, "assumed")
    )
    both = both.withColumn("lt_annual_income", rent).withColumn("lt_rent_source", source)
    st, lt, price = F.col("__st"), F.col("lt_annual_income"), F.col("median_sale_price")

    def yield_pct(income: Column) -> Column:
        return F.round(measures.ratio(income, price) * 100.0, 2)

    return both.select(
        "neighbourhood", "city", "structure_class", "bedroom_bucket", "bedroom_sort", "listing_count",
        "occupancy_cap_nights", "median_sale_price", F.round(st, 2).alias("st_annual_income"),
        yield_pct(st).alias("st_gross_yield_pct"), "assumed_lt_gross_yield_pct", "lt_annual_income",
        yield_pct(lt).alias("lt_gross_yield_pct"), "lt_rent_source",
        F.round(st - lt, 2).alias("st_vs_lt_income_uplift"),
        yield_pct(st - lt).alias("st_vs_lt_yield_uplift_ppt"),
        measures.ratio(st, lt, 2).alias("st_to_lt_income_ratio"), (st > lt).alias("st_wins"),
        measures.sufficient("listing_count").alias("sufficient_sample"),
    )


def listing_groups(amenities: DataFrame) -> DataFrame:
    """Amenity groups of each listing, once each."""
    return amenities.select("listing_id", "amenity_group").distinct()


def mart_amenities(amenities: DataFrame, dim_listing: DataFrame, dim_area: DataFrame) -> DataFrame:
    """Share of an area's listings that offer each amenity group."""
    placed = listing_groups(amenities).join(dim_listing.select("listing_id", "neighbourhood"), "listing_id")
    with_group = placed.groupBy("neighbourhood", "amenity_group").agg(
        F.count(F.lit(1)).alias("listings_with_group")
    )
    base = placed.select("neighbourhood", "listing_id").distinct().groupBy("neighbourhood").agg(
        F.count(F.lit(1)).alias("area_listings")
    )
    both = with_group.join(base, "neighbourhood").join(
        dim_area.select("neighbourhood", "city"), "neighbourhood", "left"
    )
    return both.select(
        "neighbourhood", "city", "amenity_group", "listings_with_group", "area_listings",
        measures.ratio("listings_with_group", "area_listings", 4).alias("pct_listings_with_group"),
    )


def revenue_segments(fct_listing: DataFrame, amenities: DataFrame) -> DataFrame:
    """Earning listings with amenities, the best-paid quarter of each area marked ``top``."""
    earning = fct_listing.where(F.col("annual_revenue") > 0).select("listing_id", "neighbourhood", "annual_revenue")
    kept = joins.join_semi(earning, amenities, ["listing_id"])
    return windows.top_quartile(kept, "neighbourhood", "annual_revenue", "listing_id")


def mart_amenity_gap(fct_listing: DataFrame, amenities: DataFrame, dim_area: DataFrame) -> DataFrame:
    """Amenity coverage among the best-paid quarter against the rest."""
    seg = revenue_segments(fct_listing, amenities).select("listing_id", "neighbourhood", "segment")
    top, rest = F.col("segment") == "top", F.col("segment") == "rest"
    sizes = seg.groupBy("neighbourhood").agg(F.count_if(top).alias("top_n"), F.count_if(rest).alias("rest_n"))
    with_group = seg.join(listing_groups(amenities), "listing_id").groupBy("neighbourhood", "amenity_group").agg(
        F.count_if(top).alias("__top"), F.count_if(rest).alias("__rest")
    )
    both = with_group.join(sizes, "neighbourhood").join(
        dim_area.select("neighbourhood", "city"), "neighbourhood", "left"
    )
    pct_top, pct_rest = measures.ratio("__top", "top_n"), measures.ratio("__rest", "rest_n")
    return both.select(
        "neighbourhood", "city", "amenity_group", "top_n", "rest_n",
        F.round(pct_top, 4).alias("pct_top"), F.round(pct_rest, 4).alias("pct_rest"),
        F.round(pct_top - pct_rest, 4).alias("gap"),
        (F.col("top_n") + F.col("rest_n")).alias("area_active_listings"),
        measures.gap_sample("top_n", "rest_n").alias("sufficient_sample"),
    )
