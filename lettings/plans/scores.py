"""Area and listing scores per investor persona, and review themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lettings import rules
from lettings.functions import classify, clean, measures
from lettings.operators import joins, quantiles, reshape, windows


def _rounded(c: Column) -> Column:
    return F.bround(c, 4)


def area_metrics(listings: DataFrame) -> DataFrame:
    """Measures per city and area; rows without a city or an area are left out."""
    rows = listings.select("*", clean.path_city("_filename").alias("city")).where(
        F.col("city").isNotNull() & F.col("neighbourhood").isNotNull()
    )

    def mean(c: str) -> Column:
        return _rounded(measures.mean(c))

    def room(kind: str) -> Column:
        return F.count_if(F.col("room_type") == kind)

    return rows.groupBy("city", F.col("neighbourhood").alias("neighbourhood_cleansed")).agg(
        F.count("listing_id").alias("listing_count"),
        F.coalesce(F.sum("number_of_reviews"), F.lit(0)).alias("total_reviews"),
        mean("price").alias("avg_price"), F.min("price").cast("double").alias("min_price"),
        F.max("price").cast("double").alias("max_price"),
        mean("estimated_occupancy_l365d").alias("avg_occupancy"),
        mean("estimated_revenue_l365d").alias("avg_revenue"),
        F.coalesce(_rounded(measures.exact_sum("estimated_revenue_l365d")), F.lit(0.0)).alias("total_revenue"),
        mean("review_scores_rating").alias("avg_review_rating"),
        mean("review_scores_cleanliness").alias("avg_cleanliness_score"),
        mean("review_scores_location").alias("avg_location_score"),
        mean("review_scores_checkin").alias("avg_checkin_score"),
        mean("review_scores_communication").alias("avg_communication_score"),
        mean("review_scores_value").alias("avg_value_score"),
        F.countDistinct("room_type").alias("room_type_variety"),
        F.countDistinct("property_type").alias("property_type_variety"),
        room("Entire home/apt").alias("count_entire_home_apt"),
        room("Private room").alias("count_private_room"),
        room("Shared room").alias("count_shared_room"),
        room("Hotel room").alias("count_hotel_room"),
        mean("host_response_rate_pct").alias("avg_host_response_rate"),
        mean("host_acceptance_rate_pct").alias("avg_host_acceptance_rate"),
        _rounded(share_when(F.col("host_is_superhost"))).alias("pct_superhost"),
    )


def share_when(test: Column) -> Column:
    """Percent of rows where the test holds among those where it is known."""
    return measures.ratio(F.count_if(test), F.count(test)) * F.lit(100.0)


def area_poi_columns(pois: DataFrame) -> DataFrame:
    """Points of the three scored groups per area, one column each."""
    wanted = pois.where(F.col("amenity_group").isin(*rules.POI_SCORE_COLUMNS.values()))
    return reshape.pivot_counts(
        wanted.where(F.col("neighbourhood").isNotNull()), ["neighbourhood"], "amenity_group",
        rules.POI_SCORE_COLUMNS,
    )


def area_sizes(area_shapes: DataFrame) -> DataFrame:
    """Positive sizes with the city of the file."""
    return area_shapes.where(F.col("area_sqkm") > 0).select(
        "neighbourhood", "area_sqkm", clean.path_city("_filename").alias("city")
    )


def location_score(density: Column) -> list[Column]:
    """Weighted points of interest and their mix with the listing density."""
    poi = measures.weighted_sum((c, w) for c, w in rules.POI_SCORE_WEIGHTS.items())
    mixed = poi * F.lit(rules.LOCATION_POI_WEIGHT) + density * F.lit(rules.LOCATION_DENSITY_WEIGHT)
    return [poi.alias("poi_score"), mixed.alias("location_score")]


def with_location(
    rows: DataFrame, area: str, counts: DataFrame, sizes: DataFrame, pois: DataFrame, missing_density: bool
) -> DataFrame:
    """Adds density, point counts and location score by city and area.

    ``missing_density`` keeps the density of an area without size as NULL.
    """
    per_area = (
        counts.join(sizes, ["neighbourhood", "city"], "left")
        .join(area_poi_columns(pois), "neighbourhood", "left")
        .select(
            F.col("neighbourhood").alias(area), "city",
            measures.ratio("__count", "area_sqkm").alias("__density"), *rules.POI_SCORE_COLUMNS,
        )
    )
    density = F.col("__density") if missing_density else F.coalesce("__density", F.lit(0.0))
    placed = rows.join(per_area, [area, "city"], "left").select(
        *rows.columns, density.alias("listing_density"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in rules.POI_SCORE_COLUMNS],
    )
    return placed.select("*", *location_score(F.col("listing_density")))


def area_persona_scores(metrics: DataFrame, area_shapes: DataFrame, pois: DataFrame) -> DataFrame:
    """Three scores per area, each signal scaled within its city."""
    counts = metrics.select(
        F.col("neighbourhood_cleansed").alias("neighbourhood"), "city", F.col("listing_count").alias("__count")
    )
    rows = with_location(metrics, "neighbourhood_cleansed", counts, area_sizes(area_shapes), pois, True)
    rows = rows.withColumn("__location", F.coalesce("location_score", F.lit(0.0)))
    signals = {
        "norm_price_inv": ("avg_price", True), "norm_avg_price": ("avg_price", False),
        "norm_occupancy": ("avg_occupancy", False), "norm_revenue": ("avg_revenue", False),
        "norm_rating": ("avg_review_rating", False), "norm_location": ("__location", False),
    }
    scaled = windows.minmax_by(rows, "city", signals, fixed_parts=True)
    return scaled.select(
        *[c for c in rows.columns if c != "__location"],
        *[measures.weighted_score(parts).alias(name) for name, parts in rules.AREA_SCORE_WEIGHTS.items()],
    )


def listing_yield(mart_listing: DataFrame) -> DataFrame:
    """Revenue over the area's median sale price, capped at the overall 99th percentile."""
    rows = mart_listing.where(
        (F.col("annual_revenue") > 0) & (F.col("area_median_sale_price") > 0)
    ).select("listing_id", measures.ratio("annual_revenue", "area_median_sale_price").alias("gross_yield"))
    cap = quantiles.quantiles(rows, [], {"__cap": (F.col("gross_yield"), rules.YIELD_CAP_QUANTILE)})
    both = rows.crossJoin(F.broadcast(cap))  # one row
    return both.select("listing_id", measures.clip_upper("gross_yield", "__cap").alias("gross_yield"))


def listing_persona_scores(
    listings: DataFrame, area_shapes: DataFrame, pois: DataFrame, yields: DataFrame
) -> DataFrame:
    """Three scores per earning listing, each signal scaled within its city."""
    rows = listings.select("*", clean.path_city("_filename").alias("city")).where(
        (F.col("estimated_revenue_l365d") > 0) & (F.col("price") > 0) & F.col("city").isNotNull()
    ).select(
        "listing_id", "city", F.col("neighbourhood").alias("neighbourhood_cleansed"), "property_type",
        "room_type", "bedrooms", F.col("price").cast("double").alias("price"),
        F.col("estimated_occupancy_l365d").alias("estimated_occupancy"),
        F.col("estimated_revenue_l365d").cast("double").alias("estimated_revenue"),
        "number_of_reviews", "review_scores_rating",
    )
    counts = rows.groupBy(F.col("neighbourhood_cleansed").alias("neighbourhood"), "city").agg(
        F.count(F.lit(1)).alias("__count")
    )
    placed = with_location(rows, "neighbourhood_cleansed", counts, area_sizes(area_shapes), pois, False)
    placed = placed.join(yields, "listing_id", "left").withColumn(
        "gross_yield", F.coalesce("gross_yield", F.lit(0.0))
    )
    signals = {
        "norm_location": ("location_score", False), "norm_yield": ("gross_yield", False),
        "norm_price": ("price", True), "norm_occupancy": ("estimated_occupancy", False),
        "norm_revenue": ("estimated_revenue", False), "norm_rating": ("review_scores_rating", False),
        "norm_review_vol": ("number_of_reviews", False),
    }
    scaled = windows.minmax_by(placed, "city", signals, fixed_parts=True).drop("poi_score")
    return scaled.select(
        "*",
        *[measures.weighted_score(parts).alias(name) for name, parts in rules.LISTING_SCORE_WEIGHTS.items()],
        F.lit("high").alias("score_confidence"),
    )


def review_themes(
    reviews: DataFrame, listings: DataFrame,
    keywords: Mapping[str, Sequence[str]] = rules.THEME_KEYWORDS, sentiment: DataFrame | None = None,
) -> DataFrame:
    """How often each theme occurs in the comments of an area.

    Each comment is reduced to four flags before the join, so the texts
    themselves are never shuffled.
    """
    col = "comments_list" if "comments_list" in reviews.columns else "comments"
    texts = reshape.explode_list(reviews, col, "comment") if col == "comments_list" else reviews.where(
        F.trim("comments") != "").withColumnRenamed("comments", "comment")
    flags = texts.select(
        "listing_id", *[classify.mentions("comment", words).alias(f"__{t}") for t, words in keywords.items()]
    )
    per_listing = flags.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("__total"), *[F.count_if(F.col(f"__{t}")).alias(f"__{t}") for t in keywords]
    )
    homes = listings.select("listing_id", clean.path_city("_filename").alias("city"), "neighbourhood").where(
        F.col("city").isNotNull() & F.col("neighbourhood").isNotNull()
    )
    per_area = per_listing.join(homes, "listing_id").groupBy("city", "neighbourhood").agg(
        F.sum("__total").alias("total_reviews"),
        *[F.sum(f"__{t}").alias(f"mentions_{t}_count") for t in keywords],
    )
    themed = per_area.select(
        "city", F.col("neighbourhood").alias("neighbourhood_cleansed"), "total_reviews",
        *[f"mentions_{t}_count" for t in keywords],
        *[
            F.bround(measures.ratio(f"mentions_{t}_count", "total_reviews") * 100.0, 2).alias(f"pct_mentions_{t}")
            for t in keywords
        ],
        classify.first_argmax([(f"mentions_{t}_count", t) for t in keywords]).alias("top_theme"),
    )
    if sentiment is None:
        return themed.withColumn("avg_sentiment_score", F.lit(None).cast("double"))
    mood = sentiment.join(homes, "listing_id").groupBy(
        "city", F.col("neighbourhood").alias("neighbourhood_cleansed")
    ).agg(F.bround(measures.mean("avg_sentiment_score"), 4).alias("avg_sentiment_score"))
    return themed.join(mood, ["city", "neighbourhood_cleansed"], "left")
