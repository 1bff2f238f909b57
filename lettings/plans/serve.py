"""Reads behind the pages and the data side of written narratives."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lettings import rules
from lettings.functions import clean, measures, spatial as geo
from lettings.operators import joins, reports, reshape, windows
from lettings.sources import tables

SCORES = tuple(rules.PERSONA_SCORES.values())


def rank_areas(mart_area: DataFrame, outputs: DataFrame, persona: str, output_type: str = "AREA_OVERVIEW") -> DataFrame:
    """Areas of a persona by score, best first, with map centre and boundary."""
    scored = joins.select_cases(outputs, {"persona": persona, "output_type": output_type}).select(
        clean.name_key("city").alias("__city"), clean.name_key("neighbourhood_cleansed").alias("__area"),
        "investment_score",
    )
    both = mart_area.join(
        scored,
        (clean.name_key("neighbourhood") == F.col("__area")) & (clean.name_key("city") == F.col("__city")),
    ).drop("__city", "__area")
    centre = geo.centroid("boundary")
    placed = both.select("*", centre["y"].alias("lat"), centre["x"].alias("lon"))
    ranked = windows.rank_by(placed, "investment_score", ["city", "neighbourhood"], "investment_rank")
    return ranked.orderBy("investment_rank")


def map_features(ranked: DataFrame) -> DataFrame:
    """GeoJSON feature text per area."""
    props = ["neighbourhood", "city", "listing_count", "avg_adr", "poi_count"]
    return ranked.select(
        "neighbourhood", "city",
        reshape.geojson_feature(geo.boundary_json("boundary"), props).alias("feature"),
    )


def join_scores(mart_listing: DataFrame, scores: DataFrame) -> DataFrame:
    """Listings with their persona scores; rows without a scored city drop out."""
    wanted = scores.select("listing_id", "city", *SCORES)
    return mart_listing.join(wanted, "listing_id", "left").where(F.col("city").isNotNull())


def scores_by_area(mart_listing: DataFrame, scores: DataFrame) -> DataFrame:
    both = join_scores(mart_listing, scores).where(F.col("neighbourhood").isNotNull())
    return both.groupBy("city", "neighbourhood").agg(*[measures.mean(s, 6).alias(s) for s in SCORES])


def scores_by_segment(mart_listing: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean persona scores per city, area, class and bedroom bucket."""
    both = join_scores(mart_listing, scores).where(
        F.col("neighbourhood").isNotNull() & F.col("structure_class").isNotNull()
    )
    bucket = measures.bedroom_bucket_strict("bedrooms").alias("bedroom_bucket")
    return both.groupBy("city", "neighbourhood", "structure_class", bucket).agg(
        *[measures.mean(s, 6).alias(f"avg_{s}") for s in SCORES]
    )


def norm_means_by_area(scores: DataFrame) -> DataFrame:
    """Mean signals and listing count per area."""
    return scores.groupBy("city", "neighbourhood_cleansed").agg(
        F.count(F.lit(1)).alias("listing_count"),
        *[
            measures.mean(f"norm_{c}", 6).alias(f"avg_norm_{c}")
            for c in ("price", "occupancy", "revenue", "rating")
        ],
    )


def area_strategy(st_vs_lt: DataFrame, min_sample: bool = False) -> DataFrame:
    """Listing-weighted incomes and yields per area next to plain sums.

    With ``min_sample`` only cells with a sufficient sample count.
    """
    rows = st_vs_lt.where(
        F.col("st_annual_income").isNotNull() & F.col("lt_annual_income").isNotNull()
        & (F.col("listing_count") > 0)
    )
    rows = rows.where(F.col("sufficient_sample")) if min_sample else rows
    weighted = {
        "st_annual_revenue": "st_annual_income", "lt_annual_rent": "lt_annual_income",
        "st_gross_yield_pct": "st_gross_yield_pct", "lt_gross_yield_pct": "lt_gross_yield_pct",
    }
    sums = ("st_vs_lt_income_uplift", "st_vs_lt_yield_uplift_ppt", "st_to_lt_income_ratio")
    return rows.groupBy("city", "neighbourhood").agg(
        F.sum("listing_count").alias("listing_count"),
        *[measures.weighted_mean(c, "listing_count").alias(n) for n, c in weighted.items()],
        *[measures.exact_sum(c).alias(f"{c}_sum") for c in sums],
    )


def area_months(seasonal: DataFrame) -> DataFrame:
    complete = seasonal.dropna(subset=["city", "neighbourhood", "month"])
    return complete.withColumn("month_name", measures.month_label("month"))


def area_points(mart_area_poi: DataFrame) -> DataFrame:
    """Complete points with a readable category."""
    complete = mart_area_poi.dropna(
        subset=["city", "neighbourhood", "poi_name", "amenity_group", "latitude", "longitude"]
    )
    return complete.withColumn("category", measures.display_text("category")).withColumn(
        "amenity_group", F.trim("amenity_group")
    )


def compare_areas(
    picks: DataFrame, scores: DataFrame, strategy: DataFrame, seasonal: DataFrame
) -> DataFrame:
    """One row per picked area and month: persona means, strategy and occupancy.

    ``scores`` and ``strategy`` join left, months inner, as on the page.
    """
    cols = ["neighbourhood", "city"]
    keys = {c: f"__{c}" for c in cols}

    def keyed(df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return df.select(*[clean.name_key(c).alias(k) for c, k in keys.items()], *keep)

    named = picks.select("*", *[clean.name_key(c).alias(k) for c, k in keys.items()])
    both = named.join(keyed(scores, SCORES), list(keys.values()), "left")
    both = both.join(
        keyed(strategy, ["st_annual_revenue", "lt_annual_rent", "st_gross_yield_pct", "lt_gross_yield_pct"]),
        list(keys.values()), "left",
    )
    months = keyed(area_months(seasonal), ["month", "month_name", "booked_nights", "total_nights", "occupancy_rate"])
    return both.join(months, list(keys.values())).drop(*keys.values())


def compared_points(picks: DataFrame, mart_area_poi: DataFrame) -> DataFrame:
    return joins.join_selection(picks, area_points(mart_area_poi), ["neighbourhood", "city"])


INCOME_LABELS = {"st_annual_revenue": "Short-Term", "lt_annual_rent": "Long-Term"}
YIELD_LABELS = {"st_gross_yield_pct": "Short-Term", "lt_gross_yield_pct": "Long-Term"}


def income_lines(strategy: DataFrame) -> DataFrame:
    return reshape.melt(strategy, ["city", "neighbourhood"], INCOME_LABELS, "strategy", "annual_income")


def yield_lines(strategy: DataFrame) -> DataFrame:
    return reshape.melt(strategy, ["city", "neighbourhood"], YIELD_LABELS, "strategy", "gross_yield")


def segments(mart_bedrooms: DataFrame, segment_scores: DataFrame) -> DataFrame:
    """Bedroom mart with mean persona scores; cells without scores drop out."""
    keys = ["city", "neighbourhood", "structure_class", "bedroom_bucket"]
    named = mart_bedrooms.where(clean.name_key("structure_class") != "other / unknown")
    both = named.join(segment_scores, keys)
    return both.select(
        *keys, "bedroom_sort", "listing_count", "avg_adr", "median_adr", "avg_annual_revenue",
        "median_annual_revenue", "avg_occupancy_rate", "avg_rating", "robust_sample",
        "sufficient_sample",
        F.round(F.col("avg_occupancy_rate").cast("decimal(12,4)") * 100, 1).cast("double").alias("avg_occupancy_pct"),
        *[f"avg_{s}" for s in SCORES],
    )


def candidate_listings(mart_listing: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored listings of a dwelling class with at least one bedroom."""
    both = join_scores(mart_listing, scores).withColumn(
        "bedroom_group", measures.bedroom_bucket_strict("bedrooms")
    )
    return both.where(
        F.col("neighbourhood").isNotNull() & F.col("bedroom_group").isNotNull()
        & F.col("structure_class").isNotNull()
        & (clean.name_key("structure_class") != "other / unknown")
    )


def top_listings(candidates: DataFrame, segment: Mapping[str, str], persona: str, k: int = 10) -> DataFrame:
    """Best listings of one segment for a persona; the id decides ties."""
    score = rules.PERSONA_SCORES[persona]
    chosen = joins.select_cases(candidates, segment).where(F.col(score).isNotNull())
    return windows.top_k(chosen.withColumn("persona_score", F.col(score)), k, "persona_score", ["listing_id"])


def top_listings_per_segment(candidates: DataFrame, persona: str, k: int = 10) -> DataFrame:
    """The same list for every segment at once."""
    score = rules.PERSONA_SCORES[persona]
    keys = ["city", "neighbourhood", "structure_class", "bedroom_group"]
    order = [F.col(score).desc_nulls_last(), F.col("listing_id").asc()]
    kept = candidates.where(F.col(score).isNotNull())
    return windows.top_k_per(kept, keys, k, order).select(*keys, "listing_id", F.col(score).alias("persona_score"))


def top_segments(segment_frame: DataFrame, persona: str, k: int = 3) -> DataFrame:
    """Best segments per area with the wording for thin samples."""
    score = f"avg_{rules.PERSONA_SCORES[persona]}"
    order = [F.col(score).desc_nulls_last(), F.col("structure_class").asc(), F.col("bedroom_bucket").asc()]
    best = windows.top_k_per(segment_frame, ["city", "neighbourhood"], k, order)
    return best.withColumn("sample_note", measures.sample_note("listing_count"))


SEGMENT_KEYS = ("neighbourhood", "structure_class", "bedroom_bucket")


def compare_segments(
    st_vs_lt: DataFrame, segment_scores: DataFrame, property_seasonal: DataFrame,
    city: str, picks: Iterable[Sequence[str]],
) -> DataFrame:
    """Strategy, scores and seasons of picked segments of a city.

    Empty unless every pick has its strategy row.
    """
    picks = [tuple(p) for p in picks]
    keys = list(SEGMENT_KEYS)

    def chosen(df: DataFrame) -> DataFrame:
        return joins.tuple_in(df.where(F.col("city") == city), keys, picks)

    strategy = chosen(st_vs_lt).select(
        *keys, "listing_count", "st_annual_income", "lt_annual_income", "st_gross_yield_pct",
        "lt_gross_yield_pct", "st_wins", "sufficient_sample",
    )
    complete = F.broadcast(strategy.agg((F.count(F.lit(1)) >= len(picks)).alias("__complete")))  # one row
    strategy = strategy.crossJoin(complete).where("__complete").drop("__complete")
    seasons = reports.season_summary(chosen(property_seasonal), keys).select(
        *keys, "season", "occupancy", "peak_season", "trough_season"
    )
    return strategy.join(chosen(segment_scores).drop("city"), keys, "left").join(seasons, keys, "left")


def enrich_areas(metrics: DataFrame, norms: DataFrame, themes: DataFrame) -> DataFrame:
    """Area scores with mean signals and review themes, by city and area."""
    keys = ["city", "neighbourhood_cleansed"]
    return metrics.join(norms.drop("listing_count"), keys, "left").join(themes, keys, "left")


def personas_frame(df: DataFrame) -> DataFrame:
    rows = [(p, s) for p, s in rules.PERSONA_SCORES.items()]
    return joins.values_frame(df.sparkSession, rows, "persona string, score_column string")


def prompt_context(areas: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """One row per area and persona: score and measures as JSON text.

    ``best`` adds the top segments of an area as a list of structs; at most
    three per area.
    """
    crossed = areas.crossJoin(personas_frame(areas))
    score = F
    for persona, column in rules.PERSONA_SCORES.items():
        score = score.when(F.col("persona") == persona, F.bround(column, 2))
    metrics = [
        F.col("neighbourhood_cleansed").alias("neighbourhood"), F.col("persona"),
        F.col("investment_score"), F.bround("avg_price", 2).alias("avg_price"),
        F.bround("avg_occupancy", 4).alias("avg_occupancy"), F.bround("avg_revenue", 2).alias("avg_revenue"),
        F.bround("avg_review_rating", 2).alias("avg_review_rating"), F.col("listing_count"),
        F.bround("pct_superhost", 2).alias("pct_superhost"), F.col("top_theme").alias("top_review_theme"),
        *[F.col(f"pct_mentions_{t}") for t in rules.THEME_KEYWORDS],
    ]
    rows = crossed.withColumn("investment_score", score)
    if best is not None:
        lists = best.groupBy("city", F.col("neighbourhood").alias("neighbourhood_cleansed")).agg(
            F.array_sort(F.collect_list(F.struct(
                "structure_class", "bedroom_bucket", "listing_count", "sample_note"
            ))).alias("top_segments")
        )
        rows = rows.join(lists, ["city", "neighbourhood_cleansed"], "left")
        metrics.append(F.col("top_segments"))
    return rows.select(
        "city", "neighbourhood_cleansed", "persona", "investment_score",
        F.to_json(F.struct(*metrics)).alias("metrics_json"),
    )


FENCE = "```"


def parse_reply(text: Column) -> tuple[Column, Column]:
    """Reply without its code fence and the confidence it states.

    A JSON object without a confidence is ``medium``, other JSON and no text ``error``,
    other text ``low``.
    """
    trimmed = F.trim(text)
    inner = F.regexp_replace(F.split_part(trimmed, F.lit(FENCE), F.lit(2)), "^json", "")
    body = F.when(trimmed.startswith(FENCE), F.trim(inner, F.lit(" \n\r\t"))).otherwise(trimmed)
    stated = F.get_json_object(body, "$.confidence")
    is_json = F.try_parse_json(body).isNotNull()
    is_object = is_json & F.ltrim(body).startswith("{")
    has_text = text.isNotNull() & (text != "")
    return (
        F.when(is_object, body).otherwise(text),
        F.when(has_text & is_object, F.coalesce(stated, F.lit("medium")))
        .when(has_text & is_json, F.lit("error"))
        .when(has_text, F.lit("low")).otherwise(F.lit("error")),
    )


def parsed_replies(df: DataFrame, col: str) -> DataFrame:
    body, confidence = parse_reply(F.col(col))
    return df.withColumn("confidence", confidence).withColumn("ai_narrative", body)


def confidence_report(outputs: DataFrame) -> DataFrame:
    """Narratives per city, persona and type by confidence."""
    def level(name: str) -> Column:
        return F.count_if(F.col("confidence") == name)

    return outputs.groupBy("city", "persona", "output_type").agg(
        F.count(F.lit(1)).alias("total"), F.count("ai_narrative").alias("with_narrative"),
        level("high").alias("high_confidence"), level("medium").alias("medium_confidence"),
        level("low").alias("low_confidence"), level("error").alias("errors"),
    )


def cache_lookup(keys: DataFrame, cache: DataFrame, on: Sequence[str], newest: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest non-blank text per key; keys without one keep NULL."""
    filled = cache.where(F.trim("ai_narrative") != "")
    order = [F.col(newest).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in ties]]
    latest = windows.dedup_latest(filled, list(on), order).select(*on, "ai_narrative")
    return keys.join(latest, list(on), "left")


def cache_append(rows: DataFrame, path: str) -> None:
    """New narratives at the end of a cache table, with their time."""
    tables.write_append(rows.withColumn("computed_at", F.current_timestamp().cast("timestamp_ntz")), path)


def pending_work(areas: DataFrame, outputs: DataFrame, output_type: str, full: bool = False) -> DataFrame:
    """Areas x personas that still lack a narrative; ``full`` starts over."""
    todo = areas.select("city", "neighbourhood_cleansed").crossJoin(personas_frame(areas).select("persona"))
    if full:
        return todo
    done = outputs.where((F.col("output_type") == output_type) & F.col("ai_narrative").isNotNull())
    return joins.join_anti(todo, done, ["city", "neighbourhood_cleansed", "persona"])


def narrative_fields(outputs: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Fields of the stored narratives that match in any case; summary by fallback keys."""
    def field(name: str) -> Column:
        return F.get_json_object("ai_narrative", f"$.{name}")

    chosen = joins.select_cases(outputs, wanted)
    return chosen.select(
        "city", "neighbourhood_cleansed", "persona", "output_type",
        F.coalesce(
            field("recommendation_summary"), field("investment_summary"), field("summary"),
            F.lit(rules.NO_SUMMARY),
        ).alias("summary"),
        field("key_strengths").alias("key_strengths"), field("key_risks").alias("key_risks"),
        field("confidence").alias("stated_confidence"),
        field("recommended_action").alias("recommended_action"),
    )
