"""Serving reads, narrative data and refresh jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql, views
from checks.basic_queries import PICKS
from checks.registry import query, scratch
from checks.sql import mean, rd
from lettings import rules
from lettings.operators import joins, reports
from lettings.plans import scores, serve, silver, star
from lettings.streaming import refresh

SCORES = list(rules.PERSONA_SCORES.values())


def outputs(w):
    """Narratives from the given conversations, replies parsed."""
    return serve.parsed_replies(w["raw_outputs"], "reply").drop("reply")


@query("j15_join_scores", "select listing_id, city, score_yield_maximiser, score_occupancy_optimiser, score_quality_host from q_scored_homes")
def _(w):
    return serve.join_scores(w.at("mart_listing"), w.at("listing_persona_scores")).select("listing_id", "city", *SCORES)


@query("j16_enrich_areas", f"""
select s.city, s.neighbourhood_cleansed, s.score_quality_host, n.avg_norm_price, t.top_theme, t.total_reviews from q_area_scores s
left join (select city, neighbourhood_cleansed, {rd(mean('norm_price', 12), 6)} as avg_norm_price from q_listing_norms group by all) n using (city, neighbourhood_cleansed)
left join (select city, neighbourhood_cleansed, top_theme, total_reviews as total_reviews from q_themes) t using (city, neighbourhood_cleansed)""")
def _(w):
    themes = scores.review_themes(w.at("reviews"), w.at("listings"), views.TEST_WORDS)
    areas = w.at("area_persona_scores").drop("total_reviews")
    rich = serve.enrich_areas(areas, serve.norm_means_by_area(w.at("listing_persona_scores")), themes)
    return rich.select("city", "neighbourhood_cleansed", "score_quality_host", "avg_norm_price", "top_theme", "total_reviews")


@query("a26_scores_by_segment", "select * from q_segment_scores")
def _(w):
    return serve.scores_by_segment(w.at("mart_listing"), w.at("listing_persona_scores"))


@query("a27_city_validation", "select city, count(*) as row_count, " + ", ".join(
    f"{rd(mean(s), 2)} as avg_{s}, min({s}) as min_{s}, max({s}) as max_{s}" for s in SCORES) + " from q_listing_scores group by city")
def _(w):
    return reports.city_validation(w.at("listing_persona_scores"), SCORES)


@query("a28_norm_means_by_area", "select city, neighbourhood_cleansed, count(*) as listing_count, " + ", ".join(
    f"{rd(mean('norm_' + c, 12), 6)} as avg_norm_{c}" for c in ("price", "occupancy", "revenue", "rating")) + " from q_listing_norms group by city, neighbourhood_cleansed")
def _(w):
    return serve.norm_means_by_area(w.at("listing_persona_scores"))


@query("v01_rank_areas", """
select m.neighbourhood, m.city, m.listing_count, o.investment_score, row_number() over (order by o.investment_score desc, m.city, m.neighbourhood) as investment_rank
from q_mart_area m join q_outputs o on lower(o.neighbourhood_cleansed) = lower(m.neighbourhood) and o.city = m.city
where o.persona = 'YIELD_MAXIMISER' and o.output_type = 'AREA_OVERVIEW'""")
def _(w):
    ranked = serve.rank_areas(w.at("mart_area"), outputs(w), "yield_maximiser")
    return ranked.select("neighbourhood", "city", "listing_count", "investment_score", "investment_rank")


WEIGHTED = ("st_annual_revenue", "lt_annual_rent", "st_gross_yield_pct", "lt_gross_yield_pct")


def strategy(w):
    """Weighted means rounded as in the SQL."""
    rows = serve.area_strategy(w.at("mart_st_vs_lt"))
    return rows.select(*[F.round(c, 4).alias(c) if c in WEIGHTED else F.col(c) for c in rows.columns])


@query("v02_area_strategy", "select * from q_strategy")
def _(w):
    return strategy(w)


@query("v02_compare_areas", f"""
select p.neighbourhood, {', '.join(f'c.{s}' for s in SCORES)}, t.st_annual_revenue, t.lt_annual_rent, s.month, strftime(make_date(2024, s.month::int, 1), '%b') as month_name, s.booked_nights
from (values (' nation_3', 'London'), ('Nation_1', 'Greater Manchester'), ('none', 'Bristol')) p(neighbourhood, city)
left join (select neighbourhood, city, {', '.join(f'{rd(mean(s), 6)} as {s}' for s in SCORES)} from q_scored_homes group by all) c on lower(c.neighbourhood) = lower(trim(p.neighbourhood)) and c.city = p.city
left join q_strategy t on lower(t.neighbourhood) = lower(trim(p.neighbourhood)) and t.city = p.city
join q_area_seasonal s on lower(s.neighbourhood) = lower(trim(p.neighbourhood)) and s.city = p.city""")
def _(w):
    picks = joins.picks_frame(w.spark, PICKS, ["neighbourhood", "city"])
    compared = serve.compare_areas(
        picks, serve.scores_by_area(w.at("mart_listing"), w.at("listing_persona_scores")),
        strategy(w), w.at("mart_area_seasonal"))
    return compared.select("neighbourhood", *SCORES, "st_annual_revenue", "lt_annual_rent", "month", "month_name", "booked_nights")


@query("v02_area_points", "select amenity_group, list_aggregate(list_transform(string_split(category, '_'), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') "
       "as category, count(*) as n from q_area_poi group by all")
def _(w):
    return serve.area_points(w.at("mart_area_poi")).groupBy("amenity_group", "category").agg(F.count("*").alias("n"))


@query("v02_income_lines", "select city, neighbourhood, 'Short-Term' as strategy, st_annual_revenue as annual_income from q_strategy union all select city, neighbourhood, 'Long-Term', lt_annual_rent from q_strategy")
def _(w):
    return serve.income_lines(strategy(w))


@query("v02_yield_lines", "select city, neighbourhood, 'Short-Term' as strategy, st_gross_yield_pct as gross_yield from q_strategy union all select city, neighbourhood, 'Long-Term', lt_gross_yield_pct from q_strategy")
def _(w):
    return serve.yield_lines(strategy(w))


@query("v02_strategy_of_sampled_cells", f"""
select city, neighbourhood, cast(sum(listing_count) as bigint) as listing_count, {rd('cast(sum(st_annual_income * listing_count) as double) / sum(listing_count)', 2)} as st_annual_revenue
from q_st_vs_lt where st_annual_income is not null and lt_annual_income is not null and listing_count > 0 and sufficient_sample group by all""")
def _(w):
    rows = serve.area_strategy(w.at("mart_st_vs_lt"), min_sample=True)
    return rows.select("city", "neighbourhood", "listing_count", F.round("st_annual_revenue", 2).alias("st_annual_revenue"))


@query("v02_compared_points", """
select a.in_area as neighbourhood, p.city, a.amenity_group, count(*) as n from (values (' nation_3', 'London'), ('Nation_1', 'Greater Manchester'), ('none', 'Bristol')) p(neighbourhood, city)
join q_area_poi a on lower(a.in_area) = lower(trim(p.neighbourhood)) and a.city = p.city group by all""")
def _(w):
    picks = joins.picks_frame(w.spark, PICKS, ["neighbourhood", "city"])
    return serve.compared_points(picks, w.at("mart_area_poi")).groupBy("neighbourhood", "city", "amenity_group").agg(F.count("*").alias("n"))


@query("v03_segments", f"""
select b.city, b.neighbourhood, b.structure_class, b.bedroom_bucket, b.listing_count, b.avg_adr, {rd('b.avg_occupancy_rate * 100e0', 1)} as avg_occupancy_pct, b.robust_sample,
 s.avg_score_yield_maximiser, s.avg_score_quality_host from q_bedrooms b join q_segment_scores s using (city, neighbourhood, structure_class, bedroom_bucket)""")
def _(w):
    found = serve.segments(w.at("mart_bedrooms"), serve.scores_by_segment(w.at("mart_listing"), w.at("listing_persona_scores")))
    return found.select("city", "neighbourhood", "structure_class", "bedroom_bucket", "listing_count", "avg_adr", "avg_occupancy_pct",
                        "robust_sample", "avg_score_yield_maximiser", "avg_score_quality_host")


CANDIDATES = f"select *, {sql.STRICT_BUCKET} as bedroom_group from q_scored_homes where structure_class is not null and bedrooms >= 1"


@query("v04_top_listings", f"select listing_id, score_quality_host as persona_score from ({CANDIDATES}) c where neighbourhood = 'NATION_3' and structure_class = 'Flat' and score_quality_host is not null and city = 'London' and bedroom_group = '2' order by 2 desc, 1 limit 10")
def _(w):
    rows = serve.candidate_listings(w.at("mart_listing"), w.at("listing_persona_scores"))
    segment = {"city": "london ", "neighbourhood": "nation_3", "structure_class": "FLAT", "bedroom_group": "2"}
    return serve.top_listings(rows, segment, "QUALITY_HOST").select("listing_id", "persona_score")


@query("v04_top_listings_per_segment", f"select city, neighbourhood, structure_class, bedroom_group, listing_id, score_yield_maximiser as persona_score from ({CANDIDATES}) c where score_yield_maximiser is not null "
       "qualify row_number() over (partition by city, neighbourhood, structure_class, bedroom_group order by score_yield_maximiser desc, listing_id) <= 10")
def _(w):
    rows = serve.candidate_listings(w.at("mart_listing"), w.at("listing_persona_scores"))
    return serve.top_listings_per_segment(rows, "YIELD_MAXIMISER")


SEG = "neighbourhood, structure_class, bedroom_bucket"
SEG_PICKS = [("NATION_3", "Flat", "2"), ("NATION_6", "House", "3"), ("NATION_0", "Flat", "1")]
SEG_IN = "(" + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SEG_PICKS) + ")"


sql.CTE["q_prop_season"] = f"""
select city, {SEG}, case when month in (12, 1, 2) then 'Winter' when month < 6 then 'Spring' when month < 9 then 'Summer' else 'Autumn' end as season,
 {sql.div('sum(booked_nights)', 'sum(total_nights)')} as o from q_property_seasonal group by 1, 2, 3, 4, 5"""


@query("v05_compare_segments", f"""
select t.neighbourhood, t.structure_class, t.bedroom_bucket, t.listing_count, t.st_annual_income, t.st_wins, k.avg_score_quality_host, s.season, {rd('s.o', 6)} as occupancy,
 first_value(s.season) over (partition by {', '.join('t.' + c.strip() for c in SEG.split(','))} order by s.o desc, s.season) as peak_season
from (select *, count(*) over () as found from q_st_vs_lt where city = 'London' and ({SEG}) in {SEG_IN}) t
left join q_segment_scores k using (city, {SEG}) left join q_prop_season s using (city, {SEG}) where t.found >= 3""")
def _(w):
    found = serve.compare_segments(
        w.at("mart_st_vs_lt"), serve.scores_by_segment(w.at("mart_listing"), w.at("listing_persona_scores")),
        w.at("mart_property_seasonal"), "London", SEG_PICKS)
    return found.select("neighbourhood", "structure_class", "bedroom_bucket", "listing_count", "st_annual_income", "st_wins",
                        "avg_score_quality_host", "season", "occupancy", "peak_season")


CHOSEN = " ".join(f"when '{p}' then s.{c}" for p, c in rules.PERSONA_SCORES.items())
METRIC_DIGITS = {"avg_price": 2, "avg_occupancy": 4, "avg_revenue": 2, "avg_review_rating": 2, "pct_superhost": 2}


@query("v06_prompt_context", f"""
select s.city, s.neighbourhood_cleansed, p.persona, {sql.re_(f"case p.persona {CHOSEN} end", 2)} as investment_score,
 {', '.join(f"{sql.re_(f's.{c}', d)} as {c}" for c, d in METRIC_DIGITS.items())}, s.listing_count, t.top_theme,
 {', '.join(f't.pct_mentions_{t}' for t in rules.THEME_KEYWORDS)}, coalesce(b.n, 0) as n_segments, b.first_class
from q_area_scores s cross join (values {', '.join(f"('{p}')" for p in rules.PERSONA_SCORES)}) p(persona)
left join q_themes t using (city, neighbourhood_cleansed)
left join (select city, neighbourhood as neighbourhood_cleansed, count(*) as n, min(structure_class) as first_class from (
 select city, neighbourhood, structure_class from q_bedrooms b join q_segment_scores s using (city, neighbourhood, structure_class, bedroom_bucket)
 qualify row_number() over (partition by city, neighbourhood order by avg_score_yield_maximiser desc nulls last, structure_class, bedroom_bucket) <= 3) top
 group by all) b using (city, neighbourhood_cleansed)""")
def _(w):
    themes = scores.review_themes(w.at("reviews"), w.at("listings"), views.TEST_WORDS)
    areas = w.at("area_persona_scores").join(themes.drop("total_reviews"), ["city", "neighbourhood_cleansed"], "left")
    found = serve.segments(w.at("mart_bedrooms"), serve.scores_by_segment(w.at("mart_listing"), w.at("listing_persona_scores")))
    told = serve.prompt_context(areas, serve.top_segments(found, "YIELD_MAXIMISER"))

    def field(name, kind="double"):
        return F.get_json_object("metrics_json", f"$.{name}").cast(kind)

    best = F.from_json(field("top_segments", "string"), "array<struct<structure_class string>>")
    return told.select(
        "city", field("neighbourhood", "string").alias("neighbourhood_cleansed"), field("persona", "string").alias("persona"),
        field("investment_score").alias("investment_score"), *[field(c).alias(c) for c in METRIC_DIGITS],
        field("listing_count", "bigint").alias("listing_count"), field("top_review_theme", "string").alias("top_theme"),
        *[field(f"pct_mentions_{t}").alias(f"pct_mentions_{t}") for t in rules.THEME_KEYWORDS],
        F.coalesce(F.size(best), F.lit(0)).cast("bigint").alias("n_segments"), F.get(best, 0)["structure_class"].alias("first_class"),
    )


@query("v06_top_segments", """
select city, neighbourhood, structure_class, bedroom_bucket, case when listing_count < 3 then ' WARNING: only 1-2 listings — treat with caution'
 when listing_count < 10 then ' (limited sample — interpret carefully)' else '' end as sample_note
from q_bedrooms b join q_segment_scores s using (city, neighbourhood, structure_class, bedroom_bucket)
qualify row_number() over (partition by city, neighbourhood order by avg_score_yield_maximiser desc nulls last, structure_class, bedroom_bucket) <= 3""")
def _(w):
    found = serve.segments(w.at("mart_bedrooms"), serve.scores_by_segment(w.at("mart_listing"), w.at("listing_persona_scores")))
    return serve.top_segments(found, "YIELD_MAXIMISER").select("city", "neighbourhood", "structure_class", "bedroom_bucket", "sample_note")


@query("v07_parse_reply", "select conv_id, turn, ai_narrative, confidence from q_outputs")
def _(w):
    return outputs(w).select("conv_id", "turn", "ai_narrative", "confidence")


@query("v08_confidence_report", "select city, persona, output_type, count(*) as total, count(ai_narrative) as with_narrative, " + ", ".join(
    f"count(*) filter (where confidence = '{c}') as {n}" for c, n in (("high", "high_confidence"), ("medium", "medium_confidence"), ("low", "low_confidence"), ("error", "errors"))) + " from q_outputs group by all")
def _(w):
    return serve.confidence_report(outputs(w))


@query("v09_cache_lookup", """
select a.neighbourhood as neighbourhood_cleansed, c.ai_narrative from q_areas a left join (select neighbourhood_cleansed, ai_narrative from q_outputs where trim(ai_narrative) <> ''
 qualify row_number() over (partition by neighbourhood_cleansed order by computed_order desc) = 1) c on c.neighbourhood_cleansed = a.neighbourhood""")
def _(w):
    keys = w["area_shapes"].select(F.col("neighbourhood").alias("neighbourhood_cleansed"))
    return serve.cache_lookup(keys, outputs(w), ["neighbourhood_cleansed"], "computed_order")


@query("v10_cache_append", "select city, 2 * count(*) as n from q_outputs where ai_narrative is not null group by city")
def _(w):
    path = scratch(w)
    rows = outputs(w).where(F.col("ai_narrative").isNotNull()).select("city", "persona", "ai_narrative")
    serve.cache_append(rows, path)
    serve.cache_append(rows, path)
    return w.spark.read.parquet(path).groupBy("city").agg(F.count("*").alias("n"))


@query("v11_pending_work", """
select city, neighbourhood as neighbourhood_cleansed, persona from q_areas cross join (values ('YIELD_MAXIMISER'), ('OCCUPANCY_OPTIMISER'), ('QUALITY_HOST')) p(persona)
where (city, neighbourhood, persona) not in (select (city, neighbourhood_cleansed, persona) from q_outputs where output_type = 'RECOMMENDATION' and ai_narrative is not null)""")
def _(w):
    areas = w["dim_area"].withColumnRenamed("neighbourhood", "neighbourhood_cleansed")
    return serve.pending_work(areas, outputs(w), "RECOMMENDATION")


@query("v11_pending_anew", """
select city, neighbourhood as neighbourhood_cleansed, persona from q_areas cross join (values ('YIELD_MAXIMISER'), ('OCCUPANCY_OPTIMISER'), ('QUALITY_HOST')) p(persona)""")
def _(w):
    areas = w["dim_area"].withColumnRenamed("neighbourhood", "neighbourhood_cleansed")
    return serve.pending_work(areas, outputs(w), "RECOMMENDATION", full=True)


@query("v12_narrative_fields", """
select city, neighbourhood_cleansed, persona, output_type, coalesce(j->>'$.recommendation_summary', j->>'$.investment_summary', j->>'$.summary', 'No recommendation summary available.') as summary,
 j->>'$.key_strengths' as key_strengths, j->>'$.key_risks' as key_risks, j->>'$.confidence' as stated_confidence, j->>'$.recommended_action' as recommended_action
from (select *, case when json_valid(ai_narrative) then ai_narrative end as j from q_outputs where persona = 'QUALITY_HOST' and output_type = 'AREA_OVERVIEW') o""")
def _(w):
    return serve.narrative_fields(outputs(w), {"persona": "quality_host", "output_type": "area_overview"})


@query("r09_to_geojson_feature", f"""
select a.neighbourhood, a.city, m.listing_count, m.avg_adr, m.poi_count, 'Feature' as kind, 'MultiPolygon' as geometry, count(distinct e.ring) as n_rings,
 count(*) + count(distinct e.ring) as n_vertices, {rd('sum(e.x0)', 6)} as sum_x, {rd('sum(e.y0)', 6)} as sum_y
from q_areas a join q_mart_area m using (neighbourhood, city) join q_edges e on e.area_key = a.area_key group by all""")
def _(w):
    features = serve.map_features(w.at("mart_area"))

    def field(name, kind="string"):
        return F.get_json_object("feature", f"$.{name}").cast(kind)

    rings = F.flatten(F.from_json(field("geometry.coordinates"), "array<array<array<array<double>>>>"))

    def total(axis):  # a ring ends where it began
        open_rings = F.transform("rings", lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
        return F.aggregate(F.flatten(open_rings), F.lit(0.0), lambda n, v: n + v[axis])

    return features.withColumn("rings", rings).select(
        field("properties.neighbourhood").alias("neighbourhood"), field("properties.city").alias("city"),
        field("properties.listing_count", "bigint").alias("listing_count"), field("properties.avg_adr", "double").alias("avg_adr"),
        field("properties.poi_count", "bigint").alias("poi_count"), field("type").alias("kind"), field("geometry.type").alias("geometry"),
        F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_vertices"),
        F.round(total(0), 6).alias("sum_x"), F.round(total(1), 6).alias("sum_y"),
    )


# --- refresh jobs ------------------------------------------------------------
def _waiting_sales(w, path: str):
    """Raw sales as a folder of files, one file per year; of row groups of 8 MB, so that a few files are many tasks."""
    rows = w["raw_price_paid"].withColumn("yr", F.left("date_of_transfer", F.lit(4)))
    rows.repartition(7, "yr").write.option("parquet.block.size", 8 << 20).parquet(path)
    return w.spark.read.parquet(path).schema


@query("t01_refresh_incremental", "select neighbourhood, city, structure_class, median_sale_price, avg_sale_price, sale_txn_count from q_area_sales")
def _(w):
    base = scratch(w)
    schema = _waiting_sales(w, f"{base}/in")
    postcode_map = w.at("postcode_area_map")

    def place(batch):
        return star.placed_sales(silver.clean_sales(batch), postcode_map)

    def build(stored):
        return star.area_sales_from_placed(stored)

    stream = refresh.files_stream(w.spark, f"{base}/in", schema, 3)
    refresh.refresh_incremental(stream, f"{base}/store", f"{base}/out", ["neighbourhood", "city"], place, build,
                                f"{base}/chk", unique=["transaction_uid"])
    return refresh.current(w.spark, f"{base}/out", ["neighbourhood", "city"]).select("neighbourhood", "city", "structure_class", "median_sale_price", "avg_sale_price", "sale_txn_count")


@query("t02_append_projection", "select listing_id, calendar_date, available, minimum_nights, maximum_nights from q_calendar")
def _(w):
    base = scratch(w)
    w.at("calendar").repartition(4, "listing_id").write.parquet(f"{base}/in")
    stream = refresh.files_stream(w.spark, f"{base}/in", w.spark.read.parquet(f"{base}/in").schema, 2)
    refresh.append_projection(stream, star.fct_calendar, f"{base}/out", f"{base}/chk")
    return w.spark.read.parquet(f"{base}/out")


@query("t03_refresh_full", "select neighbourhood, structure_class, median_sale_price from q_area_sales")
def _(w):
    path = scratch(w)
    refresh.refresh_full(lambda: w["fct_area_sales"], path)
    refresh.refresh_full(lambda: w["fct_area_sales"], path)
    return w.spark.read.parquet(path).select("neighbourhood", "structure_class", "median_sale_price")
