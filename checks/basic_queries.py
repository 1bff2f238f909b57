"""Single operators: sources, cleaning rules, joins, aggregates, windows, reshapes, space."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import plan_queries, sql, views
from checks.registry import query, scratch
from checks.sql import div, in_values, mean, med, rd, whole
from lettings import rules
from lettings.functions import classify, clean, measures, spatial as geo
from lettings.operators import joins, quantiles, reports, reshape, spatial, windows
from lettings.plans import marts, scores, silver, star
from lettings.sources import files, tables


def by_name(df, names):
    """The columns in any case under the given names."""
    own = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(own[n]).alias(n) for n in names])


MARKED = "case when trim({0}) not in ('', 'NULL', 'null', 'N/A') then trim({0}) end"
CSV_COLS = ["id", "name", "price", "property_type", "bedrooms", "host_response_rate", "amenities"]


# --- sources and sinks -------------------------------------------------------
@query("s01_read_csv_text", "select " + ", ".join(f"{MARKED.format(c)} as {c}" for c in CSV_COLS) + " from q_raw_listings")
def _(w):
    path = scratch(w)
    rows = w["raw_listings"].select(*CSV_COLS).withColumn("even", F.xxhash64("id") % 2 == 0)
    for even, cols in ((True, CSV_COLS), (False, [c.upper() for c in reversed(CSV_COLS)])):  # headers in another order and case
        rows.where(F.col("even") == even).select(*cols).write.mode("append").csv(path, header=True, escape='"', compression="gzip")
    return by_name(files.read_csv_text(w.spark, path), CSV_COLS)


@query("s02_append_by_name", """
select cast(s_suppkey as varchar) as key, s_name as name, cast(null as varchar) as segment from supplier where false union all
select cast(c_custkey as varchar), c_name, c_mktsegment from customer union all select cast(s_suppkey as varchar), s_name, null from supplier""")
def _(w):
    folder = w.sf_dir
    first = views.read(w.spark, folder, "customer").selectExpr("cast(c_custkey as string) as key", "c_name as name", "c_mktsegment as segment")
    later = views.read(w.spark, folder, "supplier").selectExpr("s_name as NAME", "cast(s_suppkey as string) as KEY", "s_acctbal as extra")
    return files.append_by_name([first, later])


SALE_COLS = ["transaction_uid", "price", "date_of_transfer", "postcode", "property_type", "old_new", "duration", "ppd_category_type", "record_status", "county"]


@query("s03_read_csv_positional", "select " + ", ".join(f"{MARKED.format(c)} as {c}" for c in SALE_COLS) + " from q_raw_price_paid")
def _(w):
    path = scratch(w)
    w["raw_price_paid"].select(*SALE_COLS).write.csv(path, header=False, escape='"')
    return files.read_csv_positional(w.spark, path, SALE_COLS)


PATHS = "concat('land/', case when o_orderkey % 2 = 0 then 'pp-' else 'px-' end, cast(1990 + o_orderkey % 30 as string), '.csv')"


@query("s04_match_files", f"select {PATHS} as path, count(*) as n from orders where regexp_full_match({PATHS}, '.*pp-[0-9]{{4}}\\.csv') group by all")
def _(w):
    listed = views.read(w.spark, w.sf_dir, "orders").selectExpr(f"{PATHS} as path")
    return files.match_files(listed, "path").groupBy("path").agg(F.count("*").alias("n"))


SNAPS = ("concat('raw/', cast(c_nationkey as string), '/', case when c_custkey % 7 = 0 then 'snapshot_date=2025-1-1' "
         "else concat('snapshot_date=2025-0', cast(1 + c_custkey % 9 as string), '-15') end, '/f.csv')")


@query("s05_latest_partition", f"""
select city, path, n from (select city, path, n, d, max(d) over (partition by city) as top from (
 select c_nationkey::bigint as city, {SNAPS} as path, max(regexp_extract({SNAPS}, 'snapshot_date=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/', 1)) as d, count(*) as n from customer group by 1, 2) p) g
where d = top and d <> ''""")
def _(w):
    listed = views.read(w.spark, w.sf_dir, "customer").selectExpr("cast(c_nationkey as bigint) as city", f"{SNAPS} as path")
    return files.latest_partition(listed, "city", "path").groupBy("city", "path").agg(F.count("*").alias("n"))


@query("s05_latest_snapshots", f"select city, max(d) as snapshot_date from (select c_nationkey::bigint as city, nullif(regexp_extract({SNAPS}, 'snapshot_date=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/', 1), '') as d from customer) s "
       "group by city having max(d) is not null")
def _(w):
    listed = views.read(w.spark, w.sf_dir, "customer").selectExpr("cast(c_nationkey as bigint) as city", f"{SNAPS} as path")
    dated = listed.join(listed.where(F.col("path").rlike(files.SNAPSHOT)).select("city").distinct(), "city", "left_semi")
    return files.latest_snapshots(dated, "city", "path")


@query("s06_read_geojson", "select city, count(*) as n_features, cast(1 as bigint) as n_documents from q_areas group by city")
def _(w):
    path = scratch(w)
    plan_queries.geojson_documents(w).repartition("_filename").write.option("maxRecordsPerFile", 1).partitionBy("_filename").text(path)
    docs = files.read_geojson(w.spark, path)
    features = reshape.explode_features(docs)
    names = features.join(w["area_shapes"].select("neighbourhood", F.col("_filename").alias("origin")), "neighbourhood")
    return names.groupBy(clean.path_city("origin").alias("city")).agg(
        F.count("*").alias("n_features"), F.countDistinct("_filename").alias("n_documents"))


@query("s07_with_lineage", "select count(*) as n, count(*) as max_row, count(*) as distinct_rows, true as has_file from lineitem")
def _(w):
    numbered = files.with_lineage(views.read(w.spark, w.sf_dir, "lineitem").select("l_orderkey", "_metadata"), "given").drop("_metadata")
    return numbered.agg(F.count("*").alias("n"), F.max("_file_row_number").alias("max_row"),
                        F.countDistinct("_file_row_number").alias("distinct_rows"), F.bool_and(F.col("_filename").endswith("lineitem.parquet")).alias("has_file"))


@query("s08_newest_file", "select concat('f', cast(event_id as string), '.xlsx') as path from events order by ts desc, path desc limit 1")
def _(w):
    listed = views.read(w.spark, w.sf_dir, "events").selectExpr("concat('f', cast(event_id as string), '.xlsx') as path", "ts")
    return files.newest_file(listed, "path", "ts")


@query("s09_land_cells", "select l_orderkey * 10 + l_linenumber as row_no, concat_ws('|', nullif(l_returnflag, 'N'), nullif(l_linestatus, 'O')) as cells from lineitem "
       "where l_orderkey * 10 + l_linenumber > 20 and (l_returnflag <> 'N' or l_linestatus <> 'O')")
def _(w):
    sheet = views.read(w.spark, w.sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as row_no", "nullif(l_returnflag, 'N') as a", "nullif(l_linestatus, 'O') as b")
    return files.land_cells(sheet, ["a", "b"], "row_no", 20).select("row_no", F.array_join("cells", "|").alias("cells"))


@query("s10_snapshot", "select postcode, latitude, longitude, 'shared.postcodes' as _source from q_raw_code_point")
def _(w):
    return files.snapshot(w["raw_code_point"], ["postcode", "latitude", "longitude"], "shared.postcodes").drop("_load_ts")


sql.CTE["q_raw_poi_area"] = sql.inside("q_raw_poi", "id")


@query("s11_scoped_snapshot", "select p.id, p.category, p.longitude, p.latitude, min(a.neighbourhood) as neighbourhood from q_raw_poi p join q_raw_poi_area a using (id) group by all")
def _(w):
    cols = ["id", "category", "longitude", "latitude"]
    return files.scoped_snapshot(w["raw_poi"], w["area_shapes"], "id", cols, "neighbourhood", "shared.pois").drop("_source", "_load_ts")


@query("s12_write_replace", "select c_mktsegment, count(*) as n from customer group by all")
def _(w):
    path = scratch(w)
    df = views.read(w.spark, w.sf_dir, "customer")
    tables.write_replace(df.select("c_mktsegment"), path)
    tables.write_replace(df.select("c_mktsegment"), path)
    return w.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s13_write_append", "select c_mktsegment, 2 * count(*) as n from customer group by all")
def _(w):
    path = scratch(w)
    df = views.read(w.spark, w.sf_dir, "customer").select("c_mktsegment")
    tables.write_append(df, path)
    tables.write_append(df, path)
    return w.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s14_replace_keys", "select c_mktsegment, sum(case when c_mktsegment = 'BUILDING' then 2e0 else 1e0 end) as total from customer group by c_mktsegment")
def _(w):
    path = scratch(w)
    df = views.read(w.spark, w.sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(1.0).alias("v"))
    tables.replace_keys(df, path, ["c_mktsegment"])
    tables.replace_keys(df.where("c_mktsegment = 'BUILDING'").withColumn("v", F.lit(2.0)), path, ["c_mktsegment"])
    return w.spark.read.parquet(path).groupBy("c_mktsegment").agg(F.sum("v").alias("total"))


BAD = "case when o_orderkey % 11 = 0 then concat('bad line ', cast(o_orderkey as string)) end"


@query("s15_load_audit", f"""
select 'RAW_PRICE_PAID' as table_name, o_orderpriority as file_name, case when count(e) = 0 then 'LOADED' when count(e) = count(*) then 'LOAD_FAILED' else 'PARTIALLY_LOADED' end as status,
 count(*) as rows_parsed, count(*) - count(e) as rows_loaded, count(e) as errors_seen, arg_min(e, o_orderkey) filter (where e is not null) as first_error,
 min(o_orderkey) filter (where e is not null) as first_error_line from (select *, {BAD} as e from orders) o group by o_orderpriority""")
def _(w):
    rows = views.read(w.spark, w.sf_dir, "orders").selectExpr("o_orderpriority as f", "o_orderkey as line", f"{BAD} as e")
    return reports.load_audit(rows, "RAW_PRICE_PAID", "f", "line", "e")


@query("s16_clean_audit", "select 'SILVER.CALENDAR' as table_name, 'BRONZE.CALENDAR' as source_table, a.n as rows_in, b.n as rows_out, a.n - b.n as rows_dropped "
       "from (select count(*) as n from q_raw_calendar) a, (select count(*) as n from q_calendar) b")
def _(w):
    return reports.clean_audit("SILVER.CALENDAR", "BRONZE.CALENDAR", w["raw_calendar"], w.at("calendar"))


@query("s17_verify_counts", "select 'listings' as table_name, count(*) as row_count from q_listings union all select 'sales', count(*) from q_sales union all select 'none', 0")
def _(w):
    return reports.verify_counts({"listings": w.at("listings"), "sales": w.at("sales"), "none": None})


@query("s18_check_columns", "select count(*) as n from q_raw_calendar")
def _(w):
    checked = reports.check_columns(w["raw_calendar"], ["listing_id", "date", "is_booked", "minimum_nights", "maximum_nights"])
    return checked.agg(F.count("*").alias("n"))


@query("s19_list_tables", "select 's19_q_' || lower(n_name) as table_name, count(*) as n_customers from nation join customer on c_nationkey = n_nationkey where n_name like 'NATION_1%' group by all")
def _(w):
    customers = views.read(w.spark, w.sf_dir, "customer").join(views.read(w.spark, w.sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    counts = customers.groupBy("n_name").agg(F.count("*").alias("n_customers")).withColumn("table_name", F.concat(F.lit("s19_q_"), F.lower("n_name")))
    for i in range(25):  # one view per nation, as a catalogue has them
        customers.where(F.col("c_nationkey") == i).createOrReplaceTempView(f"s19_q_nation_{i}")
    return tables.list_tables(w.spark, "S19_Q_NATION_1%").join(counts, "table_name").select("table_name", "n_customers")


@query("s19_list_columns", "select 'l_orderkey' as column_name, 'bigint' as data_type, count(l_orderkey) as non_null from lineitem union all "
       "select 'l_linenumber', 'int', count(l_linenumber) from lineitem union all select 'l_quantity', 'double', count(l_quantity) from lineitem")
def _(w):
    df = views.read(w.spark, w.sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    full = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "non_null")
    return tables.list_columns(df).drop("ordinal_position").join(full, "column_name")


@query("s20_values_frame", f"select city, count(*) as areas, max(assumed_lt_gross_yield_pct) as y from q_areas join q_assumptions using (city) group by all")
def _(w):
    constants = joins.values_frame(w.spark, rules.CITY_ASSUMPTIONS, rules.CITY_ASSUMPTION_COLUMNS)
    return w["dim_area"].join(constants, "city").groupBy("city").agg(F.count("*").alias("areas"), F.max("assumed_lt_gross_yield_pct").alias("y"))


@query("s21_date_spine", "select cast(unnest(generate_series(a - interval 30 day, b + interval 30 day, interval 1 day)) as date) as date_key from (select min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders) s")
def _(w):
    days = views.read(w.spark, w.sf_dir, "orders").selectExpr("cast(o_orderdate as date) as d")
    return star.date_spine(days, "d")


# --- cleaning rules ----------------------------------------------------------
def column_query(name: str, source: str, sql_exprs: dict[str, str], spark_exprs, oracle_source: str | None = None) -> None:
    """Per-row rules over a whole raw view, counted by distinct result."""
    inner = ", ".join(f"{e} as {n}" for n, e in sql_exprs.items())
    oracle = f"select {', '.join(sql_exprs)}, count(*) as n from (select {inner} from {oracle_source or 'q_' + source}) r group by all"

    @query(name, oracle)
    def _(w):
        cols = spark_exprs()
        rows = w[source] if source.startswith("raw_") else w.at(source)
        return rows.select(*[c.alias(n) for n, c in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


MONEY, PERCENT, FLAG = sql.MONEY, sql.PERCENT, sql.FLAG
column_query("c01_safe_cast", "raw_listings", {
    "beds": whole("bedrooms"), "rating": "try_cast(review_scores_rating as double)", "scraped": "try_cast(last_scraped as date)", "odd": whole("price")},
    lambda: {"beds": clean.whole("bedrooms"), "rating": clean.number("review_scores_rating"), "scraped": clean.day("last_scraped"), "odd": clean.whole("price")})
column_query("c02_blank_to_null", "raw_listings", {"name": "nullif(trim(name), '')", "bedrooms": "nullif(trim(bedrooms), '')"},
             lambda: {"name": clean.blank_to_null("name"), "bedrooms": clean.blank_to_null("bedrooms")})
column_query("c03_marker_to_null", "raw_listings", {"rate": "case when trim(host_response_rate) not in ('N/A', '') then trim(host_response_rate) end"},
             lambda: {"rate": clean.marker_to_null("host_response_rate", ("N/A", ""))})
column_query("c04_parse_money", "raw_listings", {"price": f"cast({MONEY.format('price')} as double)", "revenue": f"cast({MONEY.format('estimated_revenue_l365d')} as double)"},
             lambda: {"price": clean.parse_money("price"), "revenue": clean.parse_money("estimated_revenue_l365d")})
column_query("c05_parse_percent", "raw_listings", {"pct": PERCENT.format("host_response_rate")}, lambda: {"pct": clean.parse_percent("host_response_rate")})
column_query("c06_parse_flag", "raw_listings", {"flag": FLAG.format("host_is_superhost")}, lambda: {"flag": clean.parse_flag("host_is_superhost")})
column_query("c06_parse_flag_wide", "raw_calendar", {
    "flag": f"case when lower(is_booked) in {in_values(rules.TRUE_WORDS)} then true when lower(is_booked) in {in_values(rules.FALSE_WORDS)} then false end"},
    lambda: {"flag": clean.parse_flag_wide("is_booked")})
column_query("c07_strip_prefix", "raw_listings", {"kind": f"trim(regexp_replace(lower(property_type), '{sql.PREFIX}', ''))"}, lambda: {"kind": clean.strip_room_prefix("property_type")})
column_query("c08_decode", "raw_price_paid", {
    "kind": sql.case_map("upper(property_type)", rules.SALE_PROPERTY_TYPE), "tenure": sql.case_map("duration", rules.SALE_TENURE),
    "status": sql.case_map("record_status", rules.SALE_RECORD_STATUS)},
    lambda: {"kind": clean.decode("property_type", rules.SALE_PROPERTY_TYPE), "tenure": clean.decode("duration", rules.SALE_TENURE),
             "status": clean.decode("record_status", rules.SALE_RECORD_STATUS)})
column_query("c09_property_class", "raw_price_paid", {"class": sql.case_map("upper(property_type)", rules.SALE_PROPERTY_CLASS)}, lambda: {"class": clean.sale_class("property_type")})
column_query("c10_quality_flag", "raw_price_paid", {
    "flag": "case when ppd_category_type = 'B' then 'non_standard' when cast(price as bigint) not between 10000 and 20000000 then 'price_suspect' else 'ok' end"},
    lambda: {"flag": clean.sale_quality("ppd_category_type", clean.whole("price", 12))})
column_query("c11_strip_chars", "raw_price_paid", {"uid": "translate(transaction_uid, '{}', '')"}, lambda: {"uid": clean.strip_chars("transaction_uid", "{}")})
column_query("c12_join_key", "raw_price_paid", {"key": "upper(replace(postcode, ' ', ''))", "name": "lower(trim(county))"},
             lambda: {"key": clean.postcode_key("postcode"), "name": clean.name_key("county")})
column_query("c13_path_city", "raw_listings", {"city": sql.city_of("_filename"), "under": sql.city_of("_filename")},
             lambda: {"city": clean.path_city("_filename"), "under": clean.path_city_under("_filename", "raw/feed")})


@query("c14_require", "select count(*) as n from q_raw_listings where id is not null and estimated_revenue_l365d is not null and latitude between -90 and 90 and longitude between -180 and 180")
def _(w):
    rows = w["raw_listings"].dropna(subset=["id", "estimated_revenue_l365d"]).where(clean.in_world("latitude", "longitude"))
    return rows.agg(F.count("*").alias("n"))


@query("c15_in_list", f"select upper(trim(county)) as county, count(*) as n from q_raw_price_paid where upper(trim(county)) in {in_values(rules.SALE_COUNTIES)} group by all")
def _(w):
    kept = w["raw_price_paid"].where(clean.in_list("county", rules.SALE_COUNTIES))
    return kept.groupBy(clean.code("county").alias("county")).agg(F.count("*").alias("n"))


@query("c16_code_scope", "select c1 as code, count(*) as n from q_rent_scope group by all")
def _(w):
    code = clean.element("cells", 1)
    return w["raw_rent_cells"].where(clean.rent_scope(code)).groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query("c17_geo_level", "select case when c1 like 'E12%' then 'region' else 'district' end as level, count(*) as n from q_rent_sheet group by all")
def _(w):
    return w["raw_rent_cells"].groupBy(clean.geo_level(clean.element("cells", 1)).alias("level")).agg(F.count("*").alias("n"))


sql.CTE["q_booked_raw"] = sql.CTE["q_booked"].rsplit(" qualify ", 1)[0]


@query("c18_plausible_calendar", f"""
select count(*) as n, count(distinct listing_id) as listings from q_booked_raw where listing_id > 0 and date between date '{plan_queries.FIRST}'
 and date '{plan_queries.LAST}' and minimum_nights <= maximum_nights and minimum_nights between 1 and 365 and maximum_nights > 0""")
def _(w):
    typed = reports.typed_calendar(w["raw_calendar"])
    kept = reports.plausible_calendar(typed, plan_queries.FIRST, plan_queries.LAST)
    return kept.agg(F.count("*").alias("n"), F.countDistinct("listing_id").alias("listings"))


@query("c19_plausible_reviews", "select listing_id, count(*) as n from q_reviews_ok group by all")
def _(w):
    kept = reports.plausible_reviews(reports.typed_reviews(w["raw_reviews"]), last="2021-06-30")
    return kept.groupBy("listing_id").agg(F.count("*").alias("n"))


column_query("c20_classify_first_match", "raw_listings", {"label": "case when name like '%ring%' then 'ring' when name in (' red widget ') or name like '%widget%' then 'widget' else 'rest' end"},
             lambda: {"label": classify.first_match(F.col("name"), [rules.Rule("ring", like=("%ring%",)), rules.Rule("widget", exact=(" red widget ",), like=("%widget%",))], F.lit("rest"))})
column_query("c21_poi_group", "raw_poi", {"grp": sql.case_rules("lower(category)", rules.POI_RULES, "null")}, lambda: {"grp": classify.poi_group("category")})
column_query("c22_amenity_group", "listing_amenities", {"raw_amenity": "raw_amenity", "grp": sql.case_rules("lower(raw_amenity)", rules.AMENITY_RULES, "'Other'")},
             lambda: {"raw_amenity": F.col("raw_amenity"), "grp": classify.amenity_group("raw_amenity")}, "q_amenities")
column_query("c23_amenity_simplify", "listing_amenities", {"label": sql.case_rules("lower(raw_amenity)", rules.AMENITY_LABELS, "raw_amenity")},
             lambda: {"label": classify.amenity_label("raw_amenity")}, "q_amenities")
column_query("c24_property_group", "listings", {
    "grp": sql.case_members("property_type", rules.PROPERTY_GROUPS, "'Other / Unknown'"), "class": sql.case_members("property_type", rules.PROPERTY_CLASSES)},
    lambda: {"grp": classify.property_group("property_type"), "class": classify.property_class("property_type")})


@query("c25_group_dim", "select property_group, count(*) as types from q_property_map group by all")
def _(w):
    groups = star.dim_property_group(w.at("property_map")).select("property_group")
    return groups.join(w.at("property_map"), "property_group").groupBy("property_group").agg(F.count("*").alias("types"))


@query("c26_poi_flags", "select amenity_group, is_transport, is_dining, count(*) as n from q_dim_poi group by all")
def _(w):
    return w["dim_poi"].groupBy("amenity_group", "is_transport", "is_dining").agg(F.count("*").alias("n"))


column_query("c27_bedroom_bucket", "listings", {"bucket": sql.BUCKET, "strict": sql.STRICT_BUCKET, "sort": "case when bedrooms is not null then least(bedrooms, 4) end"},
             lambda: {"bucket": measures.bedroom_bucket("bedrooms"), "strict": measures.bedroom_bucket_strict("bedrooms"), "sort": measures.bedroom_sort("bedrooms")})
column_query("c28_rates", "listings", {
    "active": "estimated_occupancy_l365d >= 30", "rate": rd("estimated_occupancy_l365d / 365e0", 4), "revpar": rd("cast(estimated_revenue_l365d as double) / 365e0", 2),
    "has_revenue": "estimated_revenue_l365d is not null"},
    lambda: {"active": measures.is_active("estimated_occupancy_l365d"), "rate": measures.occupancy_rate("estimated_occupancy_l365d"),
             "revpar": measures.revpar("estimated_revenue_l365d"), "has_revenue": F.col("estimated_revenue_l365d").isNotNull()})


@query("c29_like_for_like", "select structure_class, count(*) as n, count(*) filter (where bedrooms >= 1) as with_beds from q_dim_listing where structure_class in ('Flat', 'House') and room_type = 'Entire home/apt' and is_active group by all")
def _(w):
    rows = w.at("mart_listing").where(measures.like_for_like())
    return rows.groupBy("structure_class").agg(F.count("*").alias("n"), F.count_if(F.col("bedrooms") >= 1).alias("with_beds"))


@query("c30_first_available", f"select case when review_scores_rating is not null then 'rating' when estimated_revenue_l365d is not null then 'revenue' else 'price' end as source, "
       f"{rd('sum(cast(coalesce(review_scores_rating, estimated_revenue_l365d, price) as decimal(18,4)))', 2)} as total from q_listings group by all")
def _(w):
    value, source = clean.first_available(
        [("review_scores_rating", "rating"), (F.col("estimated_revenue_l365d").cast("double"), "revenue")], (F.col("price").cast("double"), "price"))
    return w.at("listings").select(value.alias("v"), source.alias("source")).groupBy("source").agg(F.round(measures.exact_sum("v"), 2).alias("total"))


@query("c31_any_measure", "select count(*) as n from q_listings where review_scores_rating is not null or estimated_revenue_l365d is not null")
def _(w):
    return w.at("listings").where(clean.any_measure([F.col("review_scores_rating"), F.col("estimated_revenue_l365d").cast("double")])).agg(F.count("*").alias("n"))


@query("c32_sample_flags", "select host_id, count(*) as n, count(*) >= 5 as enough, count(*) >= 10 as robust, count(*) >= 5 and count(*) >= 15 as gap, "
       "case when count(*) < 3 then ' WARNING: only 1-2 listings — treat with caution' when count(*) < 10 then ' (limited sample — interpret carefully)' else '' end as note from q_listings group by host_id")
def _(w):
    n = w.at("listings").groupBy("host_id").agg(F.count("*").alias("n"))
    return n.select("host_id", "n", measures.sufficient("n").alias("enough"), measures.robust("n").alias("robust"), measures.gap_sample("n", "n").alias("gap"), measures.sample_note("n").alias("note"))


column_query("c33_occupancy_quality", "listings", {
    "q": "case when estimated_occupancy_l365d = 0 then 'ZERO_BOOKINGS' when estimated_occupancy_l365d = 365 then 'FULLY_BOOKED_CHECK' else 'OK' end",
    "c": "case when coalesce(number_of_reviews, 0) = 0 then 'NO_COMMENTS' else 'OK' end"},
    lambda: {"q": measures.occupancy_quality(measures.ratio("estimated_occupancy_l365d", F.lit(365))), "c": measures.comment_coverage("number_of_reviews")})
column_query("c34_date_range_label", "calendar", {"label": "strftime(calendar_date, '%d/%m/%Y') || ' - ' || strftime(calendar_date + interval 5 day, '%d/%m/%Y')"},
             lambda: {"label": measures.date_range_label("calendar_date", F.date_add("calendar_date", 5))})


@query("c35_host_clean", "select distinct host_id, host_name, case when host_response_rate = 'N/A' then 'UNKNOWN' else coalesce(replace(host_response_rate, '%', ''), 'UNKNOWN') end as host_response_rate from q_raw_listings")
def _(w):
    return reports.host_clean(w["raw_listings"].select("host_id", "host_name", "host_response_rate"))


@query("c36_drop_any_null", "select count(*) as n, cast(3 as bigint) as n_columns from q_raw_listings where estimated_revenue_l365d is not null and review_scores_rating is not null")
def _(w):
    rows = w["raw_listings"].select("id", "estimated_revenue_l365d", "review_scores_rating", "name").drop("name").dropna("any")
    return rows.agg(F.count("*").alias("n"), F.lit(len(rows.columns)).alias("n_columns"))


@query("c37_tuple_in", "select listing_id from q_dim_listing where (structure_class, room_type) in (('Flat', 'Private room'), ('House', 'Hotel room'))")
def _(w):
    return joins.tuple_in(w.at("dim_listing"), ["structure_class", "room_type"], [("Flat", "Private room"), ("House", "Hotel room")]).select("listing_id")


@query("c38_select_cases", "select listing_id from q_dim_listing where lower(neighbourhood) = 'nation_3' and lower(structure_class) = 'flat'")
def _(w):
    return joins.select_cases(w.at("dim_listing"), {"neighbourhood": " nation_3", "structure_class": "FLAT"}).select("listing_id")


column_query("c39_display_text", "raw_poi", {"label": "list_aggregate(list_transform(string_split(replace(category, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')"},
             lambda: {"label": measures.display_text("category")})
column_query("c40_money_text", "listings", {"money": "coalesce('£' || format('{:,}', cast(estimated_revenue_l365d as bigint)), 'N/A')", "pct": "coalesce(format('{:.1f}', cast(host_response_rate_pct as double)) || '%', 'N/A')"},
             lambda: {"money": measures.money_text("estimated_revenue_l365d"), "pct": measures.percent_text("host_response_rate_pct")})
column_query("c41_mentions", "raw_reviews", {"hit": "contains(lower(comments), 'tion') or contains(lower(comments), 'les')"}, lambda: {"hit": classify.mentions("comments", ("tion", "les"))})
column_query("c42_clip_upper", "listings", {"v": "cast(case when price is not null then least(price, 1000) end as double)"}, lambda: {"v": measures.clip_upper("price", F.lit(1000))})
column_query("c43_weighted_score", "listings", {"s": sql.re_("(review_scores_rating * 6e-1 + host_response_rate_pct * 4e-1) * 100e0", 2)},
             lambda: {"s": F.bround((F.col("review_scores_rating") * 0.6 + F.col("host_response_rate_pct") * 0.4) * 100.0, 2)})
column_query("c44_month_season", "calendar", {
    "m": "strftime(calendar_date, '%b')", "s": "case when month(calendar_date) in (12, 1, 2) then 'Winter' when month(calendar_date) < 6 then 'Spring' when month(calendar_date) < 9 then 'Summer' else 'Autumn' end"},
    lambda: {"m": measures.month_label(F.month("calendar_date")), "s": measures.season(F.month("calendar_date"))})
column_query("c45_first_argmax", "listings", {"top": "case when bedrooms >= accommodates and bedrooms >= host_id then 'bedrooms' when accommodates >= host_id then 'accommodates' else 'host' end"},
             lambda: {"top": classify.first_argmax([(F.coalesce("bedrooms", F.lit(-1)), "bedrooms"), ("accommodates", "accommodates"), ("host_id", "host")])})


# --- joins -------------------------------------------------------------------
@query("j01_join_inner", "select m.amenity_group, l.neighbourhood, count(*) as n from q_amenities m join q_listings l using (listing_id) group by all")
def _(w):
    both = joins.join_keys(w.at("listing_amenities"), w.at("listings").select("listing_id", "neighbourhood"), ["listing_id"])
    return both.groupBy("amenity_group", "neighbourhood").agg(F.count("*").alias("n"))


@query("j02_join_left", "select l.neighbourhood, count(*) as n, count(r.review_id) as reviews from q_listings l left join q_reviews r using (listing_id) group by all")
def _(w):
    both = joins.join_keys(w.at("listings").select("listing_id", "neighbourhood"), w.at("reviews").select("listing_id", "review_id"), ["listing_id"], "left")
    return both.groupBy("neighbourhood").agg(F.count("*").alias("n"), F.count("review_id").alias("reviews"))


@query("j03_join_on_keys", "select d.listing_id, s.sale_txn_count from q_dim_listing d left join q_area_sales s using (neighbourhood, structure_class)")
def _(w):
    prices = w.at("fct_area_sales").select("neighbourhood", "structure_class", "sale_txn_count")
    return joins.join_keys(w.at("dim_listing"), prices, ["neighbourhood", "structure_class"], "left").select("listing_id", "sale_txn_count")


@query("j04_join_on_constant", "select l.listing_id, s.median_sale_price from q_listings l left join (select * from q_area_sales where structure_class = 'All') s using (neighbourhood)")
def _(w):
    prices = w.at("fct_area_sales").select("neighbourhood", "structure_class", "median_sale_price")
    return joins.join_on_constant(w.at("listings").select("listing_id", "neighbourhood"), prices, ["neighbourhood"], "structure_class", "All").select("listing_id", "median_sale_price")


@query("j05_join_role_twice", """
select h.listing_id, b.annual_rent as bed_rent, k.annual_rent as class_rent from q_bed_homes h
left join q_area_rent b on b.neighbourhood = h.neighbourhood and b.category_type = 'bedroom' and b.rent_category = h.bedroom_bucket
left join q_area_rent k on k.neighbourhood = h.neighbourhood and k.category_type = 'structure' and k.rent_category = h.structure_class""")
def _(w):
    rent = w.at("fct_area_rent")
    bed = rent.where("category_type = 'bedroom'").selectExpr("neighbourhood", "rent_category as bedroom_bucket", "annual_rent as bed_rent")
    cls = rent.where("category_type = 'structure'").selectExpr("neighbourhood", "rent_category as structure_class", "annual_rent as class_rent")
    homes = marts.dwellings(w.at("mart_listing"), w.at("dim_area"), True).withColumn("bedroom_bucket", measures.bedroom_bucket("bedrooms"))
    both = homes.join(bed, ["neighbourhood", "bedroom_bucket"], "left").join(cls, ["neighbourhood", "structure_class"], "left")
    return both.select("listing_id", "bed_rent", "class_rent")


@query("j06_cross_with_small", "select l.neighbourhood, p.persona, count(*) as n from q_listings l cross join (values ('YIELD_MAXIMISER'), ('OCCUPANCY_OPTIMISER'), ('QUALITY_HOST')) p(persona) group by all")
def _(w):
    crossed = joins.cross_with_fixed(w.at("listings").select("neighbourhood"), w.spark, [(p,) for p in rules.PERSONA_SCORES], "persona string")
    return crossed.groupBy("neighbourhood", "persona").agg(F.count("*").alias("n"))


@query("j07_join_range", "select p.id from q_raw_poi p, (select min(x0) as a, max(x0) as b, min(y0) as c, max(y0) as d from q_edges) e where p.longitude between a and b and p.latitude between c and d")
def _(w):
    return spatial.in_extent(w["raw_poi"], w["area_shapes"]).select("id")


@query("j08_point_in_area", "select p.id, a.neighbourhood from q_raw_poi p left join q_raw_poi_area a using (id)")
def _(w):
    return spatial.point_in_area(w["raw_poi"], w["area_shapes"], ["neighbourhood"], "left").select("id", "neighbourhood")


@query("j09_within_distance", "select l.listing_id, count(n.poi_id) as pairs, cast(sum(n.poi_id) as bigint) as poi_sum from q_dim_listing l left join q_near n using (listing_id) group by all")
def _(w):
    pois = w.at("pois").where(F.col("confidence") >= 0.5).selectExpr("poi_id", "longitude as poi_longitude", "latitude as poi_latitude")
    near = spatial.within_distance(w.at("dim_listing").select("listing_id", "longitude", "latitude"), pois, 500.0)
    return near.groupBy("listing_id").agg(F.count("poi_id").alias("pairs"), F.sum("poi_id").alias("poi_sum"))


@query("j10_join_semi", "select listing_id from q_listings where listing_id in (select listing_id from q_amenities)")
def _(w):
    return joins.join_semi(w.at("listings").select("listing_id"), w.at("listing_amenities"), ["listing_id"])


@query("j11_join_anti", "select listing_id from q_listings where listing_id not in (select listing_id from q_amenities)")
def _(w):
    return joins.join_anti(w.at("listings").select("listing_id"), w.at("listing_amenities"), ["listing_id"])


@query("j12_join_latest", "select listing_id, calendar_date from q_calendar where calendar_date = (select max(calendar_date) from q_calendar)")
def _(w):
    return joins.join_latest(w.at("calendar"), "calendar_date").select("listing_id", "calendar_date")


@query("j13_crosswalk", "select l.listing_id, x.ons_area_name, x.rent_grain from q_listings l join q_crosswalk x using (neighbourhood)")
def _(w):
    places = w.at("listings").join(w.at("dim_area").select("neighbourhood", "city"), "neighbourhood")
    city, area = F.col("city"), F.col("neighbourhood")
    return places.select("listing_id", joins.rent_area_name(city, area).alias("ons_area_name"), joins.rent_grain(city, area).alias("rent_grain"))


PICKS = [{"neighbourhood": " nation_3", "city": "LONDON"}, {"neighbourhood": "Nation_1", "city": "Greater Manchester "}, {"neighbourhood": "none", "city": "Bristol"}]


@query("j14_join_selection", "select p.pick as pick_neighbourhood, s.month, s.booked_nights from (values (' nation_3'), ('Nation_1'), ('none')) p(pick) left join q_area_seasonal s on lower(trim(p.pick)) = lower(s.neighbourhood)")
def _(w):
    picks = joins.picks_frame(w.spark, PICKS, ["neighbourhood", "city"])
    return joins.join_selection(picks, w.at("mart_area_seasonal"), ["neighbourhood", "city"], "left").select("pick_neighbourhood", "month", "booked_nights")


# --- aggregates --------------------------------------------------------------
@query("a01_count_distinct", "select neighbourhood, count(*) as n, count(review_scores_rating) as rated, count(distinct host_id) as hosts from q_listings group by all")
def _(w):
    return w.at("listings").groupBy("neighbourhood").agg(F.count("*").alias("n"), F.count("review_scores_rating").alias("rated"), F.countDistinct("host_id").alias("hosts"))


@query("a02_count_when", "select neighbourhood, count(*) filter (where bedrooms >= 3) as big, count(distinct host_id) filter (where bedrooms >= 3) as big_hosts from q_listings group by all")
def _(w):
    big = F.col("bedrooms") >= 3
    return w.at("listings").groupBy("neighbourhood").agg(measures.count_when(big).alias("big"), F.countDistinct(F.when(big, F.col("host_id"))).alias("big_hosts"))


@query("a03_plain", f"select neighbourhood, {rd(mean('price'), 2)} as avg_price, cast(min(price) as double) as low, cast(max(price) as double) as high, cast(sum(number_of_reviews) as bigint) as reviews from q_listings group by all")
def _(w):
    return w.at("listings").groupBy("neighbourhood").agg(
        measures.mean("price", 2).alias("avg_price"), F.min("price").cast("double").alias("low"), F.max("price").cast("double").alias("high"), F.sum("number_of_reviews").alias("reviews"))


@query("a04_median", f"select host_id, {med('price')} as mid_price, {med('price * accommodates')} as mid_total from q_listings group by all")
def _(w):
    return quantiles.medians(w.at("listings"), ["host_id"], {"mid_price": F.col("price"), "mid_total": F.col("price") * F.col("accommodates")})


@query("a05_any_value", "select neighbourhood, max(split_part(_filename, '/', 3)) as segment from q_listings group by all")
def _(w):
    return w.at("listings").groupBy("neighbourhood").agg(F.any_value(F.split_part("_filename", F.lit("/"), F.lit(3))).alias("segment"))


@query("a06_weighted_mean", f"select city, {rd('cast(sum(avg_adr * listing_count) as double) / sum(listing_count)', 6)} as v from q_bedrooms group by all")
def _(w):
    return w.at("mart_bedrooms").groupBy("city").agg(F.round(measures.weighted_mean("avg_adr", "listing_count"), 6).alias("v"))


@query("a07_ratio", f"select neighbourhood, {rd(div('count(*) filter (where bedrooms >= 3)', 'count(*)') + ' * 100e0', 2)} as pct from q_listings group by all")
def _(w):
    return w.at("listings").groupBy("neighbourhood").agg(measures.ratio(F.count_if(F.col("bedrooms") >= 3), F.count("*"), 2, times=100).alias("pct"))


@query("a08_quantile", "select neighbourhood, " + ", ".join(f"{rd(med('estimated_revenue_l365d', p), 6)} as q{int(p * 100)}" for p in (0.25, 0.75, 0.99)) + " from q_listings group by all")
def _(w):
    wanted = {f"q{int(p * 100)}": (F.col("estimated_revenue_l365d"), p) for p in (0.25, 0.75, 0.99)}
    found = quantiles.quantiles(w.at("listings"), ["neighbourhood"], wanted)
    return found.select("neighbourhood", *[F.round(c, 6).alias(c) for c in wanted])


@query("a09_n_unique", "select count(distinct room_type) as room_types, count(distinct property_type) as property_types from q_listings")
def _(w):
    return w.at("listings").agg(F.countDistinct("room_type").alias("room_types"), F.countDistinct("property_type").alias("property_types"))


@query("a10_collect", "select host_id, listing_id, id, count(*) over (partition by host_id) as n from (select host_id, listing_id, listing_id::varchar as id from q_listings) l")
def _(w):
    rows = w.at("listings").select("host_id", "listing_id", F.col("listing_id").cast("string").alias("id"))
    return reshape.values_per_key(rows, ["host_id"], "id", "listing_id").withColumnRenamed("n_values", "n")


@query("a11_string_list_distinct", "select neighbourhood, string_agg(distinct property_group, ', ' order by property_group) as groups, count(distinct property_group) as n_values from q_dim_listing where property_group is not null group by all")
def _(w):
    return reshape.string_list_distinct(w.at("dim_listing"), ["neighbourhood"], "property_group", "groups")


@query("a12_share_when", "select neighbourhood, " + sql.re_("cast(count(*) filter (where instant_bookable) as double) / count(instant_bookable) * 100e0", 4) + " as pct from q_listings group by all")
def _(w):
    return w.at("listings").groupBy("neighbourhood").agg(F.bround(scores.share_when(F.col("instant_bookable")), 4).alias("pct"))


@query("a13_pivot_counts", "select neighbourhood, poi_transport, poi_attractions, poi_dining from q_poi_columns")
def _(w):
    return scores.area_poi_columns(w.at("pois"))


@query("a14_one_hot", "select listing_id, max((raw_amenity = 'Wifi')::int)::bigint as wifi, max((raw_amenity = 'Hot tub')::int)::bigint as hot_tub from q_amenities group by listing_id")
def _(w):
    return reshape.one_hot(w.at("listing_amenities"), ["listing_id"], "raw_amenity", {"wifi": "Wifi", "hot_tub": "Hot tub"})


@query("a14_one_hot_found", "select neighbourhood, cast(max(case when room_type = 'Entire home/apt' then 1 else 0 end) as bigint) as room_type_entire_home_apt, "
       "cast(max(case when room_type = 'Hotel room' then 1 else 0 end) as bigint) as room_type_hotel_room, "
       "cast(max(case when room_type = 'Private room' then 1 else 0 end) as bigint) as room_type_private_room from q_listings group by all")
def _(w):
    return reshape.one_hot_found(w.at("listings"), ["neighbourhood"], "room_type")


@query("a15_rollup_all", "select neighbourhood, structure_class, sale_txn_count from q_area_sales")
def _(w):
    return w["fct_area_sales"].select("neighbourhood", "structure_class", "sale_txn_count")


@query("a16_city_benchmark", f"select city, structure_class, count(*) as city_listing_count, {rd(mean('occupancy_rate'), 4)} as city_avg_occupancy_rate, {med('adr')} as city_median_adr, {med('annual_revenue')} as city_median_annual_revenue from q_homes group by all")
def _(w):
    return marts.city_benchmark(marts.dwellings(w.at("mart_listing"), w.at("dim_area")), ["city", "structure_class"])


@query("a17_group_expr", f"select {sql.BUCKET} as bucket, cast(month(last_scraped) as bigint) as month, count(*) as n from q_listings group by all")
def _(w):
    return w.at("listings").groupBy(measures.bedroom_bucket("bedrooms").alias("bucket"), F.month("last_scraped").alias("month")).agg(F.count("*").alias("n"))


@query("a18_distinct_keys", "select distinct host_id, neighbourhood from q_listings")
def _(w):
    return w.at("listings").select("host_id", "neighbourhood").distinct()


@query("a19_scalar_extent", "select min(calendar_date) as first_day, max(calendar_date) as last_day from q_calendar")
def _(w):
    return w.at("calendar").agg(F.min("calendar_date").alias("first_day"), F.max("calendar_date").alias("last_day"))


PROFILED = {"price": "cast(price as double)", "bedrooms": "bedrooms", "estimated_occupancy_l365d": "estimated_occupancy_l365d"}
_PROFILE = " union all ".join(
    f"select '{c}' as column_name, {rd(f'100e0 * (count(*) - count({c})) / count(*)', 4)} as percent_null, count(distinct {c}) as unique_values, "
    f"{rd(f'max({x}) - min({x})', 4)} as range, {rd(f'avg({x})', 4)} as mean, {rd(f'quantile_cont({x}, 0.5)', 4)} as median, {rd(f'stddev_samp({x})', 4)} as std, "
    f"{rd(f'min({x})', 4)} as min, {rd(f'max({x})', 4)} as max, {rd(f'skewness({x})', 4)} as skew, count(*) filter (where {x} < lo or {x} > hi) as outlier_count "
    f"from q_listings, (select quantile_cont({x}, 0.25) - 15e-1 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) as lo, "
    f"quantile_cont({x}, 0.75) + 15e-1 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) as hi from q_listings) f"
    for c, x in PROFILED.items())


@query("a20_profile", _PROFILE + " union all select 'room_type', 0e0, count(distinct room_type), null, null, null, null, null, null, null, null from q_listings")
def _(w):
    return reports.profile(w.at("listings").select(*PROFILED, "room_type"), digits=4)


@query("a21_null_report", " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from q_listings" for c in ("price", "bedrooms", "review_scores_rating")))
def _(w):
    return reports.null_report(w.at("listings"), ["price", "bedrooms", "review_scores_rating"])


@query("a22_duplicate_report", "select cast(sum(n) as bigint) as total_rows, count(*) as distinct_keys, cast(sum(n) - count(*) as bigint) as duplicate_rows from (select count(*) as n from q_raw_calendar group by listing_id, date) g")
def _(w):
    return reports.duplicate_report(w["raw_calendar"], ["listing_id", "date"])


@query("a23_calendar_by_listing", f"select listing_id, count(*) as total_calendar_days, count(*) filter (where is_booked) as days_booked, {rd(div('count(*) filter (where is_booked)', 'count(*)'), 4)} as occupancy_rate from q_booked group by all")
def _(w):
    unique = windows.dedup_latest(reports.typed_calendar(w["raw_calendar"]), ["listing_id", "date"], [F.col("_file_row_number").asc()])
    return reports.calendar_by_listing(unique).select("listing_id", "total_calendar_days", "days_booked", "occupancy_rate")


sql.CTE["q_season"] = f"""
select neighbourhood, case when month in (12, 1, 2) then 'Winter' when month < 6 then 'Spring' when month < 9 then 'Summer' else 'Autumn' end as season,
 cast(sum(booked_nights) as bigint) as booked_nights, cast(sum(total_nights) as bigint) as total_nights, {div('sum(booked_nights)', 'sum(total_nights)')} as o from q_area_seasonal group by 1, 2"""


@query("a24_season_summary", f"select neighbourhood, season, booked_nights, total_nights, {rd('o', 6)} as occupancy, first_value(season) over (partition by neighbourhood order by o desc, season) as peak_season, first_value(season) over (partition by neighbourhood order by o, season) as trough_season from q_season")
def _(w):
    return reports.season_summary(w.at("mart_area_seasonal"), ["neighbourhood"])


@query("a25_listing_share", f"select city, structure_class, cast(sum(listing_count) as bigint) as listing_count, {rd(mean('avg_adr'), 4)} as avg_adr, {rd('100e0 * sum(listing_count) / sum(sum(listing_count)) over (partition by city)', 4)} as listing_percentage from q_bedrooms group by city, structure_class")
def _(w):
    return reports.listing_share(w.at("mart_bedrooms"), ["city"], "structure_class", ["avg_adr"])


# --- windows, order, sets ----------------------------------------------------
@query("w01_dedup_latest", "select host_id, listing_id, last_scraped from q_listings qualify row_number() over (partition by host_id order by last_scraped desc nulls last, listing_id) = 1")
def _(w):
    rows = w.at("listings").select("host_id", "listing_id", "last_scraped")
    return windows.dedup_latest(rows, ["host_id"], [F.col("last_scraped").desc_nulls_last(), F.col("listing_id").asc()])


@query("w02_rank_by", "select listing_id, row_number() over (order by price desc nulls last, listing_id) as rank from q_listings")
def _(w):
    return windows.rank_by(w.at("listings").select("listing_id", "price"), "price", ["listing_id"]).select("listing_id", "rank")


@query("w03_top_quartile", "select listing_id, segment from q_segments_rev")
def _(w):
    return marts.revenue_segments(w.at("fct_listing"), w.at("listing_amenities")).select("listing_id", "segment")


@query("w03_tiles", "select listing_id, cast(ntile(7) over (partition by host_id order by price desc nulls last, listing_id) as bigint) as tile from q_listings")
def _(w):
    rows = w.at("listings").select("listing_id", "host_id", "price")
    return windows.tiles(rows, ["host_id"], [F.col("price").desc_nulls_last(), F.col("listing_id").asc()], 7, "tile").select("listing_id", "tile")


@query("w04_share_of_partition", f"select neighbourhood, property_group, listing_count, {rd('100e0 * listing_count / sum(listing_count) over (partition by neighbourhood)', 1)} as pct from (select neighbourhood, property_group, count(*) as listing_count from q_dim_listing group by all) g")
def _(w):
    counts = w.at("dim_listing").groupBy("neighbourhood", "property_group").agg(F.count("*").alias("listing_count"))
    return windows.share_of_partition(counts, ["neighbourhood"], "listing_count", "pct")


@query("w05_minmax_by", f"select listing_id, {rd(sql.norm('price'), 6)} as p, {rd(sql.norm('review_scores_rating', True), 6)} as r from (select *, host_id as city from q_listings) l")
def _(w):
    scaled = windows.minmax_by(w.at("listings"), "host_id", {"p": ("price", False), "r": ("review_scores_rating", True)})
    return scaled.select("listing_id", F.round("p", 6).alias("p"), F.round("r", 6).alias("r"))


@query("w06_dedup_first", "select listing_id, date from q_booked")
def _(w):
    typed = reports.typed_calendar(w["raw_calendar"])
    return windows.dedup_latest(typed, ["listing_id", "date"], [F.col("_file_row_number").asc()]).select("listing_id", "date")


@query("l01_order_by", "select neighbourhood, month, booked_nights from q_area_seasonal order by neighbourhood, month desc")
def _(w):
    return w.at("mart_area_seasonal").orderBy(F.asc("neighbourhood"), F.desc_nulls_last("month")).select("neighbourhood", "month", "booked_nights")


@query("l02_top_k", "select listing_id, price::double as price from q_listings order by price desc nulls last, listing_id limit 10")
def _(w):
    return windows.top_k(w.at("listings").select("listing_id", "price"), 10, "price", ["listing_id"])


@query("l03_top_k_per", "select neighbourhood, listing_id from q_listings qualify row_number() over (partition by neighbourhood order by price desc, listing_id) <= 3")
def _(w):
    return windows.top_k_per(w.at("listings").select("neighbourhood", "listing_id", "price"), ["neighbourhood"], 3, [F.col("price").desc_nulls_last(), F.col("listing_id").asc()]).drop("price")


sql.CTE["q_top10"] = "select price::double as p, row_number() over (order by price desc nulls last, listing_id) as r from q_listings qualify r <= 10"


@query("l04_top_bottom", f"select count(*) as listings, {mean('case when r <= 3 then p end')} as avg_top_score, {mean('case when r > 7 then p end')} as avg_bottom_score, {mean('case when r <= 3 then p end')} - {mean('case when r > 7 then p end')} as score_gap from q_top10")
def _(w):
    return windows.top_bottom(w.at("listings"), "price", ["listing_id"])


@query("l05_union_all", "select neighbourhood, count(*) as n from (select neighbourhood from q_listings union all select neighbourhood from q_pois where neighbourhood is not null) u group by all")
def _(w):
    both = w.at("listings").select("neighbourhood").unionByName(w.at("pois").select("neighbourhood").dropna())
    return both.groupBy("neighbourhood").agg(F.count("*").alias("n"))


# --- reshapes ----------------------------------------------------------------
@query("r01_unpivot_blocks", "select category, count(*) as n, sum(rental_price) as total from q_rents group by all")
def _(w):
    rows = reshape.unpivot_blocks(w["raw_rent_cells"].where((F.col("_file_row_number") >= 4) & clean.rent_scope(F.get("cells", 1))))
    return rows.where(clean.any_measure(rules.RENT_MEASURES)).groupBy("category").agg(F.count("*").alias("n"), F.sum("rental_price").alias("total"))


@query("r02_melt", " union all ".join(f"select listing_id, '{lab}' as kind, cast({c} as double) as value from q_listings where {c} is not null" for c, lab in (("price", "Price"), ("estimated_revenue_l365d", "Revenue"))))
def _(w):
    return reshape.melt(w.at("listings").select("listing_id", "price", "estimated_revenue_l365d"), ["listing_id"], {"price": "Price", "estimated_revenue_l365d": "Revenue"}, "kind", "value")


@query("r03_explode_json", "select listing_id, raw_amenity as item, count(*) as n from q_amenity_items group by all")
def _(w):
    return reshape.explode_json(w.at("listings"), "amenities", "item").groupBy("listing_id", "item").agg(F.count("*").alias("n"))


@query("r04_explode_features", "select neighbourhood, coalesce(neighbourhood_group, 'None') as neighbourhood_group from q_areas")
def _(w):
    return reshape.explode_features(plan_queries.geojson_documents(w)).select("neighbourhood", "neighbourhood_group")


@query("r05_json_path", "select json_extract_string(props, '$.k') as k, count(*) as n from events group by all")
def _(w):
    return views.read(w.spark, w.sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("r06_array_size", "select listing_id, count(*) as n, max(raw_amenity) filter (where i = 2) as second from (select *, row_number() over (partition by listing_id) as i from q_amenity_items) a group by listing_id")
def _(w):
    items = F.from_json("amenities", "array<string>")
    rows = w.at("listings").where(items.isNotNull())
    return rows.select("listing_id", F.size(items).alias("n"), clean.element(items, 1).alias("second"))


@query("r07_explode_list", "select listing_id, count(*) as n from q_reviews where trim(comments) <> '' group by all")
def _(w):
    lists = w.at("reviews").select("listing_id", F.array("comments", F.lit(" ")).alias("comments_list"))
    return reshape.explode_list(lists, "comments_list", "comment").groupBy("listing_id").agg(F.count("*").alias("n"))


@query("r08_base_type", "select raw_amenity, base_type, count(*) as n from q_amenities group by all")
def _(w):
    return w.at("listing_amenities").groupBy("raw_amenity", clean.base_type("raw_amenity").alias("base_type")).agg(F.count("*").alias("n"))


@query("r10_cache_key", "select conv_id, string_agg(distinct role, ',' order by role) as key from conversations group by conv_id")
def _(w):
    names = views.read(w.spark, w.sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(F.concat(F.lit(" "), "role")).alias("names"))
    return names.select("conv_id", measures.cache_key("names").alias("key"))


# --- function families and space ---------------------------------------------
column_query("f01_string", "raw_listings", {
    "a": "left(upper(trim(name)), 4)", "b": "length(name)", "c": "replace(name, 'e', 'E')", "d": "split_part(trim(name), ' ', 2)", "e": "name like '%ing%'", "f": "name ilike '%RING%'"},
    lambda: {"a": F.left(F.upper(F.trim("name")), F.lit(4)), "b": F.length("name"), "c": F.replace(F.col("name"), F.lit("e"), F.lit("E")),
             "d": F.split_part(F.trim("name"), F.lit(" "), F.lit(2)), "e": F.col("name").like("%ing%"), "f": F.col("name").ilike("%RING%")})
column_query("f02_date", "calendar", {"d": "calendar_date + 30", "y": "year(calendar_date)", "q": "quarter(calendar_date)", "w": "weekofyear(calendar_date)", "k": "dayofweek(calendar_date)"},
             lambda: {"d": F.date_add("calendar_date", 30), "y": F.year("calendar_date"), "q": F.quarter("calendar_date"), "w": F.weekofyear("calendar_date"), "k": F.dayofweek("calendar_date") - 1})
column_query("f03_math", "listings", {"r": rd("cast(price as double) / 7e0", 2), "l": "cast(least(price, 1000) as double)", "z": "nullif(bedrooms, 0)", "c": "coalesce(bedrooms, -1)"},
             lambda: {"r": F.round(F.col("price").cast("double") / 7.0, 2), "l": F.least("price", F.lit(1000)), "z": F.nullif("bedrooms", F.lit(0)), "c": F.coalesce("bedrooms", F.lit(-1))})
column_query("f04_conditional", "listings", {"a": "case when bedrooms > 2 then 'big' when bedrooms > 0 then 'small' else 'none' end", "b": "bedrooms > 2 and accommodates > 4"},
             lambda: {"a": F.when(F.col("bedrooms") > 2, "big").when(F.col("bedrooms") > 0, "small").otherwise("none"), "b": (F.col("bedrooms") > 2) & (F.col("accommodates") > 4)})


@query("g01_make_point", "select listing_id, longitude as x, latitude as y from q_listings")
def _(w):
    return w.at("dim_listing").select("listing_id", F.col("geo_point.x").alias("x"), F.col("geo_point.y").alias("y"))


@query("g02_parse_boundary", "select neighbourhood, cast(8 as bigint) as n_edges, cast(2 as bigint) as n_rings from q_areas")
def _(w):
    text = F.to_json(geo.boundary_json("boundary"))
    parsed = w["area_shapes"].select("neighbourhood", geo.parse_boundary(text).alias("b"))
    return parsed.select("neighbourhood", F.size(geo.edges("b")).alias("n_edges"), F.size(F.get("b", 0)).alias("n_rings"))


@query("g03_bounds", "select neighbourhood, min(x0) as xmin, max(x0) as xmax, min(y0) as ymin, max(y0) as ymax from q_edges group by all")
def _(w):
    return w["area_shapes"].select("neighbourhood", geo.bounds("boundary").alias("b")).select("neighbourhood", "b.*")


@query("g04_contains", "select neighbourhood, count(*) as inside from q_raw_poi_area group by all")
def _(w):
    return spatial.point_in_area(w["raw_poi"], w["area_shapes"], ["neighbourhood"]).groupBy("neighbourhood").agg(F.count("*").alias("inside"))


@query("g05_distance_m", f"select a.listing_id, {rd(sql.HAVERSINE, 3)} as metres from q_listings a join (select *, listing_id + 1 as prev from q_listings) b on a.listing_id = b.prev")
def _(w):
    rows = w.at("listings").select("listing_id", "longitude", "latitude")
    prev = rows.select((F.col("listing_id") + 1).alias("listing_id"), F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return rows.join(prev, "listing_id").select("listing_id", F.round(geo.distance_m("longitude", "latitude", "x", "y"), 3).alias("metres"))


@query("g06_area_sqkm", f"select neighbourhood, {rd('area_sqkm', 6)} as area_sqkm from q_sizes")
def _(w):
    return w["area_shapes"].select("neighbourhood", F.round(geo.area_sqkm("boundary"), 6).alias("area_sqkm"))


@query("g07_centroid", f"select neighbourhood, {rd('x + 15e-3', 6)} as lon, {rd('y + 1e-2', 6)} as lat from q_areas")
def _(w):
    centre = geo.centroid("boundary")
    return w["area_shapes"].select("neighbourhood", F.round(centre["x"], 6).alias("lon"), F.round(centre["y"], 6).alias("lat"))


@query("g08_density", f"select l.neighbourhood, {rd(div('l.n', 'z.area_sqkm'), 2)} as density from (select neighbourhood, count(*) as n from q_listings group by all) l join q_sizes z using (neighbourhood)")
def _(w):
    n = w.at("listings").groupBy("neighbourhood").agg(F.count("*").alias("n"))
    return n.join(w["area_shapes"], "neighbourhood").select("neighbourhood", measures.ratio("n", "area_sqkm", 2).alias("density"))


@query("g09_points_in_area_counts", "select in_area as neighbourhood, count(*) as poi_count, count(*) filter (where is_transport) as transport_count, count(*) filter (where is_dining) as dining_count from q_area_poi group by all")
def _(w):
    return spatial.points_in_area_counts(w.at("dim_poi"), w.at("dim_area"), "neighbourhood", star.poi_counters())


@query("g10_nearby_counts", "select listing_id, poi_count_500m, transport_count_500m, dining_count_500m from q_listing_poi")
def _(w):
    return spatial.nearby_counts(w.at("dim_listing"), "listing_id", w.at("dim_poi"), star.poi_counters("_500m"), rows=64)
