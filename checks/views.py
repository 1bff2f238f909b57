"""The given tables seen as letting data.

Each view is a list of select expressions over one table.  The same text runs in
Spark and in the checking engine; fractions carry an exponent so that both read
them as doubles.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettings.functions import spatial as geo
from lettings.operators.spatial import ENOUGH_PARTS, fixed_parts
from lettings.plans.build import Lazy
from lettings.session import shared_folder
from lettings.sources import files, tables

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "conversations", "labels",
)


def area_name(key: str) -> str:
    return f"concat('NATION_', cast({key} as string), case when {key} % 6 = 4 then ' District' else '' end)"


def city_segment(key: str) -> str:
    return f"case {key} % 3 when 0 then 'london' when 1 then 'greater_manchester' else 'bristol' end"


def city_name(key: str) -> str:
    return f"case {key} % 3 when 0 then 'London' when 1 then 'Greater Manchester' else 'Bristol' end"


PART_AREA = "(p_partkey % 25)"
LISTINGS = [
    "cast(p_partkey as string) as id", "cast(p_partkey % 97 as string) as host_id",
    "concat(' ', p_name, ' ') as name", "concat('https://rooms/', cast(p_partkey as string)) as listing_url",
    "concat('$', cast(cast(floor(p_retailprice) + p_size * 7 as bigint) as string), '.00') as price",
    "case p_partkey % 7 when 0 then 'Entire rental unit' when 1 then 'Entire home' when 2 then 'Private room in condo' "
    "when 3 then 'Entire loft' when 4 then 'Shared room in hostel' when 5 then 'Entire townhouse' else 'Boat' end as property_type",
    "case when p_partkey % 8 = 3 then 'Private room' when p_partkey % 29 = 0 then 'Hotel room' else 'Entire home/apt' end as room_type",
    "case when p_size % 9 = 0 then '' else cast(p_size % 6 as string) end as bedrooms",
    "cast(1 + p_size % 8 as string) as accommodates",
    "case when p_partkey % 11 = 0 then 'N/A' else concat(cast(p_partkey % 101 as string), '%') end as host_response_rate",
    "concat(cast(p_partkey % 89 as string), '%') as host_acceptance_rate",
    "concat('Host ', cast(p_partkey % 97 as string)) as host_name",
    "case p_partkey % 5 when 0 then 't' when 1 then 'f' when 2 then 'T' when 3 then ' f ' else 'x' end as host_is_superhost",
    "case p_partkey % 4 when 0 then 't' else 'f' end as instant_bookable",
    "cast((p_partkey * 31) % 366 as string) as estimated_occupancy_l365d",
    "case when p_partkey % 3 = 0 then null else concat('$', cast((p_partkey * 53) % 60000 as string), '.00') end as estimated_revenue_l365d",
    "case when p_partkey % 8 = 0 then null else cast(3 + (p_partkey % 20) / 10e0 as string) end as review_scores_rating",
    "cast(2 + (p_partkey % 30) / 10e0 as string) as review_scores_cleanliness",
    "cast((p_partkey * 19) % 300 as string) as number_of_reviews",
    "case when p_partkey % 13 = 0 then 'bad json' when p_partkey % 3 = 0 then "
    "'[\"Wifi\",\"Free parking on premises\",\"Dishwasher\",\"Wifi\"]' else "
    "'[\"Hair dryer\",\"Clothing storage: wardrobe\",\"Dedicated workspace\",\"Hot tub\",\"Sea view – full\",\"Ice cream\"]' end as amenities",
    f"cast(51.4e0 + 2e-2 * floor({PART_AREA} / 5e0) + 2e-2 * (((p_partkey * 7) % 97) + 5e-1) / 97e0 as double) as latitude",
    f"cast(-2e-1 + 3e-2 * ({PART_AREA} % 5) + 3e-2 * (((p_partkey * 13) % 89) + 5e-1) / 89e0 as double) as longitude",
    f"{area_name(PART_AREA)} as neighbourhood_cleansed",
    "cast(date_add(cast('2024-01-01' as date), cast(p_partkey % 200 as int)) as string) as last_scraped",
    f"concat('raw/feed/', {city_segment(PART_AREA)}, '/listings.csv') as _filename",
    "p_partkey as _file_row_number",
]
CALENDAR = [
    "cast(l_partkey as string) as listing_id", "cast(cast(l_shipdate as date) as string) as date",
    "case l_returnflag when 'R' then 'f' when 'A' then 't' else case when l_linenumber % 2 = 0 then 'f' else 't' end end as available",
    "case l_returnflag when 'R' then 'True' when 'A' then '0' else case when l_linenumber % 3 = 0 then 'maybe' else 'yes' end end as is_booked",
    "cast(l_linenumber as string) as minimum_nights", "cast(cast(l_quantity as bigint) as string) as maximum_nights",
    "l_orderkey * 10 + l_linenumber as _file_row_number", "l_extendedprice as _spread",
]
SALES = [
    "concat('{', cast(o_orderkey as string), '}') as transaction_uid",
    "cast(cast(floor(o_totalprice) as bigint) as string) as price",
    "concat(cast(cast(o_orderdate as date) as string), ' 00:00') as date_of_transfer",
    "concat('AB', cast(o_custkey % 90 as string), ' ', cast(o_custkey % 9 as string), 'XY') as postcode",
    "case o_orderkey % 5 when 0 then 'D' when 1 then 's' when 2 then 'T' when 3 then 'F' else 'O' end as property_type",
    "case when o_orderkey % 3 = 0 then 'Y' else 'N' end as old_new",
    "case o_orderkey % 4 when 0 then 'F' when 1 then 'L' when 2 then 'U' else 'Z' end as duration",
    "case when o_orderkey % 5 = 4 or o_orderkey % 10 = 1 then 'B' else 'A' end as ppd_category_type",
    "case o_orderkey % 7 when 0 then 'C' when 1 then 'D' else 'A' end as record_status",
    "case o_orderkey % 4 when 0 then ' Greater London' when 1 then 'GREATER MANCHESTER' when 2 then 'CITY OF BRISTOL' else 'KENT' end as county",
]
POSTCODES = [
    "concat('AB', cast(c_custkey % 90 as string), ' ', cast(c_custkey % 9 as string), 'XY') as postcode",
    "cast(51.4e0 + 1e-1 * (((c_custkey % 90) * 11) % 90 + 5e-1) / 90e0 as double) as latitude",
    "cast(-2e-1 + 15e-2 * (((c_custkey % 90) * 7) % 90 + 5e-1) / 90e0 as double) as longitude",
    "cast(10 + c_custkey % 5 as string) as positional_quality_indicator", "c_custkey as _file_row_number",
]
POIS = [
    "event_id as id",
    "case event_id % 8 when 0 then 'train_station' when 1 then 'italian_restaurant' when 2 then 'museum' when 3 then 'park' "
    "when 4 then 'parking' when 5 then 'gym' when 6 then 'transportation' else 'barber' end as category",
    "((event_id * 37) % 101) / 100e0 as confidence",
    "cast(51.4e0 + 1e-1 * (((event_id * 17) % 991) + 5e-1) / 991e0 as double) as latitude",
    "cast(-2e-1 + 15e-2 * (((event_id * 29) % 983) + 5e-1) / 983e0 as double) as longitude",
    "case when event_id % 50 = 0 then '' else concat('POI ', cast(event_id as string)) end as name",
]
REVIEWS = [
    "cast(doc_id as string) as id", "cast(doc_id % 200 as string) as listing_id",
    "cast(doc_id % 61 as string) as reviewer_id", "text as comments", "concat(' ', source) as reviewer_name",
    "cast(date_add(cast('2020-01-01' as date), cast(doc_id % 700 as int)) as string) as date",
    "doc_id as _file_row_number",
]
AREAS = [
    "n_nationkey as area_key", f"{area_name('n_nationkey')} as neighbourhood",
    "case when n_nationkey % 4 = 0 then 'None' else concat('Group ', cast(n_regionkey as string)) end as neighbourhood_group",
    f"concat('raw/feed/', {city_segment('n_nationkey')}, '/neighbourhoods.geojson') as _filename",
    "-2e-1 + 3e-2 * (n_nationkey % 5) as x", "51.4e0 + 2e-2 * floor(n_nationkey / 5e0) as y",
]
RENT_BASE = [
    "n_nationkey as n", "m", "concat('2025-0', cast(m as string), '-01 00:00:00') as c0",
    "case when n_nationkey = 0 then 'E06000023' when n_nationkey <= 10 then concat('E080000', case when n_nationkey < 10 then '0' else '' end, "
    "cast(n_nationkey as string)) when n_nationkey = 24 then 'E12000007' when n_nationkey = 23 then 'W06000001' "
    "else concat('E090000', cast(n_nationkey as string)) end as c1",
    "case n_nationkey when 0 then 'Bristol, City of' when 10 then 'Manchester' else n_name end as c2",
    "case when n_nationkey % 3 = 0 then '[z]' else ' South ' end as c3",
]
RENT_BLOCKS = [
    expr
    for b in range(9)
    for expr in (
        f"case when n_nationkey % 7 = {b % 7} then '[x]' else cast(100 + {b} + m as string) end as c{4 + 4 * b}",
        f"case when n_nationkey % 7 = {b % 7} then '[x]' else cast(n_nationkey % 5 as string) end as c{5 + 4 * b}",
        f"case when n_nationkey % 7 = {b % 7} then '[x]' else cast(m * 2 as string) end as c{6 + 4 * b}",
        f"case when n_nationkey % 7 = {b % 7} or (n_nationkey + {b}) % 6 = 0 then '[z]' "
        f"else cast(900 + n_nationkey * 10 + m + {b} * 37 as string) end as c{7 + 4 * b}",
    )
]
RENTS = [*RENT_BASE, *RENT_BLOCKS, "n_nationkey * 3 + m + 3 as _file_row_number"]
RENT_CELLS = [f"c{i}" for i in range(40)]
CONV_AREA = "(conv_id % 25)"
OUTPUTS = [
    "conv_id", "turn", f"{city_name(CONV_AREA)} as city", f"{area_name(CONV_AREA)} as neighbourhood_cleansed",
    "case turn % 3 when 0 then 'YIELD_MAXIMISER' when 1 then 'OCCUPANCY_OPTIMISER' else 'QUALITY_HOST' end as persona",
    "case when turn % 2 = 0 then 'AREA_OVERVIEW' else 'RECOMMENDATION' end as output_type",
    "case conv_id % 5 when 0 then null when 1 then text when 2 then concat('```json\n{\"summary\": \"s', cast(conv_id as string), "
    "'\", \"confidence\": \"high\"}\n```') when 3 then concat('{\"investment_summary\": \"i', cast(conv_id as string), "
    "'\", \"key_risks\": \"r', cast(turn as string), '\"}') else concat('  {\"recommendation_summary\": \"p', cast(turn as string), "
    "'\", \"confidence\": \"low\"}') end as reply",
    "cast((conv_id * 37 + turn * 11) % 1000 as double) / 10e0 as investment_score",
    "conv_id * 100 + turn as computed_order",
]
# view -> (table, expressions, distinct)
VIEWS = {
    "raw_listings": ("part", LISTINGS), "raw_calendar": ("lineitem", CALENDAR),
    "raw_price_paid": ("orders", SALES), "raw_code_point": ("customer", POSTCODES),
    "raw_poi": ("events", POIS), "raw_reviews": ("documents", REVIEWS), "raw_areas": ("nation", AREAS),
    "raw_outputs": ("conversations", OUTPUTS),
}
SQUARE = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
HOLE = ((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4))
# words that occur in the given texts, in place of the review keywords
TEST_WORDS = {
    "price": ("whst", "oiai"), "cleanliness": ("ment",), "location": ("tion", "les"), "checkin": ("the", "ing"),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# a few MB of these give long rows that are slow to clean, and a file of few splits would be few tasks
DEALT = {"raw_listings": "p_partkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS[name]
    rows = read(spark, sf_dir, table)
    if name in DEALT:
        rows = fixed_parts(rows, DEALT[name], enough=ENOUGH_PARTS)
    return rows.selectExpr(*exprs)


def boundary(areas: DataFrame) -> DataFrame:
    """Squares with a square hole as nested arrays."""
    def ring(corners):
        return F.array(*[
            F.struct(
                (F.col("x") + F.lit(3e-2) * F.lit(float(a))).alias("x"),
                (F.col("y") + F.lit(2e-2) * F.lit(float(b))).alias("y"),
            )
            for a, b in corners
        ])

    return areas.withColumn("boundary", F.array(F.array(ring(SQUARE), ring(HOLE))))


def area_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = boundary(view(spark, sf_dir, "raw_areas"))
    group = F.when(F.col("neighbourhood_group") != "None", F.col("neighbourhood_group"))
    return shapes.select(
        "neighbourhood", group.alias("neighbourhood_group"), "boundary",
        geo.area_sqkm("boundary").alias("area_sqkm"), "_filename",
    )


def rent_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = spark.createDataFrame([(1,), (2,), (3,)], "m int")
    return read(spark, sf_dir, "nation").crossJoin(F.broadcast(months)).selectExpr(*RENTS)


def rent_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = rent_sheet(spark, sf_dir).select(*RENT_CELLS, "_file_row_number")
    return files.land_cells(sheet, RENT_CELLS, "_file_row_number", 2)


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of an earlier layer: written once per session, then read."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/{app}/{sf_dir.strip('/').replace('/', '-')}/{name}"
        tables.write_replace(make(), path)
        _STORED[key] = spark.read.parquet(path)
    return _STORED[key]


def world(spark: SparkSession, sf_dir: str) -> Lazy:
    """All raw views; cleaned tables and marts derive from them on demand."""
    keep = partial(stored, spark, sf_dir)
    makers = {name: partial(view, spark, sf_dir, name) for name in VIEWS}
    makers["area_shapes"] = lambda: keep("area_shapes", lambda: area_shapes(spark, sf_dir))
    makers["raw_neighbourhoods"] = lambda: view(spark, sf_dir, "raw_areas").select("neighbourhood", "neighbourhood_group")
    makers["raw_rent_cells"] = lambda: keep("raw_rent_cells", lambda: rent_cells(spark, sf_dir))
    found = Lazy({}, spark, makers, keep)
    found.sf_dir = sf_dir
    return found
