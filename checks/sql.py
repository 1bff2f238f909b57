"""Common table expressions of the checking SQL and the text builder."""

from __future__ import annotations

import re

from checks import views
from lettings import rules

CTE: dict[str, str] = {}
NAME = re.compile(r"\bq_[a-z_0-9]+\b")


def build(select: str) -> str:
    """The select with every table expression it needs, in order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in NAME.findall(text):
            if name not in order and name in CTE:
                need(CTE[name])
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    return "with " + ",\n".join(f"{n} as ({CTE[n]})" for n in order) + "\n" + select


def rd(x: str, digits: int) -> str:
    """Half away from zero on the decimal text of a double."""
    return f"cast(round(cast({x} as decimal({'28,8' if digits <= 4 else '38,14'})), {digits}) as double)"


def re_(x: str, digits: int) -> str:
    return f"cast(round_even(cast({x} as double), {digits}) as double)"


def mean(x: str, scale: int = 4) -> str:
    """Exact sum over the count, for values of so many decimals."""
    return f"(cast(sum(cast({x} as decimal({14 + scale},{scale}))) as double) / count({x}))"


def med(x: str, p: float = 0.5) -> str:
    return f"quantile_cont(cast({x} as double), {p})"


def div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0e0))"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_values(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case_rules(text: str, branches, default: str) -> str:
    """CASE text of an ordered classifier."""
    parts = []
    for r in branches:
        tests = [f"{text} like {quote(p)}" for p in r.like]
        tests += [f"({text} like {quote(p)} and {text} not like {quote(g)})" for p, g in r.guarded]
        if r.exact:
            tests.append(f"{text} in {in_values(r.exact)}")
        parts.append(f"when {' or '.join(tests)} then {quote(r.label)}")
    return f"case {' '.join(parts)} else {default} end"


def case_map(key: str, labels: dict, default: str = "null") -> str:
    parts = " ".join(f"when {key} = {quote(k)} then {quote(v)}" for k, v in labels.items())
    return f"case {parts} else {default} end"


def case_members(text: str, groups: dict, default: str = "null") -> str:
    parts = " ".join(f"when {text} in {in_values(m)} then {quote(g)}" for g, m in groups.items())
    return f"case {parts} else {default} end"


def city_of(path: str) -> str:
    return case_map(f"lower(split_part({path}, '/', 3))", rules.CITY_BY_SEGMENT)


CITIES = ", ".join(
    f"({quote(c)}, {n}, cast({y} as double), {r}, {s}, {l})" for c, n, y, r, s, l in rules.CITY_ASSUMPTIONS
)
for _name, (_table, _exprs) in views.VIEWS.items():
    CTE[f"q_{_name}"] = f"select {', '.join(_exprs)} from {_table}"
CTE["q_rent_sheet"] = (
    f"select {', '.join(views.RENTS)} from nation cross join (values (1), (2), (3)) as t(m)"
)

BUCKET = "case when bedrooms >= 4 then '4+' else cast(bedrooms as string) end"
STRICT_BUCKET = "case when bedrooms >= 4 then '4+' when bedrooms in (1, 2, 3) then cast(bedrooms as string) end"
FLAG = "case lower(trim({0})) when 't' then true when 'f' then false end"
MONEY = "try_cast(replace(replace({0}, '$', ''), ',', '') as decimal(12,2))"
PERCENT = "cast(try_cast(replace({0}, '%', '') as decimal(5,0)) as bigint)"


def whole(c: str) -> str:
    return f"cast(try_cast({c} as decimal(10,0)) as bigint)"


PREFIX = rules.ROOM_PREFIX_PATTERN
CTE["q_listings"] = f"""
select cast(id as bigint) as listing_id, cast(host_id as bigint) as host_id, nullif(trim(name), '') as name,
 listing_url, amenities, trim(regexp_replace(lower(nullif(trim(property_type), '')), '{PREFIX}', '')) as property_type,
 room_type, neighbourhood_cleansed as neighbourhood, {MONEY.format('price')} as price, {whole('bedrooms')} as bedrooms,
 {whole('accommodates')} as accommodates, {PERCENT.format('host_response_rate')} as host_response_rate_pct,
 {PERCENT.format('host_acceptance_rate')} as host_acceptance_rate_pct, host_name,
 {FLAG.format('host_is_superhost')} as host_is_superhost, {FLAG.format('instant_bookable')} as instant_bookable,
 {whole('estimated_occupancy_l365d')} as estimated_occupancy_l365d,
 {MONEY.format('estimated_revenue_l365d')} as estimated_revenue_l365d,
 try_cast(review_scores_rating as double) as review_scores_rating,
 try_cast(review_scores_cleanliness as double) as review_scores_cleanliness,
 {whole('number_of_reviews')} as number_of_reviews, latitude, longitude, cast(last_scraped as date) as last_scraped, _filename
from q_raw_listings where latitude between -90 and 90 and longitude between -180 and 180"""
CTE["q_calendar"] = """
select cast(listing_id as bigint) as listing_id, cast(date as date) as calendar_date, available = 't' as available,
 cast(minimum_nights as bigint) as minimum_nights, cast(maximum_nights as bigint) as maximum_nights
from q_raw_calendar qualify row_number() over (partition by listing_id, date order by _file_row_number) = 1"""
CTE["q_reviews"] = """
select cast(id as bigint) as review_id, cast(listing_id as bigint) as listing_id, cast(reviewer_id as bigint) as reviewer_id,
 cast(date as date) as review_date, nullif(trim(reviewer_name), '') as reviewer_name, nullif(trim(comments), '') as comments
from q_raw_reviews qualify row_number() over (partition by id order by _file_row_number) = 1"""
CTE["q_sales"] = f"""
select trim(translate(transaction_uid, '{{}}', '')) as transaction_uid, cast(price as double) as price,
 cast(left(date_of_transfer, 10) as date) as date_of_transfer, postcode, trim(county) as county,
 upper(property_type) as property_type_code, {case_map('upper(property_type)', rules.SALE_PROPERTY_TYPE)} as property_type,
 {case_map('upper(property_type)', rules.SALE_PROPERTY_CLASS)} as property_class,
 {case_map('old_new', rules.SALE_BUILD_STATUS)} as build_status, {case_map('duration', rules.SALE_TENURE)} as tenure,
 {case_map('ppd_category_type', rules.SALE_CATEGORY)} as ppd_category,
 {case_map('record_status', rules.SALE_RECORD_STATUS)} as record_status,
 case when ppd_category_type = 'B' then 'non_standard' when cast(price as bigint) not between 10000 and 20000000
  then 'price_suspect' else 'ok' end as quality_flag
from q_raw_price_paid where upper(trim(county)) in {in_values(rules.SALE_COUNTIES)} and cast(price as bigint) > 0"""
CTE["q_areas"] = f"""
select area_key, neighbourhood, nullif(neighbourhood_group, 'None') as neighbourhood_group, _filename,
 {city_of('_filename')} as city, x, y from q_raw_areas"""
CTE["q_edges"] = """
select area_key, neighbourhood, city, ring, x + 3e-2 * a0 as x0, y + 2e-2 * b0 as y0, x + 3e-2 * a1 as x1, y + 2e-2 * b1 as y1
from q_areas cross join (values (0,0e0,0e0,1e0,0e0),(0,1e0,0e0,1e0,1e0),(0,1e0,1e0,0e0,1e0),(0,0e0,1e0,0e0,0e0),
 (1,4e-1,4e-1,6e-1,4e-1),(1,6e-1,4e-1,6e-1,6e-1),(1,6e-1,6e-1,4e-1,6e-1),(1,4e-1,6e-1,4e-1,4e-1)) as u(ring,a0,b0,a1,b1)"""
R2 = rules.EARTH_RADIUS_M ** 2 / 2e6
CTE["q_sizes"] = f"""
select area_key, neighbourhood, city, sum(case when ring = 0 then s else -s end) as area_sqkm from (
 select area_key, neighbourhood, city, ring, abs(sum((radians(x1) - radians(x0)) * (2e0 + sin(radians(y0)) + sin(radians(y1))))) * {R2!r} as s
 from q_edges group by all) r group by all"""
CROSSES = "((e.y0 > p.latitude) <> (e.y1 > p.latitude)) and p.longitude < (e.x1 - e.x0) * (p.latitude - e.y0) / (e.y1 - e.y0) + e.x0"


def inside(points: str, key: str) -> str:
    return (
        f"select p.{key}, e.neighbourhood, e.city from {points} p cross join q_edges e where {CROSSES} "
        "group by all having count(*) % 2 = 1"
    )


CTE["q_poi_kept"] = f"""
select id as poi_id, nullif(trim(name), '') as name, lower(category) as category, confidence, latitude, longitude,
 {case_rules('lower(category)', rules.POI_RULES, 'null')} as amenity_group from q_raw_poi
where trim(name) <> '' and amenity_group is not null"""
CTE["q_poi_area"] = inside("q_poi_kept", "poi_id")
CTE["q_pois"] = """
select k.*, a.neighbourhood, g.neighbourhood_group from q_poi_kept k left join q_poi_area a using (poi_id)
left join q_areas g on g.neighbourhood = a.neighbourhood"""
CTE["q_postcodes"] = """
select upper(replace(postcode, ' ', '')) as postcode_key, postcode, latitude, longitude, positional_quality_indicator
from q_raw_code_point qualify row_number() over (partition by upper(replace(postcode, ' ', '')) order by postcode, _file_row_number) = 1"""
CTE["q_postcode_map"] = inside("q_postcodes", "postcode_key")
CTE["q_property_map"] = f"""
select distinct property_type, {case_members('property_type', rules.PROPERTY_GROUPS, quote(rules.OTHER_PROPERTY_GROUP))} as property_group,
 {case_members('property_type', rules.PROPERTY_CLASSES)} as property_class from q_listings where property_type is not null"""
CTE["q_amenity_items"] = """
select listing_id, trim(item) as raw_amenity from (
 select listing_id, unnest(json_extract_string(case when json_valid(amenities) then amenities else '[]' end, '$[*]')) as item from q_listings) u"""
CTE["q_amenities"] = f"""
select distinct listing_id, raw_amenity, trim(split_part(split_part(raw_amenity, ':', 1), ' – ', 1)) as base_type,
 {case_rules('lower(raw_amenity)', rules.AMENITY_RULES, quote(rules.OTHER_AMENITY_GROUP))} as amenity_group
from q_amenity_items where raw_amenity <> ''"""
CTE["q_rent_scope"] = """
select *, cast(left(c0, 10) as date) as period from q_rent_sheet where _file_row_number >= 4
 and (c1 = 'E06000023' or c1 between 'E08000001' and 'E08000010' or c1 like 'E09%' or c1 = 'E12000007')"""
CTE["q_rents"] = " union all ".join(
    f"select period, c1 as area_code, c2 as area_name, case when c3 <> '[z]' then trim(c3) end as region_name, "
    f"case when c1 like 'E12%' then 'region' else 'district' end as geo_level, {quote(cat)} as category, {quote(kind)} as category_type, "
    f"{quote(cls) if cls else 'null'} as property_class, try_cast(c{i} as double) as rent_index, try_cast(c{i + 1} as double) as monthly_change, "
    f"try_cast(c{i + 2} as double) as annual_change, try_cast(c{i + 3} as double) as rental_price from q_rent_scope "
    f"where try_cast(c{i} as double) is not null or try_cast(c{i + 3} as double) is not null"
    for cat, kind, cls, i in rules.RENT_CATEGORIES
)
CTE["q_crosswalk"] = """
select a.neighbourhood, a.city, a.ons_area_name, r.area_code as ons_area_code, a.rent_grain from (
 select neighbourhood, city, case when city = 'London' then neighbourhood
   when city = 'Greater Manchester' and neighbourhood ilike '% District' then trim(left(neighbourhood, length(neighbourhood) - 9))
   when city = 'Greater Manchester' then 'Manchester' else 'Bristol, City of' end as ons_area_name,
  case when city = 'London' or (city = 'Greater Manchester' and neighbourhood ilike '% District') then 'exact' else 'broadcast' end as rent_grain
 from q_areas) a left join (select distinct area_code, area_name from q_rents where geo_level = 'district') r
 on lower(trim(r.area_name)) = lower(trim(a.ons_area_name))"""
CTE["q_dim_listing"] = f"""
select l.*, m.property_class as structure_class, m.property_group, price as adr, estimated_occupancy_l365d as occupancy_nights,
 estimated_occupancy_l365d >= 30 as is_active, {rd('estimated_occupancy_l365d / 365e0', 4)} as occupancy_rate,
 estimated_revenue_l365d as annual_revenue, {rd('cast(estimated_revenue_l365d as double) / 365e0', 2)} as revpar
from q_listings l left join q_property_map m on lower(trim(l.property_type)) = lower(trim(m.property_type))"""
CTE["q_dim_host"] = """
select host_id, host_name, host_is_superhost, host_response_rate_pct, host_acceptance_rate_pct from q_listings
qualify row_number() over (partition by host_id order by last_scraped desc nulls last, listing_id) = 1"""
CTE["q_dim_poi"] = """
select *, category ilike '%station%' or category ilike '%bus%' or category ilike '%transit%' or category ilike '%subway%'
  or category ilike '%tram%' as is_transport, amenity_group ilike '%dining%' as is_dining from q_pois where confidence >= 5e-1"""
HAVERSINE = (
    f"{2 * rules.EARTH_RADIUS_M!r} * asin(sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2e0), 2) + cos(radians(a.latitude)) "
    "* cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2e0), 2)))"
)
CTE["q_near"] = f"""
select a.listing_id, b.poi_id, b.name, b.is_transport, b.is_dining from q_dim_listing a join q_dim_poi b
 on b.latitude between a.latitude - 6e-3 and a.latitude + 6e-3 and {HAVERSINE} <= 500e0"""
CTE["q_listing_poi"] = """
select l.listing_id, count(n.name) as poi_count_500m, count(*) filter (where n.is_transport) as transport_count_500m,
 count(*) filter (where n.is_dining) as dining_count_500m from q_dim_listing l left join q_near n using (listing_id) group by l.listing_id"""
CTE["q_placed_sales"] = """
select m.neighbourhood, m.city, s.price, s.property_type_code, coalesce(s.property_class, case when s.property_type_code = 'O' then 'Other' end) as structure_class
from q_sales s join q_postcode_map m on upper(replace(s.postcode, ' ', '')) = m.postcode_key where s.quality_flag = 'ok'"""
CTE["q_area_sales"] = f"""
select neighbourhood, city, structure_class, {med('price')} as median_sale_price, {rd('cast(sum(price) as double) / count(*)', 0)} as avg_sale_price,
 count(*) as sale_txn_count from (select * from q_placed_sales where structure_class is not null union all
 select neighbourhood, city, price, property_type_code, 'All' from q_placed_sales where property_type_code in ('F', 'D', 'S', 'T')) u
group by all"""
CTE["q_area_rent"] = f"""
select x.neighbourhood, x.city, {case_map('r.category', {**rules.RENT_BEDROOM_LABEL, 'All property types': 'All', 'Flat/Maisonette': 'Flat'}, "'House'")} as rent_category,
 case when r.category = 'All property types' then 'overall' when r.category_type = 'bedroom' then 'bedroom' else 'structure' end as category_type,
 {rd('avg(r.rental_price)', 0)} as monthly_rent, {rd('avg(r.rental_price) * 12e0', 0)} as annual_rent, max(r.period) as rent_period, max(x.rent_grain) as rent_grain
from q_crosswalk x join q_rents r on r.area_code = x.ons_area_code
where r.rental_price is not null and r.period = (select max(period) from q_rents) group by 1, 2, 3, 4"""
CTE["q_mart_listing"] = """
select d.*, d.annual_revenue is not null as has_revenue_data, s.median_sale_price as area_median_sale_price,
 p.poi_count_500m, p.transport_count_500m, p.dining_count_500m, h.host_is_superhost as owner_is_superhost
from q_dim_listing d left join q_dim_host h using (host_id) left join q_listing_poi p using (listing_id)
left join q_area_sales s on s.neighbourhood = d.neighbourhood and s.structure_class = d.structure_class"""
# the same without the nearby points, for reads that do not use them
CTE["q_mart_lean"] = """
select d.*, s.median_sale_price as area_median_sale_price from q_dim_listing d
left join q_area_sales s on s.neighbourhood = d.neighbourhood and s.structure_class = d.structure_class"""
OPERATING = (
    f"count(*) as listing_count, {rd(mean('adr'), 2)} as avg_adr, {med('adr')} as median_adr, "
    f"{rd(mean('occupancy_rate'), 4)} as avg_occupancy_rate, {rd(mean('annual_revenue'), 2)} as avg_annual_revenue, "
    f"{med('annual_revenue')} as median_annual_revenue, {rd(mean('review_scores_rating'), 2)} as avg_rating"
)
AVG_BEDS = f"{rd(mean('bedrooms'), 2)} as avg_bedrooms"
CTE["q_area_poi"] = "select p.*, a.neighbourhood as in_area, a.city from q_dim_poi p join q_poi_area a using (poi_id)"
CTE["q_mart_area"] = f"""
select l.*, z.city, s.median_sale_price, coalesce(p.n, 0) as poi_count, coalesce(p.t, 0) as transport_count, coalesce(p.d, 0) as dining_count,
 {rd(div('coalesce(p.n, 0)', 'z.area_sqkm'), 2)} as poi_density_sqkm, z.area_sqkm
from (select neighbourhood, {OPERATING}, {AVG_BEDS} from q_dim_listing group by all) l left join q_sizes z using (neighbourhood)
left join q_area_sales s on s.neighbourhood = l.neighbourhood and s.structure_class = 'All'
left join (select in_area, count(*) as n, count(*) filter (where is_transport) as t, count(*) filter (where is_dining) as d from q_area_poi group by all) p
 on p.in_area = l.neighbourhood"""
CTE["q_area_seasonal"] = f"""
select d.neighbourhood, a.city, cast(month(c.calendar_date) as bigint) as month, count(distinct c.listing_id) as listing_count, count(*) as total_nights,
 count(*) filter (where not c.available) as booked_nights, {rd(div('count(*) filter (where not c.available)', 'count(*)'), 4)} as occupancy_rate
from q_calendar c join q_listings d using (listing_id) left join q_areas a using (neighbourhood) group by 1, 2, 3"""
CTE["q_homes"] = """
select m.*, a.city from q_mart_lean m join q_areas a using (neighbourhood)
where m.structure_class in ('Flat', 'House') and m.room_type = 'Entire home/apt' and m.is_active"""
CTE["q_property_type"] = f"""
select b.*, s.median_sale_price, s.sale_txn_count, b.listing_count >= 5 as sufficient_sample from (
 select neighbourhood, city, structure_class, {OPERATING}, {AVG_BEDS} from q_homes group by all) b
left join q_area_sales s using (neighbourhood, structure_class)"""
CTE["q_bed_homes"] = f"select *, {BUCKET} as bedroom_bucket, least(bedrooms, 4) as bedroom_sort from q_homes where bedrooms >= 1"
CTE["q_bedrooms"] = f"""
select l.*, c.city_listing_count, c.city_median_adr, c.city_avg_occupancy_rate, c.city_median_annual_revenue,
 l.listing_count >= 5 as sufficient_sample, l.listing_count >= 10 as robust_sample
from (select neighbourhood, city, structure_class, bedroom_bucket, bedroom_sort, {OPERATING} from q_bed_homes group by all) l
left join (select city, structure_class, bedroom_bucket, count(*) as city_listing_count, {med('adr')} as city_median_adr,
 {rd(mean('occupancy_rate'), 4)} as city_avg_occupancy_rate, {med('annual_revenue')} as city_median_annual_revenue from q_bed_homes group by all) c
 using (city, structure_class, bedroom_bucket)"""
_SEASON = (
    "cast(month(c.calendar_date) as bigint) as month, count(distinct c.listing_id) as listing_count, count(*) as total_nights, "
    "count(*) filter (where not c.available) as booked_nights"
)
CTE["q_property_seasonal"] = f"""
select *, {rd(div('booked_nights', 'total_nights'), 4)} as occupancy_rate, listing_count >= 5 as sufficient_sample from (
 select neighbourhood, city, structure_class, 'All' as bedroom_bucket, cast(-1 as bigint) as bedroom_sort, {_SEASON}
 from q_calendar c join q_homes h using (listing_id) group by 1, 2, 3, 4, 5, 6 union all
 select neighbourhood, city, structure_class, bedroom_bucket, bedroom_sort, {_SEASON}
 from q_calendar c join q_bed_homes h using (listing_id) group by 1, 2, 3, 4, 5, 6) u"""
CTE["q_assumptions"] = (
    "select * from (values " + CITIES + ") as t(city, cap_nights, assumed_lt_gross_yield_pct, realistic_occ_nights, st_cost_pct, lt_cost_pct)"
)
CTE["q_st_cells"] = f"""
select h.neighbourhood, h.city, h.structure_class, h.bedroom_bucket, h.bedroom_sort, a.cap_nights, a.assumed_lt_gross_yield_pct, count(*) as listing_count,
 {med('h.adr * least(h.occupancy_nights, a.cap_nights)')} as st from q_bed_homes h join q_assumptions a using (city) where h.adr is not null group by all"""
CTE["q_st_vs_lt"] = f"""
select neighbourhood, city, structure_class, bedroom_bucket, bedroom_sort, listing_count, cast(cap_nights as bigint) as occupancy_cap_nights,
 median_sale_price, {rd('st', 2)} as st_annual_income, {rd(div('st', 'median_sale_price') + ' * 100e0', 2)} as st_gross_yield_pct,
 assumed_lt_gross_yield_pct, lt as lt_annual_income, {rd(div('lt', 'median_sale_price') + ' * 100e0', 2)} as lt_gross_yield_pct, lt_rent_source,
 {rd('st - lt', 2)} as st_vs_lt_income_uplift, {rd(div('st - lt', 'median_sale_price') + ' * 100e0', 2)} as st_vs_lt_yield_uplift_ppt,
 {rd(div('st', 'lt'), 2)} as st_to_lt_income_ratio, st > lt as st_wins, listing_count >= 5 as sufficient_sample
from (select c.*, s.median_sale_price, coalesce(b.annual_rent, k.annual_rent, {rd('s.median_sale_price * c.assumed_lt_gross_yield_pct / 100e0', 0)}) as lt,
  case when b.annual_rent is not null then 'observed_bedroom' when k.annual_rent is not null then 'observed_structure' else 'assumed' end as lt_rent_source
 from q_st_cells c left join q_area_sales s using (neighbourhood, structure_class)
 left join q_area_rent b on b.neighbourhood = c.neighbourhood and b.category_type = 'bedroom' and b.rent_category = c.bedroom_bucket
 left join q_area_rent k on k.neighbourhood = c.neighbourhood and k.category_type = 'structure' and k.rent_category = c.structure_class) j"""
CTE["q_listing_groups"] = "select distinct m.listing_id, l.neighbourhood, m.amenity_group from q_amenities m join q_listings l using (listing_id)"
CTE["q_mart_amenities"] = f"""
select g.neighbourhood, a.city, g.amenity_group, g.n as listings_with_group, b.n as area_listings, {rd(div('g.n', 'b.n'), 4)} as pct_listings_with_group
from (select neighbourhood, amenity_group, count(*) as n from q_listing_groups group by all) g
join (select neighbourhood, count(distinct listing_id) as n from q_listing_groups group by all) b using (neighbourhood) left join q_areas a using (neighbourhood)"""
CTE["q_segments_rev"] = """
select listing_id, neighbourhood, annual_revenue, case when ntile(4) over (partition by neighbourhood order by annual_revenue desc, listing_id) = 1
  then 'top' else 'rest' end as segment from q_dim_listing
where annual_revenue > 0 and listing_id in (select listing_id from q_amenities)"""
CTE["q_amenity_gap"] = f"""
select g.neighbourhood, a.city, g.amenity_group, s.top_n, s.rest_n, {rd(div('g.t', 's.top_n'), 4)} as pct_top, {rd(div('g.r', 's.rest_n'), 4)} as pct_rest,
 {rd(div('g.t', 's.top_n') + ' - ' + div('g.r', 's.rest_n'), 4)} as gap, s.top_n + s.rest_n as area_active_listings, s.top_n >= 5 and s.rest_n >= 15 as sufficient_sample
from (select q.neighbourhood, m.amenity_group, count(*) filter (where q.segment = 'top') as t, count(*) filter (where q.segment = 'rest') as r
  from q_segments_rev q join (select distinct listing_id, amenity_group from q_amenities) m using (listing_id) group by all) g
join (select neighbourhood, count(*) filter (where segment = 'top') as top_n, count(*) filter (where segment = 'rest') as rest_n from q_segments_rev group by all) s
 using (neighbourhood) left join q_areas a using (neighbourhood)"""


def r4(x: str) -> str:
    return re_(mean(x), 4)


CTE["q_metrics"] = f"""
select {city_of('_filename')} as city, neighbourhood as neighbourhood_cleansed, count(*) as listing_count, cast(sum(number_of_reviews) as bigint) as total_reviews,
 {r4('price')} as avg_price, cast(min(price) as double) as min_price, cast(max(price) as double) as max_price, {r4('estimated_occupancy_l365d')} as avg_occupancy,
 {r4('estimated_revenue_l365d')} as avg_revenue, cast(coalesce(sum(estimated_revenue_l365d), 0) as double) as total_revenue,
 {r4('review_scores_rating')} as avg_review_rating, {r4('review_scores_cleanliness')} as avg_cleanliness_score,
 count(distinct room_type) as room_type_variety, count(distinct property_type) as property_type_variety,
 count(*) filter (where room_type = 'Entire home/apt') as count_entire_home_apt, count(*) filter (where room_type = 'Private room') as count_private_room,
 count(*) filter (where room_type = 'Shared room') as count_shared_room, count(*) filter (where room_type = 'Hotel room') as count_hotel_room,
 {r4('host_response_rate_pct')} as avg_host_response_rate, {r4('host_acceptance_rate_pct')} as avg_host_acceptance_rate,
 {re_('cast(count(*) filter (where host_is_superhost) as double) / nullif(count(host_is_superhost), 0) * 100e0', 4)} as pct_superhost
from q_listings group by 1, 2"""
CTE["q_poi_columns"] = """
select neighbourhood, count(*) filter (where amenity_group = 'Transport') as poi_transport,
 count(*) filter (where amenity_group = 'Attractions & Culture') as poi_attractions, count(*) filter (where amenity_group = 'Dining & Nightlife') as poi_dining
from q_pois where neighbourhood is not null and amenity_group in ('Transport', 'Attractions & Culture', 'Dining & Nightlife') group by all"""
POI_SCORE = "(poi_transport * 4e-1 + poi_attractions * 35e-2 + poi_dining * 25e-2)"
LOCATION = f"({POI_SCORE} * 7e-1 + listing_density * 3e-1)"
_POI3 = ", ".join(f"coalesce({c}, 0) as {c}" for c in ("poi_transport", "poi_attractions", "poi_dining"))
CTE["q_area_location"] = f"""
select *, {LOCATION} as location_score from (select m.*, m.listing_count / z.area_sqkm as listing_density, {_POI3}
 from q_metrics m left join q_sizes z on z.neighbourhood = m.neighbourhood_cleansed and z.city = m.city
 left join q_poi_columns p on p.neighbourhood = m.neighbourhood_cleansed) j"""


def norm(c: str, invert: bool = False) -> str:
    low, high = f"min({c}) over (partition by city)", f"max({c}) over (partition by city)"
    inner = f"(cast({c} as double) - {low}) / ({high} - {low})"
    return f"case when {high} = {low} then 5e-1 else {'1e0 - ' if invert else ''}{inner} end"


def score(parts) -> str:
    return re_("(" + " + ".join(f"{n} * cast({w} as double)" for n, w in parts) + ") * 100e0", 2)


CTE["q_area_norms"] = f"""
select *, {norm('avg_price', True)} as norm_price_inv, {norm('avg_price')} as norm_avg_price, {norm('avg_occupancy')} as norm_occupancy,
 {norm('avg_revenue')} as norm_revenue, {norm('avg_review_rating')} as norm_rating, {norm('coalesce(location_score, 0e0)')} as norm_location from q_area_location"""
CTE["q_area_scores"] = "select *, " + ", ".join(
    f"{score(p)} as {n}" for n, p in rules.AREA_SCORE_WEIGHTS.items()) + " from q_area_norms"
CTE["q_yield"] = f"""
select listing_id, least(g, quantile_cont(g, 0.99) over ()) as gross_yield from (
 select listing_id, {div('annual_revenue', 'area_median_sale_price')} as g from q_mart_lean where annual_revenue > 0 and area_median_sale_price > 0) y"""
CTE["q_scored"] = f"""
select listing_id, {city_of('_filename')} as city, neighbourhood as neighbourhood_cleansed, property_type, room_type, bedrooms, cast(price as double) as price,
 estimated_occupancy_l365d as estimated_occupancy, cast(estimated_revenue_l365d as double) as estimated_revenue, number_of_reviews, review_scores_rating
from q_listings where estimated_revenue_l365d > 0 and price > 0"""
CTE["q_listing_location"] = f"""
select *, {LOCATION} as location_score from (select s.*, coalesce(c.n / z.area_sqkm, 0e0) as listing_density, {_POI3}, coalesce(y.gross_yield, 0e0) as gross_yield
 from q_scored s left join (select city, neighbourhood_cleansed, count(*) as n from q_scored group by all) c using (city, neighbourhood_cleansed)
 left join q_sizes z on z.neighbourhood = s.neighbourhood_cleansed and z.city = s.city
 left join q_poi_columns p on p.neighbourhood = s.neighbourhood_cleansed left join q_yield y using (listing_id)) j"""
CTE["q_listing_norms"] = f"""
select *, {norm('location_score')} as norm_location, {norm('gross_yield')} as norm_yield, {norm('price', True)} as norm_price,
 {norm('estimated_occupancy')} as norm_occupancy, {norm('estimated_revenue')} as norm_revenue, {norm('review_scores_rating')} as norm_rating,
 {norm('number_of_reviews')} as norm_review_vol from q_listing_location"""
CTE["q_listing_scores"] = "select *, " + ", ".join(
    f"{score(p)} as {n}" for n, p in rules.LISTING_SCORE_WEIGHTS.items()) + ", 'high' as score_confidence from q_listing_norms"
_HITS = {t: " or ".join(f"contains(lower(comments), {quote(w)})" for w in ws) for t, ws in views.TEST_WORDS.items()}
CTE["q_themes"] = (
    "select city, neighbourhood_cleansed, total_reviews, "
    + ", ".join(f"mentions_{t}_count, {re_(div(f'mentions_{t}_count', 'total_reviews') + ' * 100e0', 2)} as pct_mentions_{t}" for t in _HITS)
    + ", case greatest(" + ", ".join(f"mentions_{t}_count" for t in _HITS) + ") "
    + " ".join(f"when mentions_{t}_count then '{t}'" for t in _HITS) + " end as top_theme from (select "
    + f"{city_of('l._filename')} as city, l.neighbourhood as neighbourhood_cleansed, count(*) as total_reviews, "
    + ", ".join(f"count(*) filter (where {h}) as mentions_{t}_count" for t, h in _HITS.items())
    + " from q_reviews r join q_listings l using (listing_id) where trim(r.comments) <> '' group by 1, 2) g"
)
_REPLY = "case when starts_with(trim(reply), '```') then trim(regexp_replace(split_part(trim(reply), '```', 2), '^json', ''), e' \\n\\r\\t') else trim(reply) end"
CTE["q_outputs"] = f"""
select * exclude (body, reply), case when json_type(case when json_valid(body) then body end) = 'OBJECT' then body else reply end as ai_narrative,
 case when reply is null or reply = '' then 'error' when json_type(case when json_valid(body) then body end) = 'OBJECT' then coalesce(json_extract_string(case when json_valid(body) then body end, '$.confidence'), 'medium') when json_valid(body) then 'error' else 'low' end as confidence
from (select *, {_REPLY} as body from q_raw_outputs) o"""
CTE["q_scored_homes"] = """
select m.*, s.city, s.score_yield_maximiser, s.score_occupancy_optimiser, s.score_quality_host from q_mart_lean m join q_listing_scores s using (listing_id)"""
_AVG3 = ", ".join(f"{rd(mean(s), 6)} as avg_{s}" for s in rules.PERSONA_SCORES.values())
CTE["q_segment_scores"] = f"""
select city, neighbourhood, structure_class, {STRICT_BUCKET} as bedroom_bucket, {_AVG3} from q_scored_homes
where neighbourhood is not null and structure_class is not null group by 1, 2, 3, 4"""
CTE["q_strategy"] = "select city, neighbourhood, cast(sum(listing_count) as bigint) as listing_count, " + ", ".join(
    f"{rd(f'cast(sum(cast({c} as decimal(18,4)) * cast(listing_count as decimal(18,0))) as double) / nullif(sum(listing_count), 0)', 4)} as {n}"
    for n, c in {"st_annual_revenue": "st_annual_income", "lt_annual_rent": "lt_annual_income",
                 "st_gross_yield_pct": "st_gross_yield_pct", "lt_gross_yield_pct": "lt_gross_yield_pct"}.items()
) + ", " + ", ".join(f"cast(sum(cast({c} as decimal(18,4))) as double) as {c}_sum" for c in
                     ("st_vs_lt_income_uplift", "st_vs_lt_yield_uplift_ppt", "st_to_lt_income_ratio")) + """
 from q_st_vs_lt where st_annual_income is not null and lt_annual_income is not null group by all"""
