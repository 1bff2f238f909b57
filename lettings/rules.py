"""Fixed values of the domain: word lists, code tables, weights and thresholds.

Everything in this module is data.  The values decide the results, so they are
stated plainly here and nowhere else; column rules and plans read them.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------
# Text markers
# --------------------------------------------------------------------------
CSV_NULL_MARKERS = ("", "NULL", "null", "N/A")
GROUP_NULL_MARKERS = ("", "None")
RENT_NULL_MARKERS = ("", "[z]")

# --------------------------------------------------------------------------
# Cities (path segment -> label) and their assumptions
# --------------------------------------------------------------------------
CITY_BY_SEGMENT = {
    "london": "London",
    "greater_manchester": "Greater Manchester",
    "bristol": "Bristol",
}
CITY_ASSUMPTION_COLUMNS = (
    "city string, cap_nights int, assumed_lt_gross_yield_pct double, "
    "realistic_occ_nights int, st_cost_pct int, lt_cost_pct int"
)
CITY_ASSUMPTIONS = (
    ("London", 90, 4.5, 90, 28, 18),
    ("Greater Manchester", 365, 6.0, 255, 28, 18),
    ("Bristol", 365, 5.0, 255, 28, 18),
)
DEFAULT_CAP_NIGHTS = 365
DEFAULT_ST_COST_PCT = 28
DEFAULT_LT_COST_PCT = 18

# --------------------------------------------------------------------------
# Sales codes
# --------------------------------------------------------------------------
SALE_COUNTIES = ("CITY OF BRISTOL", "GREATER MANCHESTER", "GREATER LONDON")
SALE_PROPERTY_TYPE = {
    "D": "Detached",
    "S": "Semi-Detached",
    "T": "Terraced",
    "F": "Flat/Maisonette",
    "O": "Other",
}
SALE_PROPERTY_CLASS = {"F": "Flat", "D": "House", "S": "House", "T": "House"}
SALE_BUILD_STATUS = {"Y": "New Build", "N": "Established"}
SALE_TENURE = {"F": "Freehold", "L": "Leasehold", "U": "Unknown"}
SALE_CATEGORY = {"A": "Standard Price Paid", "B": "Additional Price Paid"}
SALE_RECORD_STATUS = {"A": "Addition", "C": "Change", "D": "Delete"}
SALE_PRICE_FLOOR = 10_000
SALE_PRICE_CEILING = 20_000_000
RESIDENTIAL_CODES = ("F", "D", "S", "T")
SALE_COLUMNS = (
    "transaction_uid", "price", "date_of_transfer", "postcode", "property_type",
    "old_new", "duration", "paon", "saon", "street", "locality", "town_city",
    "district", "county", "ppd_category_type", "record_status",
)
SALE_FILE_PATTERN = r".*pp-[0-9]{4}\.csv"

# --------------------------------------------------------------------------
# rents
# --------------------------------------------------------------------------
RENT_FIRST_ROW = 4
RENT_BRISTOL_CODE = "E06000023"
RENT_MANCHESTER_CODES = ("E08000001", "E08000010")
RENT_LONDON_PREFIX = "E09"
RENT_LONDON_REGION = "E12000007"
RENT_REGION_PREFIX = "E12"
RENT_MEASURES = ("rent_index", "monthly_change", "annual_change", "rental_price")
RENT_CATEGORY_COLUMNS = "category string, category_type string, property_class string, base_idx int"
RENT_CATEGORIES = (
    ("All property types", "overall", None, 4),
    ("One bedroom", "bedroom", None, 8),
    ("Two bedrooms", "bedroom", None, 12),
    ("Three bedrooms", "bedroom", None, 16),
    ("Four or more bedrooms", "bedroom", None, 20),
    ("Detached", "property_type", "House", 24),
    ("Semi-detached", "property_type", "House", 28),
    ("Terraced", "property_type", "House", 32),
    ("Flat/Maisonette", "property_type", "Flat", 36),
)
RENT_BEDROOM_LABEL = {
    "One bedroom": "1",
    "Two bedrooms": "2",
    "Three bedrooms": "3",
    "Four or more bedrooms": "4+",
}
DISTRICT_SUFFIX = " District"
MANCHESTER_RENT_AREA = "Manchester"
BRISTOL_RENT_AREA = "Bristol, City of"

# --------------------------------------------------------------------------
# Property types of listings
# --------------------------------------------------------------------------
ROOM_PREFIX_PATTERN = (
    r"^(entire|private room in|shared room in|room in|private room|shared room)\s*"
)
PROPERTY_GROUPS = {
    "Apartment / Flat": ("rental unit", "condo", "serviced apartment", "aparthotel"),
    "House": (
        "home", "townhouse", "bungalow", "villa", "cottage", "cabin", "chalet",
        "vacation home",
    ),
    "Guest Accommodation": ("guesthouse", "guest suite", "bed and breakfast", "loft"),
    "Hotel / Hospitality": ("hotel", "boutique hotel", "hostel", "resort", "nature lodge"),
    "Unique Stay": (
        "treehouse", "boat", "houseboat", "tiny home", "camper/rv", "yurt", "castle",
        "lighthouse", "cave", "dome", "hut", "shepherd's hut", "shepherd’s hut",
        "barn", "farm stay", "shipping container", "earthen home",
    ),
    "Outdoor / Land": ("campsite", "tent"),
}
OTHER_PROPERTY_GROUP = "Other / Unknown"
PROPERTY_CLASSES = {
    "Flat": (
        "rental unit", "condo", "serviced apartment", "aparthotel", "loft", "floor",
        "home/apt",
    ),
    "House": (
        "home", "townhouse", "bungalow", "villa", "cottage", "cabin", "chalet",
        "vacation home",
    ),
}
PROPERTY_GROUP_ORDER = {
    "Apartment / Flat": 1,
    "House": 2,
    "Guest Accommodation": 3,
    "Hotel / Hospitality": 4,
    "Unique Stay": 5,
    "Outdoor / Land": 6,
    "Other / Unknown": 7,
}
PROPERTY_GROUP_LAST = 99
PROPERTY_GROUP_TEXT = {
    "Apartment / Flat": "Apartments, condos, serviced apartments and aparthotels.",
    "House": "Houses, townhouses, bungalows, cottages, cabins and villas.",
    "Guest Accommodation": "Bed & breakfasts, guest suites, guesthouses and lofts.",
    "Hotel / Hospitality": "Hotels, boutique hotels, hostels, resorts and lodges.",
    "Unique Stay": "Distinctive stays: boats, cabins, treehouses, yurts and more.",
    "Outdoor / Land": "Campsites and tents.",
    "Other / Unknown": "Uncategorised or ambiguous property types.",
}
DWELLING_CLASSES = ("Flat", "House")
WHOLE_DWELLING = "Entire home/apt"
ACTIVE_NIGHTS = 30
TOP_BUCKET = 4
SUFFICIENT_LISTINGS = 5
ROBUST_LISTINGS = 10
GAP_TOP_LISTINGS = 5
GAP_REST_LISTINGS = 15


class Rule(NamedTuple):
    """One branch of an ordered classifier; any test that holds selects the label."""

    label: str
    exact: tuple[str, ...] = ()
    like: tuple[str, ...] = ()
    guarded: tuple[tuple[str, str], ...] = ()  # (like, and not like)


# --------------------------------------------------------------------------
# Groups of points of interest, first match wins
# --------------------------------------------------------------------------
POI_RULES = (
    Rule("Transport", exact=("train_station", "metro_station", "bus_station", "transportation")),
    Rule("Attractions & Culture", exact=(
        "landmark_and_historical_building", "museum", "history_museum", "art_museum",
        "art_gallery", "monument", "theatre", "cinema", "arts_and_entertainment",
        "amusement_park", "stadium_arena", "football_stadium")),
    Rule("Parks & Green", exact=("park", "botanical_garden", "hiking_trail")),
    Rule("Dining & Nightlife", like=("%restaurant%",), exact=(
        "cafe", "coffee_shop", "pub", "bar", "sports_bar", "bakery")),
    Rule("Groceries & Essentials", like=("%grocery%",), exact=(
        "supermarket", "convenience_store", "pharmacy", "pharmacy_and_drug_store")),
    Rule("Fitness", exact=(
        "gym", "fitness_trainer", "sports_club_and_league", "sports_and_recreation_venue")),
    Rule("Education", exact=(
        "elementary_school", "high_school", "preschool", "day_care_preschool",
        "private_school", "religious_school", "school", "college_university", "university")),
    Rule("Health", exact=(
        "hospital", "medical_center", "doctor", "public_health_clinic",
        "health_and_medical", "dentist")),
)
POI_TRANSPORT_LIKE = ("%station%", "%bus%", "%transit%", "%subway%", "%tram%")
POI_DINING_LIKE = "%dining%"
POI_MIN_CONFIDENCE = 0.5
NEARBY_METRES = 500.0

# --------------------------------------------------------------------------
# Groups of listing amenities, first match wins
# --------------------------------------------------------------------------
AMENITY_RULES = (
    Rule("Parking & EV", like=("%parking%", "%ev charger%", "%electric vehicle%")),
    Rule("Safety & Security", like=(
        "%smoke alarm%", "%carbon monoxide%", "%fire extinguisher%", "%first aid%",
        "%lockbox%", "%smart lock%", "%keypad%", "%security camera%", "%lock on%",
        "%safe%", "%security%", "%window guard%", "%noise%monitor%", "%outlet cover%")),
    Rule("Kitchen & Dining", like=(
        "%kitchen%", "%oven%", "%stove%", "%refrigerator%", "%fridge%", "%freezer%",
        "%microwave%", "%dishwasher%", "%dishes%", "%silverware%", "%cutlery%",
        "%cookware%", "%cooking%", "%coffee%", "%kettle%", "%toaster%", "%blender%",
        "%dining%", "%wine glass%", "%glassware%", "%baking%", "%rice maker%",
        "%bread maker%", "%barbecue utensils%", "%trash compactor%")),
    Rule("Bathroom & Toiletries", like=(
        "%hair dryer%", "%shampoo%", "%body soap%", "%shower gel%", "%soap%",
        "%bathtub%", "%bidet%", "%toiletr%", "%hot water%"),
        guarded=(("%conditioner%", "%air%"),)),
    Rule("Laundry", like=(
        "%washer%", "%dryer%", "iron%", "% iron%", "%drying rack%", "%laundr%",
        "%cleaning products%")),
    Rule("Connectivity & Entertainment", like=(
        "%wifi%", "%ethernet%", "%internet%", "%tv%", "%hdtv%", "%television%",
        "%sound system%", "%speaker%", "%bluetooth%", "%game%", "%books%", "%cable%",
        "%netflix%", "%streaming%", "%record player%", "%pool table%", "%ping pong%",
        "%piano%")),
    Rule("Bedroom & Comfort", like=(
        "%air condition%", "%heating%", "%heater%", "%fan%", "%bed linens%",
        "%hangers%", "%clothing storage%", "%wardrobe%", "%closet%", "%pillows%",
        "%blankets%", "%room-darkening%", "%blackout%", "%essentials%", "%mattress%")),
    Rule("Family & Kids", like=(
        "%crib%", "%high chair%", "%pack ’n play%", "%pack n play%", "%travel crib%",
        "%children%", "%baby%", "%kids%", "%toys%", "%changing table%")),
    Rule("Accessibility", like=(
        "%elevator%", "%single level%", "%step-free%", "%wheelchair%", "%accessible%",
        "%wide entrance%", "%wide hallway%")),
    Rule("Wellness & Leisure", like=(
        "%hot tub%", "%sauna%", "%gym%", "%exercise%", "%fitness%", "%fireplace%",
        "%jacuzzi%", "%spa%"),
        guarded=(("%pool%", "%pool table%"),)),
    Rule("Outdoor & Views", like=(
        "%backyard%", "%patio%", "%balcony%", "%bbq%", "%barbecue%", "%grill%",
        "%garden%", "%view%", "%outdoor%", "%terrace%", "%yard%", "%fire pit%",
        "%hammock%", "%beach%", "%waterfront%", "%lake access%", "%sun lounger%",
        "%bikes%")),
    Rule("Host Services & Policies", like=(
        "%self check-in%", "%host greets%", "%luggage%", "%long term%",
        "%pets allowed%", "%smoking%", "%breakfast%", "%check-in%",
        "%cleaning available%", "%housekeeping%", "%concierge%", "%private entrance%",
        "%building staff%")),
)
OTHER_AMENITY_GROUP = "Other"

# Short amenity labels, first match wins; no match keeps the text
AMENITY_LABELS = (
    Rule("TV", like=("%hdtv%", "%tv", "% tv%")),
    Rule("Wifi", like=("%wifi%",)),
    Rule("Parking", like=("%parking%",)),
    Rule("Sound System", like=("%sound system%",)),
    Rule("Oven", like=("%oven%",)),
    Rule("Stove", like=("%stove%",)),
    Rule("Barbeque", like=("%bbq%", "%barbeque%")),
    Rule("Refrigerator", like=("%refrigerator%",)),
    Rule("Toiletries", like=("%conditioner%", "%shampoo%", "%soap%", "%shower gel%")),
    Rule("Baby Friendly", like=("%baby%",)),
    Rule("Backyard", like=("%backyard%",)),
    Rule("Booster Seat/High Chair", like=("%booster seat%", "%high chair%")),
    Rule("Changing Table", like=("%changing table%",)),
    Rule("Childrens Books and Toys", like=("%children's books and toys%",)),
    Rule("Clothing Storage", like=("%clothing storage%",)),
    Rule("Coffee Maker", like=("%coffee maker%",)),
    Rule("EV Charger", like=("%ev charger%",)),
    Rule("Exercise Equipment", like=("%exercise equipment%", "%gym%")),
    Rule("Dryer", like=("%dryer%",)),
    Rule("Dishwasher", like=("%dishwasher%", "%washer%")),
    Rule("Game Console", like=("%game console%",)),
    Rule("Housekeeping", like=("%housekeeping%",)),
    Rule("Indoor Fireplace", like=("%indoor fireplace%",)),
    Rule("Hot Tub", like=("%hot tub%",)),
    Rule("Pool", like=("%pool%",)),
    Rule("Air Conditioning", like=("%conditioning%", "%ac%")),
)

# --------------------------------------------------------------------------
# Review themes, in the order that breaks ties
# --------------------------------------------------------------------------
THEME_KEYWORDS = {
    "price": ("cheap", "expensive", "value", "price", "cost", "affordable", "overpriced"),
    "cleanliness": ("clean", "dirty", "spotless", "tidy", "mess", "dusty", "filthy"),
    "location": ("location", "central", "transport", "walk", "nearby", "tube", "bus", "station"),
    "checkin": ("check-in", "checkin", "key", "access", "arrival", "lockbox", "host", "welcome"),
}

# --------------------------------------------------------------------------
# Plausibility windows of calendars and reviews
# --------------------------------------------------------------------------
FIRST_DAY = "2008-01-01"
LAST_CALENDAR_DAY = "2026-12-31"
LAST_REVIEW_DAY = "2025-12-31"
MAX_MIN_NIGHTS = 365
MIN_COMMENT_CHARS = 5
TRUE_WORDS = ("t", "true", "1", "yes")
FALSE_WORDS = ("f", "false", "0", "no")

# --------------------------------------------------------------------------
# scores
# --------------------------------------------------------------------------
POI_SCORE_WEIGHTS = {"poi_transport": 0.40, "poi_attractions": 0.35, "poi_dining": 0.25}
POI_SCORE_COLUMNS = {
    "poi_transport": "Transport",
    "poi_attractions": "Attractions & Culture",
    "poi_dining": "Dining & Nightlife",
}
LOCATION_POI_WEIGHT = 0.70
LOCATION_DENSITY_WEIGHT = 0.30
AREA_SCORE_WEIGHTS = {
    "score_yield_maximiser": (
        ("norm_revenue", 0.30), ("norm_occupancy", 0.30), ("norm_avg_price", 0.20),
        ("norm_rating", 0.10), ("norm_location", 0.10)),
    "score_occupancy_optimiser": (
        ("norm_occupancy", 0.40), ("norm_revenue", 0.20), ("norm_rating", 0.20),
        ("norm_avg_price", 0.10), ("norm_location", 0.10)),
    "score_quality_host": (
        ("norm_rating", 0.40), ("norm_occupancy", 0.20), ("norm_price_inv", 0.20),
        ("norm_revenue", 0.10), ("norm_location", 0.10)),
}
LISTING_SCORE_WEIGHTS = {
    "score_yield_maximiser": (
        ("norm_revenue", 0.35), ("norm_occupancy", 0.25), ("norm_price", 0.15),
        ("norm_rating", 0.15), ("norm_review_vol", 0.10)),
    "score_occupancy_optimiser": (
        ("norm_occupancy", 0.40), ("norm_revenue", 0.20), ("norm_rating", 0.20),
        ("norm_review_vol", 0.10), ("norm_price", 0.10)),
    "score_quality_host": (
        ("norm_rating", 0.45), ("norm_review_vol", 0.20), ("norm_occupancy", 0.20),
        ("norm_price", 0.15)),
}
YIELD_CAP_QUANTILE = 0.99
PERSONA_SCORES = {
    "YIELD_MAXIMISER": "score_yield_maximiser",
    "OCCUPANCY_OPTIMISER": "score_occupancy_optimiser",
    "QUALITY_HOST": "score_quality_host",
}
OUTPUT_TYPES = ("AREA_OVERVIEW", "LISTING_CANDIDATES", "RECOMMENDATION")

# --------------------------------------------------------------------------
# wording
# --------------------------------------------------------------------------
TINY_SAMPLE_NOTE = " WARNING: only 1-2 listings — treat with caution"
SMALL_SAMPLE_NOTE = " (limited sample — interpret carefully)"
NO_SUMMARY = "No recommendation summary available."

# --------------------------------------------------------------------------
# Months and seasons
# --------------------------------------------------------------------------
MONTH_LABELS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)
SEASONS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
    "Autumn": (9, 10, 11),
}
DATE_SPINE_MARGIN_DAYS = 30
EARTH_RADIUS_M = 6371008.8
