"""Edge rows of single-column rules."""

from decimal import Decimal

from pyspark.sql import functions as F

from lettings import rules
from lettings.functions import classify, clean, measures
from lettings.operators import reshape
from lettings.plans import serve


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_casts(spark):
    rows = ["1.0", "1.6", " 7 ", "", "abc", None]
    assert values(spark, rows, clean.whole("c")) == [1, 2, 7, None, None, None]
    assert values(spark, ["$1,250.00", "12345678901.5", "x"], clean.parse_money("c")) == [Decimal("1250.00"), None, None]
    assert values(spark, ["95%", "N/A"], clean.parse_percent("c")) == [95, None]
    assert [str(v) for v in values(spark, ["2024-13-01", "2024-01-31"], clean.day("c"))] == ["None", "2024-01-31"]
    assert values(spark, ["t", " F ", "x", None], clean.parse_flag("c")) == [True, False, None, None]


def test_room_prefix(spark):
    rows = ["Entire rental unit", "Private room in condo", "Room in hotel", "Shared room", "Boat", " "]
    assert values(spark, rows, clean.strip_room_prefix("c")) == ["rental unit", "condo", "hotel", "", "boat", None]


def test_amenity_rules_keep_their_order(spark):
    expected = {
        "Dishwasher": "Kitchen & Dining", "Washer": "Laundry", "Hair dryer": "Bathroom & Toiletries",
        "Dryer": "Laundry", "Hot water kettle": "Kitchen & Dining", "Hot water": "Bathroom & Toiletries",
        "Air conditioner": "Bedroom & Comfort", "Conditioner": "Bathroom & Toiletries",
        "Pool table": "Connectivity & Entertainment", "Pool": "Wellness & Leisure",
        "Dedicated workspace": "Wellness & Leisure", "Baby safety gates": "Safety & Security",
        "Ice cream": "Other",
    }
    assert values(spark, list(expected), classify.amenity_group("c")) == list(expected.values())


def test_amenity_labels_reach_late_branches(spark):
    rows = ["Pool", "EV charger", "32 inch HDTV", "Something else", "High chair"]
    assert values(spark, rows, classify.amenity_label("c")) == [
        "Pool", "EV Charger", "TV", "Something else", "Booster Seat/High Chair"]


def test_poi_groups(spark):
    rows = ["transportation", "thai_restaurant", "org_grocery_x", "barber", "museum"]
    assert values(spark, rows, classify.poi_group("c")) == [
        "Transport", "Dining & Nightlife", "Groceries & Essentials", None, "Attractions & Culture"]
    assert values(spark, rows, classify.is_transport("c")) == [False] * 5  # the word holds no "station"


def test_replies(spark):
    rows = ['```json\n{"a": 1, "confidence": "high"}\n```', '{"a": 1}', "plain", None, ""]
    body, confidence = serve.parse_reply(F.col("c"))
    assert values(spark, rows, confidence) == ["high", "medium", "low", "error", "error"]
    assert values(spark, rows, body)[:3] == ['{"a": 1, "confidence": "high"}', '{"a": 1}', "plain"]


def test_explode_json_trims_and_drops_bad_text(spark):
    rows = ['[" 0Wifi ", "1 bed"]', "bad", None, "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    assert sorted(r.item for r in reshape.explode_json(df, "c", "item").collect()) == ["0Wifi", "1 bed"]
    assert values(spark, ["Clothing storage: wardrobe", "a – b"], clean.base_type("c")) == ["Clothing storage", "a"]


def test_cache_key_is_order_free(spark):
    df = spark.createDataFrame([([" b", "a "],), (["a", "b"],)], "n array<string>")
    assert {r[0] for r in df.select(measures.cache_key("n")).collect()} == {"a,b"}


def test_min_max_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (None, 2.0, 2.0), (None, None, None), (3.0, 1.0, 5.0)], "v double, lo double, hi double")
    got = [r[0] for r in df.select(measures.min_max(F.col("v"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [0.5, 0.5, None, 0.5]


def test_first_argmax_takes_first_tie(spark):
    df = spark.createDataFrame([(2, 2, 1)], "a int, b int, c int")
    assert df.select(classify.first_argmax([("a", "x"), ("b", "y"), ("c", "z")])).first()[0] == "x"


def test_rules_are_consistent():
    for weights in (*rules.AREA_SCORE_WEIGHTS.values(), *rules.LISTING_SCORE_WEIGHTS.values()):
        assert abs(sum(w for _, w in weights) - 1.0) < 1e-9


def test_fixed_lists_by_their_values(spark):
    """Expectations are written out here, so a wrong value in the rules shows."""
    groups = {
        "rental unit": ("Apartment / Flat", "Flat"), "aparthotel": ("Apartment / Flat", "Flat"),
        "home": ("House", "House"), "vacation home": ("House", "House"), "cabin": ("House", "House"),
        "guest suite": ("Guest Accommodation", None), "loft": ("Guest Accommodation", "Flat"),
        "boutique hotel": ("Hotel / Hospitality", None), "nature lodge": ("Hotel / Hospitality", None),
        "camper/rv": ("Unique Stay", None), "earthen home": ("Unique Stay", None), "shepherd’s hut": ("Unique Stay", None),
        "tent": ("Outdoor / Land", None), "floor": ("Other / Unknown", "Flat"), "home/apt": ("Other / Unknown", "Flat"),
        "island": ("Other / Unknown", None),
    }
    assert values(spark, list(groups), classify.property_group("c")) == [g for g, _ in groups.values()]
    assert values(spark, list(groups), classify.property_class("c")) == [c for _, c in groups.values()]
    points = {
        "train_station": "Transport", "stadium_arena": "Attractions & Culture", "cinema": "Attractions & Culture",
        "hiking_trail": "Parks & Green", "sports_bar": "Dining & Nightlife", "bakery": "Dining & Nightlife",
        "pharmacy_and_drug_store": "Groceries & Essentials", "gym": "Fitness", "day_care_preschool": "Education",
        "university": "Education", "dentist": "Health", "health_and_medical": "Health", "stationery": None,
    }
    assert values(spark, list(points), classify.poi_group("c")) == list(points.values())
    assert {c: rules.SALE_PROPERTY_TYPE[c] for c in "DSTFO"} == {
        "D": "Detached", "S": "Semi-Detached", "T": "Terraced", "F": "Flat/Maisonette", "O": "Other"}
    assert rules.CITY_ASSUMPTIONS == (
        ("London", 90, 4.5, 90, 28, 18), ("Greater Manchester", 365, 6.0, 255, 28, 18), ("Bristol", 365, 5.0, 255, 28, 18))
    assert rules.RENT_CATEGORIES == (
        ("All property types", "overall", None, 4), ("One bedroom", "bedroom", None, 8), ("Two bedrooms", "bedroom", None, 12),
        ("Three bedrooms", "bedroom", None, 16), ("Four or more bedrooms", "bedroom", None, 20),
        ("Detached", "property_type", "House", 24), ("Semi-detached", "property_type", "House", 28),
        ("Terraced", "property_type", "House", 32), ("Flat/Maisonette", "property_type", "Flat", 36))
    amenities = {
        "EV charger": "Parking & EV", "Carbon monoxide alarm": "Safety & Security", "Trash compactor": "Kitchen & Dining",
        "Bidet": "Bathroom & Toiletries", "Steam iron": "Laundry", "Environment": "Other", "Record player": "Connectivity & Entertainment",
        "Room-darkening shades": "Bedroom & Comfort", "Changing table": "Family & Kids", "Wide hallways": "Accessibility",
        "Sauna": "Wellness & Leisure", "Hair conditioner": "Bedroom & Comfort",
    }
    assert values(spark, list(amenities), classify.amenity_group("c")) == list(amenities.values())
