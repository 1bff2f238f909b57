"""Typing, trimming, parsing and decoding rules on single columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from lettings import rules

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: ColumnLike) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def marker_to_null(c: ColumnLike, markers: Iterable[str]) -> Column:
    """Trimmed text, NULL when it is one of ``markers``."""
    text = F.trim(as_col(c))
    return F.when(~text.isin(*markers), text)


def whole(c: ColumnLike, digits: int = 10) -> Column:
    """Whole number from text; ``'1.6'`` rounds to 2, anything else is NULL.

    The text passes through DECIMAL because a direct cast of ``'1.0'`` to an
    integer type yields NULL.
    """
    return as_col(c).try_cast(f"decimal({digits},0)").try_cast("bigint")


def number(c: ColumnLike) -> Column:
    return as_col(c).try_cast("double")


def day(c: ColumnLike) -> Column:
    return as_col(c).try_cast("date")


def parse_money(c: ColumnLike) -> Column:
    """``'$1,250.00'`` as DECIMAL(12,2); out of range or not a number is NULL."""
    return F.translate(as_col(c), "$,", "").try_cast("decimal(12,2)")


def parse_percent(c: ColumnLike) -> Column:
    """``'95%'`` as 95."""
    return whole(F.translate(as_col(c), "%", ""), 5)


def parse_flag(c: ColumnLike) -> Column:
    """``t``/``f`` in any case and padding; any other text is NULL."""
    text = F.lower(F.trim(as_col(c)))
    return F.when(text == "t", True).when(text == "f", False)


def parse_flag_wide(c: ColumnLike) -> Column:
    """The wider yes/no vocabulary of calendar exports; no trimming."""
    text = F.lower(as_col(c).cast("string"))
    return F.when(text.isin(*rules.TRUE_WORDS), True).when(text.isin(*rules.FALSE_WORDS), False)


def strip_room_prefix(c: ColumnLike) -> Column:
    """Property type in lower case without the leading kind of room."""
    return F.trim(F.regexp_replace(F.lower(blank_to_null(c)), rules.ROOM_PREFIX_PATTERN, ""))


def code(c: ColumnLike) -> Column:
    return F.upper(F.trim(as_col(c)))


def decode(c: ColumnLike, labels: Mapping[str, str]) -> Column:
    """Label of a code; a code without label is NULL."""
    key, chain = code(c), None
    for value, label in labels.items():
        chain = (F if chain is None else chain).when(key == value, F.lit(label))
    return chain


def sale_class(c: ColumnLike) -> Column:
    """Dwelling class of a sale code: flats, houses, NULL for the rest."""
    return decode(c, rules.SALE_PROPERTY_CLASS)


def sale_quality(category: ColumnLike, price: Column) -> Column:
    """Kept-but-doubtful marker; the category test comes before the price test."""
    odd_price = (price < rules.SALE_PRICE_FLOOR) | (price > rules.SALE_PRICE_CEILING)
    return (
        F.when(code(category) == "B", F.lit("non_standard"))
        .when(odd_price, F.lit("price_suspect"))
        .otherwise(F.lit("ok"))
    )


def strip_chars(c: ColumnLike, chars: str) -> Column:
    return F.translate(as_col(c), chars, "")


def postcode_key(c: ColumnLike) -> Column:
    return F.upper(F.replace(as_col(c), F.lit(" "), F.lit("")))


def name_key(c: ColumnLike) -> Column:
    """Key for case-insensitive matching of names."""
    return F.lower(F.trim(as_col(c)))


def city_label(segment: Column) -> Column:
    key, chain = F.lower(segment), None
    for value, label in rules.CITY_BY_SEGMENT.items():
        chain = (F if chain is None else chain).when(key == value, F.lit(label))
    return chain


def path_city(c: ColumnLike, position: int = 3) -> Column:
    """City label from a path segment counted from 1; unknown segments are NULL."""
    return city_label(F.split_part(as_col(c), F.lit("/"), F.lit(position)))


def path_city_under(c: ColumnLike, folder: str) -> Column:
    """City label from the segment that follows ``folder`` anywhere in the path."""
    return city_label(F.regexp_extract(as_col(c), f"{folder}/([^/]+)/", 1))


def in_list(c: ColumnLike, values: Iterable[str]) -> Column:
    return code(c).isin(*values)


def rent_scope(c: ColumnLike) -> Column:
    """Official areas in scope: one city code, a code range, a prefix and a region."""
    text = F.trim(as_col(c))
    low, high = rules.RENT_MANCHESTER_CODES
    return (
        (text == rules.RENT_BRISTOL_CODE)
        | text.between(low, high)
        | text.startswith(rules.RENT_LONDON_PREFIX)
        | (text == rules.RENT_LONDON_REGION)
    )


def geo_level(c: ColumnLike) -> Column:
    is_region = F.trim(as_col(c)).startswith(rules.RENT_REGION_PREFIX)
    return F.when(is_region, F.lit("region")).otherwise(F.lit("district"))


def in_world(lat: ColumnLike, lon: ColumnLike) -> Column:
    return as_col(lat).between(-90, 90) & as_col(lon).between(-180, 180)


def plausible_nights(low: ColumnLike = "minimum_nights", high: ColumnLike = "maximum_nights") -> Column:
    """NULL nights pass; known ones are positive, ordered and at most a year."""
    lo, hi = as_col(low), as_col(high)
    return (
        F.coalesce(lo > 0, F.lit(True))
        & F.coalesce(hi > 0, F.lit(True))
        & F.coalesce(lo <= hi, F.lit(True))
        & F.coalesce(lo <= rules.MAX_MIN_NIGHTS, F.lit(True))
    )


def any_measure(cols: Iterable[ColumnLike]) -> Column:
    return F.coalesce(*[as_col(c) for c in cols]).isNotNull()


def first_available(parts: Iterable[tuple[ColumnLike, str]], otherwise: tuple[ColumnLike, str]) -> tuple[Column, Column]:
    """Value of the first non-NULL part and the label of the part that won."""
    parts = [(as_col(c), label) for c, label in parts]
    last, last_label = as_col(otherwise[0]), otherwise[1]
    value = F.coalesce(*[c for c, _ in parts], last)
    source = None
    for c, label in parts:
        source = (F if source is None else source).when(c.isNotNull(), F.lit(label))
    return value, source.otherwise(F.lit(last_label))


def base_type(c: ColumnLike) -> Column:
    """Text before ``:`` and before a spaced dash."""
    head = F.split_part(as_col(c), F.lit(":"), F.lit(1))
    return F.trim(F.split_part(head, F.lit(" – "), F.lit(1)))


def element(cells: ColumnLike, index: Column | int) -> Column:
    """Zero-based element of an array, NULL past its end."""
    return F.get(as_col(cells), index)
