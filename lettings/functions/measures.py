"""Rates, buckets, flags, scores and display text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from lettings import rules
from lettings.functions.clean import ColumnLike, as_col


def ratio(num: ColumnLike, den: ColumnLike, digits: int | None = None, times: int = 1) -> Column:
    """Quotient in doubles, NULL for a zero or missing denominator."""
    value = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    if times != 1:
        value = value * F.lit(float(times))
    return value if digits is None else F.round(value, digits)


def mean(c: ColumnLike, digits: int | None = None) -> Column:
    """Average over :func:`exact_sum`, rounded at the end."""
    return ratio(exact_sum(c), F.count(as_col(c)), digits)


def exact_sum(c: ColumnLike) -> Column:
    """Sum as a double that does not depend on the row order where that is possible.

    Values that are decimals of up to 14 digits before and after the point (money, counts,
    ratings) are summed exactly.  With any other value among them nothing is cut: the sum
    is one of the values as they are.
    """
    value = as_col(c)
    exact = value.try_cast("decimal(28,14)")
    other = value.isNotNull() & ~F.coalesce(exact.cast("double") == value.cast("double"), F.lit(False))
    return F.when(F.count_if(other) == 0, F.sum(exact).cast("double")).otherwise(F.sum(value.cast("double")))


def counted_mean(value: ColumnLike, n: ColumnLike, digits: int | None = None) -> Column:
    """:func:`mean` of values that are given once with the number ``n`` of their rows; NULL values are left out."""
    v, rows = as_col(value), F.when(as_col(value).isNotNull(), as_col(n))
    exact = v.try_cast("decimal(28,14)")
    other = v.isNotNull() & ((rows >= 10**9) | ~F.coalesce(exact.cast("double") == v.cast("double"), F.lit(False)))
    total = F.when(F.count_if(other) == 0, F.sum(exact * rows.try_cast("decimal(9,0)")).cast("double"))
    return ratio(total.otherwise(F.sum(v.cast("double") * rows)), F.sum(rows), digits)


def weighted_mean(c: ColumnLike, weight: ColumnLike) -> Column:
    """Sum of value x weight over the sum of all weights; NULL values add nothing."""
    return ratio(exact_sum(as_col(c) * as_col(weight)), F.sum(as_col(weight)))


def count_when(test: Column) -> Column:
    return F.count_if(test)


def bedroom_bucket(c: ColumnLike) -> Column:
    """``4+`` from four on, else the number as text."""
    beds = as_col(c)
    return F.when(beds >= rules.TOP_BUCKET, F.lit("4+")).otherwise(beds.cast("string"))


def bedroom_bucket_strict(c: ColumnLike) -> Column:
    """Buckets 1, 2, 3 and 4+ only; studios and unknown sizes are NULL."""
    beds = as_col(c)
    return F.when(beds >= rules.TOP_BUCKET, F.lit("4+")).when(
        beds.isin(1, 2, 3), beds.cast("string")
    )


def bedroom_sort(c: ColumnLike) -> Column:
    return least_or_null(as_col(c), F.lit(rules.TOP_BUCKET).cast("bigint"))


def least_or_null(a: Column, b: Column) -> Column:
    """LEAST that is NULL when either side is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def is_active(nights: ColumnLike) -> Column:
    return as_col(nights) >= rules.ACTIVE_NIGHTS


def occupancy_rate(nights: ColumnLike) -> Column:
    return F.round(as_col(nights).cast("double") / 365.0, 4)


def revpar(revenue: ColumnLike) -> Column:
    return F.round(as_col(revenue).cast("double") / 365.0, 2)


def like_for_like(bedrooms: bool = False) -> Column:
    """Whole, actively let flats and houses; optionally with a known bedroom."""
    test = (
        F.col("structure_class").isin(*rules.DWELLING_CLASSES)
        & (F.col("room_type") == rules.WHOLE_DWELLING)
        & F.col("is_active")
    )
    return test & (F.col("bedrooms") >= 1) if bedrooms else test


def sufficient(n: ColumnLike) -> Column:
    return as_col(n) >= rules.SUFFICIENT_LISTINGS


def robust(n: ColumnLike) -> Column:
    return as_col(n) >= rules.ROBUST_LISTINGS


def gap_sample(top: ColumnLike, rest: ColumnLike) -> Column:
    return (as_col(top) >= rules.GAP_TOP_LISTINGS) & (as_col(rest) >= rules.GAP_REST_LISTINGS)


def sample_note(n: ColumnLike) -> Column:
    """Wording that goes with a thin sample; empty for ten listings and more."""
    return (
        F.when(as_col(n) < 3, F.lit(rules.TINY_SAMPLE_NOTE))
        .when(as_col(n) < 10, F.lit(rules.SMALL_SAMPLE_NOTE))
        .otherwise(F.lit(""))
    )


def occupancy_quality(rate: ColumnLike) -> Column:
    return (
        F.when(as_col(rate) == 1.0, F.lit("FULLY_BOOKED_CHECK"))
        .when(as_col(rate) == 0.0, F.lit("ZERO_BOOKINGS"))
        .otherwise(F.lit("OK"))
    )


def comment_coverage(n: ColumnLike) -> Column:
    return F.when(F.coalesce(as_col(n), F.lit(0)) == 0, F.lit("NO_COMMENTS")).otherwise(F.lit("OK"))


def date_range_label(start: ColumnLike, end: ColumnLike) -> Column:
    return F.concat(
        F.date_format(as_col(start), "dd/MM/yyyy"), F.lit(" - "),
        F.date_format(as_col(end), "dd/MM/yyyy"),
    )


def clip_upper(c: ColumnLike, cap: ColumnLike) -> Column:
    return least_or_null(as_col(c), as_col(cap))


def min_max(value: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Position between two bounds; 0.5 for every row of a constant column."""
    value, low, high = (c.cast("double") for c in (value, low, high))
    inside = (value - low) / (high - low)
    return F.when(high == low, F.lit(0.5)).otherwise(F.lit(1.0) - inside if invert else inside)


def weighted_score(parts: Iterable[tuple[str, float]]) -> Column:
    """Weighted signals on a 0-100 scale, half-even at 2 decimals; NULL spreads."""
    total = None
    for name, weight in parts:
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return F.bround(total * F.lit(100.0), 2)


def weighted_sum(parts: Iterable[tuple[ColumnLike, float]]) -> Column:
    total = None
    for c, weight in parts:
        term = as_col(c).cast("double") * F.lit(weight)
        total = term if total is None else total + term
    return total


def month_label(c: ColumnLike) -> Column:
    return F.get(F.array(*[F.lit(m) for m in rules.MONTH_LABELS]), as_col(c).cast("int") - 1)


def season(c: ColumnLike) -> Column:
    chain = None
    for label, months in rules.SEASONS.items():
        chain = (F if chain is None else chain).when(as_col(c).isin(*months), F.lit(label))
    return chain


def display_text(c: ColumnLike, missing: str = "Uncategorised") -> Column:
    return F.initcap(F.replace(F.coalesce(as_col(c), F.lit(missing)), F.lit("_"), F.lit(" ")))


def money_text(c: ColumnLike) -> Column:
    text = F.concat(F.lit("£"), F.format_number(as_col(c), 0))
    return F.coalesce(text, F.lit("N/A"))


def percent_text(c: ColumnLike) -> Column:
    return F.coalesce(F.concat(F.format_number(as_col(c), 1), F.lit("%")), F.lit("N/A"))


def cache_key(names: ColumnLike) -> Column:
    """Order-free key of a selection: trimmed, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.transform(as_col(names), lambda name: F.trim(name))), ",")
