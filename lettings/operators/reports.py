"""Counts and profiles that describe a frame: audits, nulls, duplicates, columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType

from lettings import rules
from lettings.functions import clean, measures
from lettings.operators.joins import join_keys, join_null_safe
from lettings.operators.quantiles import quantiles_from_counts, value_counts


def load_audit(df: DataFrame, table: str, file_col: str, line_col: str, error_col: str) -> DataFrame:
    """Per file: rows parsed and loaded, errors, the first error and its line."""
    bad = F.col(error_col).isNotNull()
    counted = df.groupBy(F.col(file_col).alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count_if(~bad).alias("rows_loaded"),
        F.count_if(bad).alias("errors_seen"),
        F.min_by(F.when(bad, F.col(error_col)), F.when(bad, F.col(line_col))).alias("first_error"),
        F.min(F.when(bad, F.col(line_col))).alias("first_error_line"),
    )
    status = F.when(F.col("errors_seen") == 0, F.lit("LOADED")).when(
        F.col("rows_loaded") == 0, F.lit("LOAD_FAILED")
    ).otherwise(F.lit("PARTIALLY_LOADED"))
    return counted.select(F.lit(table).alias("table_name"), "file_name", status.alias("status"), *counted.columns[1:])


def with_run_time(df: DataFrame, run_at: datetime | None = None, name: str = "run_at") -> DataFrame:
    """A frame with the time of its run, such as an audit to be appended to earlier ones."""
    at = F.current_timestamp().cast("timestamp_ntz") if run_at is None else F.lit(run_at).cast("timestamp_ntz")
    return df.withColumn(name, at)


def clean_audit(
    target: str, source: str, rows_in: DataFrame, rows_out: DataFrame, per_row: int = 1
) -> DataFrame:
    """Rows in, out and dropped; ``per_row`` states a known fan-out of the input."""
    n_in = rows_in.agg((F.count(F.lit(1)) * per_row).alias("rows_in"))
    n_out = rows_out.agg(F.count(F.lit(1)).alias("rows_out"))
    return n_in.crossJoin(n_out).select(
        F.lit(target).alias("table_name"), F.lit(source).alias("source_table"),
        "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("rows_dropped"),
    )


def verify_counts(frames: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per name; a missing frame counts 0."""
    present = [f.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
               for n, f in frames.items() if f is not None]
    spark = next(f for f in frames.values() if f is not None).sparkSession
    missing = [(n, 0) for n, f in frames.items() if f is None]
    result = present[0]
    for one in present[1:]:
        result = result.unionByName(one)
    if missing:
        result = result.unionByName(spark.createDataFrame(missing, "table_name string, row_count bigint"))
    return result


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df


def null_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per column in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column_name", "null_count")


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and their difference; counted per key first."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """One row per column: share of NULLs, distinct values, and for numbers the
    range, mean, median, deviation, adjusted skew and count of outliers beyond
    1.5 quartile ranges.

    Numbers are counted per value once; every figure is an aggregate of the counts.
    """
    fields = [f for f in df.schema.fields if cols is None or f.name in cols]
    numeric = [f.name for f in fields if isinstance(f.dataType, NumericType | BooleanType)]
    as_text = F.array(*[
        F.struct(F.lit(f.name).alias("c"), F.col(f.name).cast("string").alias("v")) for f in fields
    ])
    per_value = df.select(F.inline(as_text).alias("column_name", "__v")).groupBy(
        "column_name", "__v"
    ).agg(F.count(F.lit(1)).alias("n"))
    base = per_value.groupBy("column_name").agg(
        F.round(F.sum(F.when(F.col("__v").isNull(), F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), digits).alias("percent_null"),
        F.count("__v").alias("unique_values"),
    )
    counts = value_counts(df, [], {c: F.col(c).cast("double") for c in numeric}).withColumnRenamed(
        "__name", "column_name"
    )
    x, n = F.col("__value"), F.col("__n").cast("double")
    centre = counts.groupBy("column_name").agg(
        F.sum(n).alias("__rows"), (F.sum(x * n) / F.sum(n)).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    quart = quantiles_from_counts(
        counts.withColumnRenamed("column_name", "__name"), [], {"__q1": 0.25, "median": 0.5, "__q3": 0.75}
    ).withColumnRenamed("__name", "column_name")
    marks = F.broadcast(join_keys(centre, quart, ["column_name"]))  # one row per column
    both = counts.join(marks, "column_name")
    d, fence = x - F.col("mean"), (F.col("__q3") - F.col("__q1")) * 1.5
    outside = (x < F.col("__q1") - fence) | (x > F.col("__q3") + fence)
    spread = both.groupBy("column_name").agg(
        F.sum(d * d * n).alias("__m2"), F.sum(d * d * d * n).alias("__m3"),
        F.sum(F.when(outside, F.col("__n")).otherwise(0)).alias("outlier_count"),
    )
    full = join_keys(marks, spread, ["column_name"])
    rows = F.col("__rows")
    std = F.sqrt(F.try_divide(F.col("__m2"), rows - 1))
    g1 = F.try_divide(F.col("__m3") / rows, F.pow(F.col("__m2") / rows, F.lit(1.5)))
    skew = F.try_divide(g1 * F.sqrt(rows * (rows - 1)), rows - 2)
    stats = full.select(
        "column_name", F.round(F.col("max") - F.col("min"), digits).alias("range"),
        F.round("mean", digits).alias("mean"), F.round("median", digits).alias("median"),
        F.round(std, digits).alias("std"), F.round("min", digits).alias("min"),
        F.round("max", digits).alias("max"), F.round(skew, digits).alias("skew"), "outlier_count",
    )
    return base.join(stats, "column_name", "left")


def calendar_by_listing(df: DataFrame) -> DataFrame:
    """Days, booked days, span and mean night limits per listing."""
    days = F.count("date")
    booked = F.count_if(F.col("is_booked"))
    out = df.groupBy("listing_id").agg(
        days.alias("total_calendar_days"), booked.alias("days_booked"),
        F.min("date").alias("calendar_start_date"), F.max("date").alias("calendar_end_date"),
        measures.mean("minimum_nights").alias("avg_minimum_nights"),
        measures.mean("maximum_nights").alias("avg_maximum_nights"),
    )
    return out.withColumn("occupancy_rate", measures.ratio("days_booked", "total_calendar_days", 4))


def season_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nights-weighted occupancy per season with the peak and trough season.

    Ties go to the season first in alphabetical order.
    """
    per = df.groupBy(*keys, measures.season("month").alias("season")).agg(
        F.sum("booked_nights").alias("booked_nights"), F.sum("total_nights").alias("total_nights")
    )
    per = per.withColumn(
        "occupancy", F.coalesce(measures.ratio("booked_nights", "total_nights"), F.lit(0.0))
    )
    best = per.groupBy(*keys).agg(
        F.min(F.struct(-F.col("occupancy"), F.col("season").alias("s"))).alias("__peak"),
        F.min(F.struct(F.col("occupancy"), F.col("season").alias("s"))).alias("__trough"),
    ).select(*keys, F.col("__peak.s").alias("peak_season"), F.col("__trough.s").alias("trough_season"))
    return join_null_safe(per.withColumn("occupancy", F.round("occupancy", 6)), best, list(keys))


def listing_share(df: DataFrame, keys: Sequence[str], label: str, means: Sequence[str]) -> DataFrame:
    """Summed listings and plain means per label with the share of all listings of ``keys``."""
    per = df.groupBy(*keys, label).agg(
        F.sum("listing_count").alias("listing_count"),
        *[measures.mean(c, 4).alias(c) for c in means],
    )
    totals = per.groupBy(*keys).agg(F.sum("listing_count").alias("__all"))
    both = join_null_safe(per, totals, list(keys))
    return both.withColumn(
        "listing_percentage", measures.ratio(F.col("listing_count") * 100, "__all", 4)
    ).drop("__all")


def city_validation(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Per city: rows and the mean, least and greatest of each score."""
    return df.groupBy("city").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[measures.mean(s, 2).alias(f"avg_{s}") for s in scores],
        *[F.min(s).alias(f"min_{s}") for s in scores],
        *[F.max(s).alias(f"max_{s}") for s in scores],
    )


HOST_RATES = ("host_response_time", "host_response_rate", "host_acceptance_rate")


def host_clean(df: DataFrame) -> DataFrame:
    """Distinct hosts as text: rates without marker and percent sign, ``UNKNOWN`` for what is missing in any column."""
    return df.distinct().select(*[
        F.coalesce(
            clean.strip_chars(clean.marker_to_null(c, ("N/A",)), "%") if c in HOST_RATES else F.col(c).cast("string"),
            F.lit("UNKNOWN"),
        ).alias(c)
        for c in df.columns
    ])


LINEAGE = ("_load_ts", "_filename", "_file_row_number")


def typed_calendar(df: DataFrame) -> DataFrame:
    """Calendar text as types, rows without listing, day or booking state left out."""
    typed = df.select(
        clean.whole("listing_id", 38).alias("listing_id"), clean.day("date").alias("date"),
        clean.parse_flag_wide("is_booked").alias("is_booked"),
        clean.whole("minimum_nights").alias("minimum_nights"),
        clean.whole("maximum_nights").alias("maximum_nights"),
        *[c for c in LINEAGE if c in df.columns],
    )
    return typed.dropna(subset=["listing_id", "date", "is_booked"])


def plausible_calendar(
    typed: DataFrame, first: str = rules.FIRST_DAY, last: str = rules.LAST_CALENDAR_DAY
) -> DataFrame:
    """Positive listings with a plausible day and plausible nights."""
    days = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return typed.where((F.col("listing_id") > 0) & days & clean.plausible_nights())


def typed_reviews(df: DataFrame) -> DataFrame:
    """Review text as types, blanks as NULL, rows without an id or day left out."""
    typed = df.select(
        clean.whole("id", 38).alias("id"), clean.whole("listing_id", 38).alias("listing_id"),
        clean.whole("reviewer_id", 38).alias("reviewer_id"), clean.day("date").alias("date"),
        clean.blank_to_null("reviewer_name").alias("reviewer_name"),
        clean.blank_to_null("comments").alias("comments"),
        *[c for c in LINEAGE if c in df.columns],
    )
    return typed.dropna(subset=["listing_id", "id", "date", "reviewer_id"])


def plausible_reviews(
    typed: DataFrame, first: str = rules.FIRST_DAY, last: str = rules.LAST_REVIEW_DAY
) -> DataFrame:
    """Positive ids, a plausible day and no very short comment."""
    days = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ids = (F.col("id") > 0) & (F.col("listing_id") > 0) & (F.col("reviewer_id") > 0)
    long_enough = F.col("comments").isNull() | (F.length("comments") >= rules.MIN_COMMENT_CHARS)
    return typed.where(ids & days & long_enough)
