"""Equi joins, selections and the crosswalk."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lettings import rules
from lettings.functions import clean

MOST_PICKS = 1_000


def values_frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Constant table; its size is fixed by the code, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """A frame that is promised to be small; the job fails where it has more rows, which are never gathered."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    refused = F.raise_error(F.lit(f"More than {rows} rows where at most so many are expected")).cast("boolean")
    counted = df.limit(rows + 1).withColumn("__rows", n)
    return counted.where(F.when(F.col("__rows") > rows, refused).otherwise(True)).drop("__rows")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on equally named columns; NULL keys never match."""
    return left.join(right, list(keys), how)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other (for group-by results); without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(at_most(right, 1)))
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, test, how).drop(*[f"__{k}" for k in keys])


def join_on_constant(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str, value: object) -> DataFrame:
    """Left join against one slice of a fact."""
    return left.join(right.where(F.col(column) == F.lit(value)).drop(column), list(keys), "left")


def cross_with_fixed(df: DataFrame, spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Every row next to every row of a constant table."""
    return df.crossJoin(values_frame(spark, rows, schema))


def join_semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_semi")


def join_anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def join_latest(df: DataFrame, period: str) -> DataFrame:
    """Rows of the newest period; the period frame is one row by construction."""
    newest = df.agg(F.max(period).alias("__newest"))
    return df.join(F.broadcast(newest), F.col(period) == F.col("__newest")).drop("__newest")


def join_name_keys(
    left: DataFrame, right: DataFrame, pairs: Mapping[str, str], how: str = "left"
) -> DataFrame:
    """Join on trimmed, case-folded names: left column -> right column."""
    tests = [clean.name_key(left[a]) == clean.name_key(right[b]) for a, b in pairs.items()]
    return left.join(right, reduce(lambda a, b: a & b, tests), how)


def select_cases(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rows whose columns equal the given names in any case and padding."""
    tests = [clean.name_key(c) == clean.name_key(F.lit(v)) for c, v in wanted.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def tuple_in(df: DataFrame, cols: Sequence[str], tuples: Iterable[Sequence[object]]) -> DataFrame:
    """Rows whose columns, taken together, are one of ``tuples`` (pushed to the scan)."""
    tests = [
        reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(cols, row, strict=True)])
        for row in tuples
    ]
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def picks_frame(spark: SparkSession, picks: Iterable[Mapping[str, str]], cols: Sequence[str]) -> DataFrame:
    """A user's picks as a frame; a selection holds at most ``MOST_PICKS`` rows."""
    rows = [tuple(p[c] for c in cols) for p in picks]
    if len(rows) > MOST_PICKS:
        raise ValueError(f"{len(rows)} picks; at most {MOST_PICKS} are expected")
    return values_frame(spark, rows, ", ".join(f"{c} string" for c in cols))


def join_selection(picks: DataFrame, fact: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Picks joined to a fact on trimmed, case-folded names; picks keep their spelling."""
    renamed = picks.select(*[F.col(c).alias(f"pick_{c}") for c in cols])
    tests = [clean.name_key(F.col(f"pick_{c}")) == clean.name_key(F.col(c)) for c in cols]
    test = reduce(lambda a, b: a & b, tests)
    return renamed.join(fact, test, how)


def rent_area_name(city: Column, area: Column) -> Column:
    """Official rent area of an area: itself, without " District", or one per city."""
    suffix = rules.DISTRICT_SUFFIX
    has_suffix = F.lower(area).endswith(suffix.lower())
    bare = F.trim(F.substring(area, F.lit(1), F.length(area) - len(suffix)))
    return (
        F.when(city == "London", area)
        .when((city == "Greater Manchester") & has_suffix, bare)
        .when(city == "Greater Manchester", F.lit(rules.MANCHESTER_RENT_AREA))
        .when(city == "Bristol", F.lit(rules.BRISTOL_RENT_AREA))
    )


def rent_grain(city: Column, area: Column) -> Column:
    has_suffix = F.lower(area).endswith(rules.DISTRICT_SUFFIX.lower())
    exact = (city == "London") | ((city == "Greater Manchester") & has_suffix)
    return F.when(exact, F.lit("exact")).otherwise(F.lit("broadcast"))
