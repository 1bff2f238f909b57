"""Unpivots, explodes, pivots and list building."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lettings import rules
from lettings.functions import clean
from lettings.operators import windows
from lettings.operators.joins import cross_with_fixed, join_keys, join_null_safe


def unpivot_blocks(df: DataFrame, cells: str = "cells") -> DataFrame:
    """Blocks of four measures in a cell array as one row per rent category."""
    crossed = cross_with_fixed(df, df.sparkSession, rules.RENT_CATEGORIES, rules.RENT_CATEGORY_COLUMNS)
    measures = [
        clean.element(cells, F.col("base_idx") + i).try_cast("double").alias(name)
        for i, name in enumerate(rules.RENT_MEASURES)
    ]
    return crossed.select("*", *measures).drop("base_idx")


def melt(
    df: DataFrame, ids: Sequence[str], labels: Mapping[str, str], variable: str, value: str
) -> DataFrame:
    """Wide to long; columns become the given labels and NULL values are left out."""
    long = df.unpivot(list(ids), list(labels), variable, value)
    chain = None
    for name, label in labels.items():
        chain = (F if chain is None else chain).when(F.col(variable) == name, F.lit(label))
    return long.withColumn(variable, chain).where(F.col(value).isNotNull())


def explode_json(df: DataFrame, col: str, name: str, distinct: bool = False) -> DataFrame:
    """Elements of a JSON text array; bad text and NULL give no rows.

    With ``distinct`` repeats inside one array go before the explode, which
    needs no shuffle where the row key is already unique.
    """
    items = F.transform(F.from_json(F.col(col), "array<string>"), lambda item: F.trim(item))
    return df.withColumn(name, F.explode(F.array_distinct(items) if distinct else items))


def explode_list(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row per element, blanks left out."""
    return df.withColumn(name, F.explode(col)).where(F.trim(F.col(name)) != "")


FEATURES = (
    "features array<struct<properties:struct<neighbourhood:string,neighbourhood_group:string>,"
    "geometry:string>>"
)


def explode_features(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per feature of a FeatureCollection, properties as text, geometry as JSON."""
    parsed = df.withColumn("__doc", F.from_json(F.col(raw), f"struct<{FEATURES.replace('features array', 'features:array')}>"))
    return parsed.select(
        *[c for c in df.columns if c != raw],
        F.explode("__doc.features").alias("__feature"),
    ).select(
        *[c for c in df.columns if c != raw],
        F.col("__feature.properties.neighbourhood").alias("neighbourhood"),
        F.col("__feature.properties.neighbourhood_group").alias("neighbourhood_group"),
        F.col("__feature.geometry").alias("geometry"),
    )


def geojson_feature(geometry: Column, properties: Sequence[str]) -> Column:
    """Feature text with the given columns as properties."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"),
        F.struct(*properties).alias("properties"),
    ))


def pivot_counts(df: DataFrame, keys: Sequence[str], col: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows per value of ``col`` as one column each (name -> value), zeros kept."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(col) == value).alias(name) for name, value in columns.items()]
    )


def one_hot(df: DataFrame, keys: Sequence[str], col: str, columns: Mapping[str, str]) -> DataFrame:
    """0/1 column per value of a stated list."""
    return df.groupBy(*keys).agg(
        *[
            F.coalesce(F.max((F.col(col) == value).cast("int")), F.lit(0)).alias(name)
            for name, value in columns.items()
        ]
    )


def one_hot_found(df: DataFrame, keys: Sequence[str], col: str, most: int = 500) -> DataFrame:
    """0/1 column per value that occurs; more than ``most`` different values are an error, never cut.

    Columns are named after the column and the value, in the order of the values.
    """
    found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} different values")
    columns = {f"{col}_{re.sub('[^0-9a-z]+', '_', str(r[0]).lower()).strip('_')}": r[0] for r in found}
    if len(columns) < len(found):
        raise ValueError(f"Values of {col} give equal column names")
    return one_hot(df, keys, col, columns)


def values_per_key(df: DataFrame, keys: Sequence[str], value: str, number: str) -> DataFrame:
    """One row per value of a key (with its ``number``, an id), and how many the key has.

    The grain is the same at every size: no array is built, so no key is gathered.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    return join_keys(df.select(*keys, number, value), counts, keys)


#: Values of a sorted run, and bytes of a whole list.
LIST_PART, LIST_BYTES = 10_000, 64 << 20


def sorted_runs_of(df: DataFrame, keys: Sequence[str], col: str, sep: str) -> DataFrame:
    """The distinct values of a key as sorted runs of ``LIST_PART`` values: ``__part`` (their order), ``__run`` and ``__n``."""
    unique = df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
    placed = windows.lazy_row_number(unique, keys, [F.col(col).asc()], "__nth")
    return placed.groupBy(*keys, F.floor((F.col("__nth") - 1) / LIST_PART).alias("__part")).agg(
        F.array_join(F.array_sort(F.collect_list(col)), sep).alias("__run"), F.count(F.lit(1)).alias("__n"),
    )


def string_list_distinct(df: DataFrame, keys: Sequence[str], col: str, name: str, sep: str = ", ") -> DataFrame:
    """Distinct values per key as one sorted text.

    Values are sorted in runs, many tasks for a key with many of them, and the runs are
    joined in order.  A list of more than ``LIST_BYTES`` bytes is refused before it is
    put together; :func:`values_per_key` has one row per value at every size.
    """
    runs = sorted_runs_of(df, keys, col, sep)
    sizes = runs.groupBy(*keys).agg(F.sum(F.octet_length("__run")).alias("__bytes"))
    refused = F.raise_error(F.lit(f"A list of {col} has more than {LIST_BYTES} bytes; use one row per value"))
    sized = join_null_safe(runs, sizes, keys).where(F.when(F.col("__bytes") > LIST_BYTES, refused.cast("boolean")).otherwise(True))
    ordered = F.array_sort(F.collect_list(F.struct("__part", "__run")))
    return sized.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda r: r["__run"]), sep).alias(name), F.sum("__n").alias("n_values"),
    )
