"""Exact grouped quantiles that never gather a group.

``percentile`` merges all distinct values of a group in one task.  Here the
values are first counted (a map-side combined aggregate), the counts are rolled
up into ordered buckets, the bucket that holds the wanted rank is found from the
few bucket totals, and only that bucket's distinct values are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lettings.operators.joins import join_null_safe

BUCKETS_PER_OCTAVE = 1 << 14
FIRST_OCTAVE = 1100  # below any exponent of a double


def _bucket(v: Column) -> Column:
    """Order-preserving bucket of a double: each power of two has the same number, at every magnitude.

    As in Spark's order, NaN is the largest value, after infinity.
    """
    size = F.abs(v)
    octave = F.floor(F.log2(size)).cast("double")
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * BUCKETS_PER_OCTAVE)
    place = ((octave + FIRST_OCTAVE) * BUCKETS_PER_OCTAVE + inside).cast("bigint")
    end = 4 * FIRST_OCTAVE * BUCKETS_PER_OCTAVE
    return (
        F.when(F.isnan(v), F.lit(end + 1)).when(v == 0, F.lit(0))
        .when(size == float("inf"), F.signum(v).cast("bigint") * end).otherwise(F.signum(v).cast("bigint") * place)
    ).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Rows per key, measure name and distinct value; NULL values are left out."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("name"), c.cast("double").alias("value"))
        for name, c in measures.items()
    ])
    long = df.select(*keys, F.inline(pairs).alias("__name", "__value"))
    return (
        long.where(F.col("__value").isNotNull())
        .groupBy(*keys, "__name", "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def ranked_values(counts: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """The values on either side of each wanted rank.

    One row per key, measure and distinct value of the buckets that matter, with
    the list ``__at`` of (point, share above the lower rank, is lower, is upper).
    """
    group = [*keys, "__name"]
    counts = counts.withColumn("__bucket", _bucket(F.col("__value")))
    totals = counts.groupBy(*group, "__bucket").agg(F.sum("__n").alias("__in_bucket"))
    over_all = Window.partitionBy(*group)
    totals = totals.select(
        *group, "__bucket",
        F.sum("__in_bucket").over(over_all.orderBy("__bucket")).alias("__upto"),
        F.sum("__in_bucket").over(over_all).alias("__all"), "__in_bucket",
    )
    start = F.col("__upto") - F.col("__in_bucket")

    def touches(h: Column) -> Column:
        return (F.ceil(h) >= start) & (F.floor(h) < F.col("__upto"))

    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("__all") - 1)).alias("h")) for p in points
    ])
    hits = totals.select(
        *group, "__bucket", start.alias("__start"),
        F.filter(wanted, lambda w: touches(w["h"])).alias("__wanted"),
    ).where(F.size("__wanted") > 0)
    found = join_null_safe(counts, hits, [*group, "__bucket"])
    inside = Window.partitionBy(*group, "__bucket").orderBy("__value")
    found = found.withColumn("__upto", F.col("__start") + F.sum("__n").over(inside))
    first = F.col("__upto") - F.col("__n")

    def holds(index: Column) -> Column:
        return (index >= first) & (index < F.col("__upto"))

    at = F.transform("__wanted", lambda w: F.struct(
        w["p"].alias("p"), (w["h"] - F.floor(w["h"])).alias("share"),
        holds(F.floor(w["h"])).alias("low"), holds(F.ceil(w["h"])).alias("high"),
    ))
    near = F.filter(at, lambda w: w["low"] | w["high"])
    return found.select(*group, "__value", near.alias("__at")).where(F.size("__at") > 0)


def interpolated(name: str | None, point: float) -> Column:
    """Aggregate over :func:`ranked_values`: the quantile of a measure at a point."""
    def part(side: str, field: str | None = None) -> Column:
        mine = F.filter("__at", lambda w: (w["p"] == F.lit(float(point))) & w[side])
        test = F.size(mine) > 0
        if name is not None:
            test = test & (F.col("__name") == name)
        value = F.col("__value") if field is None else F.get(mine, 0)[field]
        return F.max(F.when(test, value))

    low = part("low")
    return low + (part("high") - low) * part("low", "share")


def quantiles_from_counts(counts: DataFrame, keys: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """Interpolated quantiles per key and measure: output name -> point."""
    near = ranked_values(counts, keys, sorted(set(points.values())))
    return near.groupBy(*keys, "__name").agg(*[interpolated(None, p).alias(n) for n, p in points.items()])


def quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]]
) -> DataFrame:
    """Exact interpolated quantiles: output name -> (measure, point)."""
    counts = value_counts(df, keys, {name: c for name, (c, _) in wanted.items()})
    near = ranked_values(counts, keys, sorted({p for _, p in wanted.values()}))
    return near.groupBy(*keys).agg(*[interpolated(n, p).alias(n) for n, (_, p) in wanted.items()])


def medians(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return quantiles(df, keys, {name: (c, 0.5) for name, c in measures.items()})


def agg_with_medians(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], measures: Mapping[str, Column]
) -> DataFrame:
    """Plain aggregates and exact medians of the same groups.

    The two results are stacked and folded by key: at most two rows per group
    move, and NULL keys need no special join.
    """
    plain = df.groupBy(*keys).agg(*aggregates)
    middle = medians(df, keys, measures)
    stacked = plain.unionByName(middle, allowMissingColumns=True)
    columns = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])
