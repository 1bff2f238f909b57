"""Deduplication, ranks and shares that do not gather a hot key in one task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lettings.functions import measures
from lettings.operators.joins import at_most, join_null_safe
from lettings.operators.quantiles import _bucket as value_bucket
from lettings.session import stable


def dedup_latest(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first one in ``order``.

    Spark turns the rank filter into a group limit that runs before the shuffle,
    so a key with very many copies sends one row per map task.
    """
    return top_k_per(df, keys, 1, order)


def top_k_per(df: DataFrame, keys: Sequence[str | Column], k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def load_order(df: DataFrame, *extra: Column) -> list[Column]:
    """Newest load first, then ``extra``, then file and row so that ties are decided.

    Without any of these the values themselves give the order.
    """
    order = [F.col("_load_ts").desc_nulls_last()] if "_load_ts" in df.columns else []
    order += list(extra)
    for name in ("_filename", "_file_row_number"):
        if name in df.columns:
            order.append(F.col(name).asc_nulls_last())
    return order or [F.col(c).asc_nulls_last() for c, kind in df.dtypes if "<" not in kind]


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact row numbers per key (or over all rows) without a task per key.

    The rows are range-partitioned by key and order and cut loose from their
    lineage, so that positions are fixed; the number is the position in its
    partition plus the count of the key's rows in earlier partitions.  Only one
    count per key and partition is ever gathered.
    """
    ranged = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    placed = df.repartitionByRange(*ranged).sortWithinPartitions(*ranged)
    placed = stable(placed.withColumn("__at", F.monotonically_increasing_id()))
    return running_number(placed, keys, "__at", name).drop("__at")


def running_number(df: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """Number rows per key by ``at``, an id whose high bits are the partition."""
    part = F.shiftright(F.col(at), 33)
    runs = df.groupBy(*keys, part.alias("__part")).agg(
        F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    numbered = join_null_safe(df.withColumn("__part", part), runs, [*keys, "__part"])
    return numbered.withColumn(name, F.col(at) - F.col("__first") + F.col("__before") + 1).drop(
        "__part", "__first", "__before"
    )


SortKey = tuple[str, bool, bool]
_ORDERED = re.compile(r"^Column<'(.+) (ASC|DESC) NULLS (FIRST|LAST)'>$", re.DOTALL)
NULL_BUCKET = 1 << 60
MOST_PARTS = 1_000


def sort_keys(df: DataFrame, order: Sequence[Column]) -> list[SortKey]:
    """Name, whether ascending, and whether NULL comes first, of sort columns that are plain columns of ``df``."""
    found = []
    for c in order:
        match = _ORDERED.match(str(c))
        if not match or match[1] not in df.columns:
            raise ValueError(f"Rows are ordered by plain columns, not by {c}")
        found.append((match[1], match[2] == "ASC", match[3] == "FIRST"))
    return found


def order_bucket(df: DataFrame, key: SortKey) -> Column:
    """A number that never falls in the order of the sort column: numbers and times by magnitude, texts by their first bytes."""
    name, ascending, nulls_first = key
    value, kind = F.col(name), dict(df.dtypes)[name]
    if kind == "string":
        place = F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    elif kind == "date":
        place = F.unix_date(value).cast("long")
    elif kind.startswith("timestamp"):
        place = value_bucket(F.unix_micros(value.cast("timestamp")).cast("double"))
    elif kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        place = value_bucket(value.cast("int").cast("double") if kind == "boolean" else value.cast("double"))
    else:
        place = F.when(value.isNotNull(), F.lit(0).cast("long"))
    return F.coalesce(place if ascending else -place, F.lit(-NULL_BUCKET if nulls_first else NULL_BUCKET))


BUCKET = ["__g", "__b1", "__v", "__b2"]


def dealt_in_order(df: DataFrame, keys: Sequence[str], by: Sequence[SortKey]) -> DataFrame:
    """Rows with their key as one value, and what they are counted by: a bucket of the first sort column, its value,
    and a bucket of the second one.

    Structs make one value of NULLs too.
    """
    whole = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    second = order_bucket(df, by[1]) if len(by) > 1 else F.lit(0).cast("long")
    return df.withColumns({
        "__g": whole, "__b1": order_bucket(df, by[0]), "__v": F.struct(F.col(by[0][0]).alias("v")), "__b2": second,
    })


def bucket_starts(dealt: DataFrame, by: Sequence[SortKey]) -> DataFrame:
    """Per bucket the rows before it, its rows and all rows of the key, from combined counts.

    Counts are summed up over the buckets of the first sort column, in each of these over
    its values, and for each value over the buckets of the second sort column, so neither a
    key nor a value that many rows share is one task.
    """
    earlier = (Window.unboundedPreceding, -1)

    def before(keys: list[str], order: Column, n: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*earlier)), F.lit(0))

    fine = dealt.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    middle = fine.groupBy("__g", "__b1", "__v").agg(F.sum("__n").alias("__n2"))
    coarse = middle.groupBy("__g", "__b1").agg(F.sum("__n2").alias("__n1"))
    coarse = coarse.select(
        "__g", "__b1", before(["__g"], F.col("__b1"), "__n1").alias("__lead"),
        F.sum("__n1").over(Window.partitionBy("__g")).alias("__total"),
    )
    value = F.col("__v.v").asc() if by[0][1] else F.col("__v.v").desc()
    middle = middle.withColumn("__middle", before(["__g", "__b1"], value, "__n2"))
    fine = fine.withColumn("__inner", before(["__g", "__b1", "__v"], F.col("__b2"), "__n"))
    both = fine.join(middle.drop("__n2"), ["__g", "__b1", "__v"]).join(coarse, ["__g", "__b1"])
    return both.select(*BUCKET, (F.col("__lead") + F.col("__middle") + F.col("__inner")).alias("__before"), "__n", "__total")


def lazy_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact row numbers per key without a job of its own.

    Combined counts per bucket of the order tell how many rows come before a bucket; only
    the rows of a bucket are sorted in one task.
    """
    by = sort_keys(df, order)
    dealt = dealt_in_order(df, keys, by)
    inside = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(*order))
    both = dealt.join(bucket_starts(dealt, by).select(*BUCKET, "__before"), BUCKET)
    return both.withColumn(name, F.col("__before") + inside).select(*[c for c in df.columns if c != name], name)


def rank_by(df: DataFrame, score: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Global rank, highest score first."""
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return lazy_row_number(df, [], order, name)


def comes_after(by: Sequence[SortKey], bound: Column) -> Column:
    """Whether a row stands behind the row ``bound`` in the order."""
    after, same = F.lit(False), F.lit(True)
    for name, ascending, nulls_first in by:
        mine, other = F.col(name), bound[name]
        behind = mine > other if ascending else mine < other
        only_one = (mine.isNull() & other.isNotNull()) if not nulls_first else (mine.isNotNull() & other.isNull())
        after = after | (same & F.coalesce(behind, only_one))
        same = same & mine.eqNullSafe(other)
    return after


def tile_bounds(dealt: DataFrame, by: Sequence[SortKey], order: Sequence[Column], n: int) -> DataFrame:
    """Per key the last rows of its first n - 1 tiles, found in the buckets that hold them."""
    small, extra = F.floor(F.col("__total") / n), F.col("__total") % n
    ends = F.array_distinct(F.array(*[F.lit(j) * small + F.least(F.lit(j), extra) for j in range(1, n)]))
    held = F.filter(ends, lambda e: (e > F.col("__before")) & (e <= F.col("__before") + F.col("__n")))
    hits = bucket_starts(dealt, by).select(*BUCKET, "__before", held.alias("__ends")).where(F.size("__ends") > 0)
    inside = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(*order))
    near = dealt.select(*BUCKET, *[k[0] for k in by]).join(hits, BUCKET).withColumn("__place", F.col("__before") + inside)
    bound = F.struct("__place", *[k[0] for k in by])
    return near.where(F.array_contains("__ends", F.col("__place"))).groupBy("__g").agg(F.array_sort(F.collect_list(bound)).alias("__bounds"))


def tiles(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """NTILE(n) per key: each row is compared with the last rows of the tiles, so rows need no numbers.

    Rows that are equal in all of ``order`` come in one tile.
    """
    if n < 2:
        return df.withColumn(name, F.lit(1))
    by = sort_keys(df, order)
    dealt = dealt_in_order(df, keys, by)
    both = dealt.join(tile_bounds(dealt, by, order, n), "__g", "left")
    passed = F.size(F.filter(F.coalesce("__bounds", F.array()), lambda b: comes_after(by, b)))
    return both.withColumn(name, (passed + 1).cast("int")).select(*[c for c in df.columns if c != name], name)


def top_quartile(df: DataFrame, area: str, measure: str, tie: str) -> DataFrame:
    """Marks the first of four tiles per area ``top``, the others ``rest``."""
    order = [F.col(measure).desc_nulls_last(), F.col(tie).asc()]
    tiled = tiles(df, [area], order, 4, "__tile")
    label = F.when(F.col("__tile") == 1, F.lit("top")).otherwise(F.lit("rest"))
    return tiled.withColumn("segment", label).drop("__tile")


def share_of_partition(df: DataFrame, keys: Sequence[str], value: str, name: str, digits: int = 1) -> DataFrame:
    """Percent of the key's total; totals are pre-aggregated instead of windowed."""
    totals = df.groupBy(*keys).agg(measures.exact_sum(value).alias("__total"))
    both = join_null_safe(df, totals, keys)
    return both.withColumn(name, measures.ratio(F.col(value) * 100, "__total", digits)).drop("__total")


def minmax_by(
    df: DataFrame, part: str, signals: dict[str, tuple[str, bool]], fixed_parts: bool = False
) -> DataFrame:
    """Min-max signals per part: new name -> (column, inverted).

    Bounds are aggregated and joined back, so no part is gathered in one task.
    ``fixed_parts`` says that the part comes from a fixed list of ``MOST_PARTS`` labels at most (the job fails else), which
    bounds the joined side and lets it be broadcast.
    """
    used = sorted({c for c, _ in signals.values()})
    bounds = df.groupBy(part).agg(
        *[F.min(c).alias(f"__min_{c}") for c in used],
        *[F.max(c).alias(f"__max_{c}") for c in used],
    )
    bounds = F.broadcast(at_most(bounds, MOST_PARTS)) if fixed_parts else bounds
    both = join_null_safe(df, bounds, [part])
    return both.select(
        *df.columns,
        *[
            measures.min_max(F.col(c), F.col(f"__min_{c}"), F.col(f"__max_{c}"), inv).alias(name)
            for name, (c, inv) in signals.items()
        ],
    )


def top_k(df: DataFrame, k: int, score: str, ties: Sequence[str]) -> DataFrame:
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return df.orderBy(*order).limit(k)


def top_bottom(
    df: DataFrame, score: str, ties: Sequence[str], n: int = 10, k: int = 3, min_n: int = 6
) -> DataFrame:
    """Mean score of the first and last ``k`` of the top ``n`` and their gap.

    Empty below ``min_n`` rows.  Only the ``n`` listed rows meet in one task.
    """
    best = top_k(df, n, score, ties)
    order = [F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    everything = Window.partitionBy(F.lit(1))
    ranked = best.select(
        F.col(score).alias("__score"),
        F.row_number().over(everything.orderBy(*order)).alias("__at"),
        F.count(F.lit(1)).over(everything).alias("__n"),
    )
    top, bottom = F.col("__at") <= k, F.col("__at") > F.col("__n") - k
    result = ranked.agg(
        F.count(F.lit(1)).alias("listings"),
        measures.mean(F.when(top, F.col("__score"))).alias("avg_top_score"),
        measures.mean(F.when(bottom, F.col("__score"))).alias("avg_bottom_score"),
    )
    return result.where(F.col("listings") >= min_n).withColumn(
        "score_gap", F.col("avg_top_score") - F.col("avg_bottom_score")
    )
