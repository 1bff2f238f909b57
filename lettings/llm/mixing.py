"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lettings.llm.common import n_words, numbered_copies, running_total, spread
from lettings.session import stable

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT = 1.5, 2.0
BLOCK, SHARDS, SEED = 64, 16, "mix-1"
BROADCAST_SOURCES = 10_000
EQUAL_ROWS = 1_000  # so many rows of one id, source and text may stand in one bucket


@dataclass(frozen=True)
class Plan:
    """What was decided per source: one entry each, in source order."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    quotas: np.ndarray  # shards x sources
    rows: int
    block: int
    limit: float


def source_targets(sizes: Sequence[int], weights: Sequence[float], share: float, limit: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``limit`` times a size goes to the others."""
    total, caps = share * sum(sizes), [limit * s for s in sizes]
    full = [False] * len(sizes)
    while True:
        rest = total - sum(c for c, f in zip(caps, full, strict=True) if f)
        over = sum(w for w, f in zip(weights, full, strict=True) if not f)
        unit = rest / over if over else 0.0
        above = [not f and unit * w > c for w, c, f in zip(weights, caps, full, strict=True)]
        if not any(above):
            return [c if f else unit * w for w, c, f in zip(weights, caps, full, strict=True)]
        full = [f or a for f, a in zip(full, above, strict=True)]


def apportion(votes: Sequence[float], seats: int) -> np.ndarray:
    """Seats by the highest quotients v / (2k + 1); of equal quotients the earlier source is first.

    A divisor just above the right one gives nearly all seats at once, the last few
    go one by one.
    """
    v = np.asarray(votes, float)
    if seats <= 0 or v.sum() <= 0:
        return np.zeros(len(v), np.int64)
    low, high = 0.0, 2 * v.max()
    for _ in range(100):
        mid = (low + high) / 2
        if mid > 0 and np.floor(v / mid + 0.5).sum() <= seats:
            high = mid
        else:
            low = mid
    got = np.floor(v / (high * (1 + 1e-9)) + 0.5).astype(np.int64)
    heap = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if v[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-v[i] / (2 * got[i] + 1), i))
    return got


def block_words(targets: Sequence[float], block: int) -> int:
    """Words of a block: at most a sixteenth of the smallest target, so that small sources come near theirs."""
    some = [t for t in targets if t > 0]
    return max(1, min(block, int(min(some) / 16))) if some else block


def plan_mix(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT,
    block: int = BLOCK, shards: int = SHARDS,
) -> Plan:
    """Targets and quotas from the sizes per source (columns ``source``, ``size``); blocks have ``block`` words or fewer.

    One summed row per source reaches the driver; a mix names its sources.  The divisor
    method is house monotone, so the quotas of a shard are the seats that it adds.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in per]
    targets = source_targets(sizes, [weights[i % len(weights)] for i in range(len(per))], share, limit)
    block = block_words(targets, block)
    seats = int(sum(targets) / block + 1e-9)
    steps = [apportion(targets, seats * s // shards) for s in range(shards + 1)]
    quotas = np.diff(np.array(steps).reshape(shards + 1, len(per)), axis=0)
    return Plan([r["source"] for r in per], sizes, targets, quotas, sum(r["n"] for r in per), block, limit)


def quotas(spark, plan: Plan) -> DataFrame:
    """Integer quota of blocks per source and shard."""
    rows = [
        (name, shard, int(plan.quotas[shard, i]))
        for i, name in enumerate(plan.sources) for shard in range(plan.quotas.shape[0])
    ]
    kinds = StructType([
        StructField("source", StringType()), StructField("shard", IntegerType()), StructField("quota", LongType()),
    ])
    return spark.createDataFrame(rows, kinds)


def mix(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED,
    keep_text: bool = True, **how,
) -> DataFrame:
    """Adds size, source_size, target, taken and shard to each row.

    A source's documents stand in seeded order and their words form a stream that is cut
    into equal blocks; the source gives its quota of blocks from the stream, which begins
    anew at its end as often as ``limit`` allows, so no word is taken more often.  Documents are
    taken whole but for those at the end of a quota.  ``shard`` is the shard of the first
    block in which the document begins (null if nothing is taken).

    Null, empty and blank texts have size 0 and nothing taken; null sources are one source,
    sorted last; repeated rows count separately; an empty table gives no rows; columns of
    the same name as an added one are replaced.
    """
    sized = docs.withColumns({"source": F.col(source), "size": n_words(F.col(text))})
    sized = sized.withColumn("__same", F.xxhash64(F.col(text)))
    if not keep_text:  # then the sizes alone are written, and texts are read once
        sized = stable(sized.drop(text))
    sized = numbered_copies(sized, ["source", doc_id, "size", "__same"], "__nth", EQUAL_ROWS)
    return mix_sized(sized, doc_id, seed, plan_mix(sized.select("source", "size"), **how))


def mix_sized(sized: DataFrame, doc_id: str, seed: str, plan: Plan) -> DataFrame:
    """``mix`` for rows that have ``source``, ``size``, a hash ``__same`` of the text and a number ``__nth`` among equal rows."""
    spark = sized.sparkSession
    until = np.cumsum(plan.quotas, axis=0) if len(plan.sources) else plan.quotas
    rows = [
        (key_of(name), size, target, min(int(until[-1, i]) * plan.block, int(plan.limit * size)), until[:, i].tolist())
        for i, (name, size, target) in enumerate(zip(plan.sources, plan.sizes, plan.targets, strict=True))
    ]
    kinds = "__key string, source_size long, target double, __until long, __quota array<long>"
    per = spark.createDataFrame(rows, kinds)
    per = F.broadcast(per) if len(rows) <= BROADCAST_SOURCES else per
    alone = F.col(doc_id).isNotNull() & (F.col("__nth") == 0)  # rows without an id or of equal ones are told apart
    keyed = sized.drop("source_size", "target", "taken", "shard").withColumns({
        "__key": F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))),
        "__at": F.when(alone, spread(F.lit(seed), F.col(doc_id))).otherwise(
            spread(F.lit(seed), F.col(doc_id), F.col("__same"), F.col("__nth"))),
    }).drop("__same", "__nth")
    placed = running_total(keyed, "__key", ["__at", doc_id, "size"], F.col("size"), "__from", plan.rows)
    both = placed.join(per, "__key")

    def part(shift: Column) -> Column:
        def inside(x: Column) -> Column:
            return F.least(F.greatest(x + shift, F.lit(0)), F.col("__until"))
        return inside(F.col("__from") + F.col("size")) - inside(F.col("__from"))

    taken = sum((part(F.col("source_size") * k) for k in range(1, math.ceil(plan.limit))), part(F.lit(0)))
    block = F.floor(F.col("__from") / F.lit(plan.block))
    shard = F.size(F.filter("__quota", lambda q: q <= block))
    return both.withColumn("taken", taken.cast("long")).withColumn(
        "shard", F.when(F.col("taken") > 0, F.least(shard, F.lit(plan.quotas.shape[0] - 1)))
    ).drop("__key", "__at", "__from", "__until", "__quota")


def key_of(source: str | None) -> str:
    return "-" if source is None else f"+{source}"


def taken_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that the mix takes: each document as often as it is taken, to the nearest whole document."""
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*columns)


ORACLE = f"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15)) as bigint) as h
  from documents),
per as (
  select source, sum(size) as size,
    [5e0, 2e0, 1e0][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as w,
    row_number() over (order by encode(source) nulls last) as place
  from sized group by source),
filled as (
  select *, sum(2e0 * size) over (order by size / w, place rows between unbounded preceding and 1 preceding) as caps,
    sum(w) over (order by size / w, place rows between current row and unbounded following) as rest
  from per),
unit as (
  select max(({SHARE} * (select sum(size) from per) - coalesce(caps, 0)) / rest) filter (
    where ({SHARE} * (select sum(size) from per) - coalesce(caps, 0)) / rest * w <= 2e0 * size) as u from filled),
targets as (select per.*, least(2e0 * size, u * w) as target from per, unit),
blocks as (
  select greatest(1, least({BLOCK}, cast(floor(coalesce(min(target) filter (where target > 0), {BLOCK} * 16) / 16) as bigint))) as b
  from targets),
seats as (select cast(floor(sum(target) / any_value(b) + 1e-9) as bigint) as n from targets, blocks),
quotients as (
  select source, place, row_number() over (order by target / (2 * k + 1) desc, place) as nth
  from (select *, unnest(range(0, cast(floor(2e0 * size / b) as bigint) + 2)) as k from targets, blocks)),
quota as (select source, count(*) filter (where nth <= (select n from seats)) as q from quotients group by source),
placed as (
  select s.*, t.size as source_size, t.target,
    least(coalesce(q, 0) * (select b from blocks), 2 * t.size) as until,
    sum(s.size) over (partition by s.source order by h, doc_id, s.size rows unbounded preceding) - s.size as a
  from sized s join targets t on s.source is not distinct from t.source
    left join quota on s.source is not distinct from quota.source)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(least(a + size, until) - least(a, until)
    + least(a + size + source_size, until) - least(a + source_size, until) as bigint) as taken
from placed
"""
