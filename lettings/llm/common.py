"""Helpers shared by the operators: words, hashes, running totals, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lettings.operators.joins import join_null_safe
from lettings.session import remove_folder, shared_folder, stable

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
ROWS_PER_BUCKET = 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def n_words(text: Column) -> Column:
    """The number of words as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch in pieces of a bounded number of text bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    piece = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array, separators: str) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and where each text's words begin (one more entry than texts)."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), separators)
    flat = lists.flatten()
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    row = row[full.to_numpy(zero_copy_only=False)]
    counts = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    return flat.filter(full), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), dtype=object)
    return pd.util.hash_array(names, categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (shorter than ``h`` by k - 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= base
        out += h[i : i + n]
    return mix(out)


def starts_with_room(begins: np.ndarray, k: int, total: int) -> np.ndarray:
    """Marks the positions from which ``k`` words of the same text follow."""
    n = max(0, total - k + 1)
    counts = np.diff(begins)
    end = np.repeat(begins[1:], counts)
    return np.arange(n) + k <= end[:n]


SCRATCH: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: columns compress, where a checkpoint keeps plain rows."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SCRATCH.append(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``written`` makes inside, once they are not needed any more."""
    before = len(SCRATCH)
    try:
        yield
    finally:
        for path in SCRATCH[before:]:
            remove_folder(spark, path)
        del SCRATCH[before:]


def numbered_copies(df: DataFrame, keys: Sequence[str], name: str, least: int, counts: DataFrame | None = None) -> DataFrame:
    """Adds ``name``, the place of a row among the rows that are equal in ``keys`` (from 0; nulls are equal).

    Only rows of keys with more than ``least`` rows get places, the others have 0; so where
    no key has, nothing is written or moved but the ``counts`` (by the keys, in ``n``).  The
    rows of such keys are written, so that places are fixed, and counted within the parts
    they were written in; a prefix sum over the parts gives the rest, so many equal rows
    are many tasks.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    crowded = stable(counts.where(F.col("n") > least).select(*keys))
    if crowded.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    same = written(join_null_safe(df, crowded, keys, "left_semi").withColumn("__row", F.monotonically_increasing_id()))
    parts = [*keys, "__part"]
    dealt = same.withColumn("__part", F.shiftright("__row", 33))
    sums = dealt.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*parts).orderBy("__row")) - 1
    numbered = join_null_safe(dealt.withColumn("__inside", inside), sums, parts).withColumn(
        name, F.col("__inside") + F.col("__before")
    ).drop("__row", "__part", "__inside", "__before")
    rest = join_null_safe(df, crowded, keys, "left_anti").withColumn(name, F.lit(0).cast("long"))
    return rest.unionByName(numbered)


def buckets_for(rows: int) -> int:
    """Parts into which so many rows are dealt; it grows with the rows."""
    return max(1, -(-rows // ROWS_PER_BUCKET))


def spread(*parts: Column) -> Column:
    """A number in [0, 2^60) from md5, the same in other engines; nulls count as the text ``null``."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def running_total(df: DataFrame, key: str, order: Sequence[str], weight: Column, name: str, rows: int) -> DataFrame:
    """Sum of ``weight`` over the rows of the key before this one, in ``order``.

    ``key`` has no nulls.  ``order[0]`` is a ``spread`` number; its upper bits cut each key
    into buckets, so that no task gets a whole key: bucket sums are added up first and only
    a bucket is ordered in a task.  ``rows`` is the number of rows of all keys.
    """
    n = buckets_for(rows)
    dealt = df.withColumns({
        "__bucket": F.floor(F.shiftright(F.col(order[0]), 29) * n / float(1 << 31)).cast("int"),
        "__weight": weight.cast("long"),
    })
    sums = dealt.groupBy(key, "__bucket").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__bucket", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return placed.join(sums, [key, "__bucket"]).withColumn(name, F.col("__inside") + F.col("__before")).drop(
        "__bucket", "__weight", "__inside", "__before"
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from each node of the edges: columns ``node`` and ``root``.

    In each round the parent of every node, the node itself and its grandparent move to the
    smallest grandparent among the node's neighbours.  As the parent moves too, whole trees
    are hung on others, and rounds grow with the logarithm of a component's longest path
    (a shuffled path of 10,000 nodes takes 15).  Rows are only ever edges, so a hub has one
    row per neighbour and is summed before it is shuffled.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = stable(links.union(links.select("v", "u")).distinct())
    labels = stable(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f")))
    while True:
        jump = labels.select(F.col("u").alias("f"), F.col("f").alias("g"))
        up = stable(labels.join(jump, "f"))
        around = links.join(up.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        seen = stable(up.join(around, "u"))
        hook = seen.groupBy(F.col("f").alias("u")).agg(F.min("m").alias("h"))
        moved = stable(seen.join(hook, "u", "left").select(
            "u", F.least("f", "g", "m", F.coalesce("h", "f")).alias("new"), F.col("f").alias("old")
        ))
        if moved.where("new < old").isEmpty():
            break
        labels = moved.select("u", F.col("new").alias("f"))
    return labels.select(F.col("u").alias("node"), F.col("f").alias("root"))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal ``keys`` and where the runs begin (and end); the rows come sorted by the keys.

    Only a batch and the run that it cuts are held.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
        edges = run_edges(now, keys)
        if len(edges) > 2:
            yield now.slice(0, edges[-2]), edges[:-1]
        rest = now.slice(edges[-2])
    if rest is not None and len(rest):
        yield rest, run_edges(rest, keys)


def run_edges(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(max(len(rows) - 1, 0), bool)
    for k in keys:
        column = rows[k].to_numpy()
        new |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows)]])


def dealt_by_key(df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The rows of a key together and sorted, for ``sorted_runs``."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *extra)


def in_block_pairs(df: DataFrame, key: str, member: str, blocks: Column, pairs: tuple[str, str]) -> DataFrame:
    """Rows once for each pair of blocks of their key that they belong to (columns ``pairs``).

    A key with one block keeps its rows once; in a full one any two rows meet in a pair of
    blocks, and no task gets more than two of them.
    """
    n = blocks.cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), member), n).cast("int")
    spread_ = df.withColumns({"__own": own, "__n": n})
    spread_ = spread_.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    spread_ = spread_.where((F.col("__n") <= 2) & (F.col("__other") == 0) | (F.col("__n") > 2) & (F.col("__own") != F.col("__other")))
    one = F.col("__n") <= 2
    return spread_.withColumns({
        pairs[0]: F.when(one, 0).otherwise(F.least("__own", "__other")),
        pairs[1]: F.when(one, 0).otherwise(F.greatest("__own", "__other")),
    }).drop("__own", "__n", "__other")
