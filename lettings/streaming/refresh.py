"""Incremental and full refresh of tables.

Medians cannot be kept as running state, so a refresh recomputes the keys that
a batch touched from the stored rows.  Every write replaces the partitions of its
batch, so a batch that is run again after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lettings.operators import joins, windows
from lettings.session import remove_folder
from lettings.sources import tables

Build = Callable[[DataFrame], DataFrame]
BUCKETS = 64


def bucket_of(keys: Sequence[str]) -> Column:
    """A fixed number of parts of the key space; NULL keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def known(unique: Sequence[str]) -> Column:
    """Whether a row has a whole unique id; without one it never replaces another row."""
    return reduce(lambda a, b: a & b, [F.col(u).isNotNull() for u in unique])


def index_path(store: str) -> str:
    return f"{store.rstrip('/')}_index"


def staged_path(store: str) -> str:
    return f"{store.rstrip('/')}_staged"


def staged(df: DataFrame, store: str, name: str) -> DataFrame:
    """Rows of the current batch, written once and read by each of its later steps."""
    path = f"{staged_path(store)}/{name}"
    tables.write_replace(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values_of(df: DataFrame, column: str) -> list[int]:
    """The parts that rows fall in, ``BUCKETS`` at most."""
    return [r[0] for r in df.select(column).distinct().collect()]


def parts_read(spark: SparkSession, path: str, schema: StructType, part: str, parts: Sequence[int]) -> DataFrame:
    """The rows of some parts of a partitioned table; files of other parts are not opened."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.col(part).isin(list(parts))) if parts else rows.limit(0)


def moved_away(rows: DataFrame, store: str, keys: Sequence[str], unique: Sequence[str], batch_id: int) -> DataFrame:
    """The former keys of unique ids that come again under another key, looked up in the index.

    The index has a row per id and batch with the key it had there, in parts by the hash of
    the id, so only the parts of the given ids are read.
    """
    ids = rows.where(known(unique)).withColumn("part", bucket_of(unique))
    schema = ids.select(*dict.fromkeys([*unique, *keys]), F.lit(0).cast("long").alias("batch"), "part").schema
    index = parts_read(rows.sparkSession, index_path(store), schema, "part", values_of(ids, "part"))
    index = index.where(F.col("batch") < batch_id)
    last = windows.dedup_latest(joins.join_semi(index, ids, unique), unique, [F.col("batch").desc()])
    now = ids.select(*unique, *[F.col(k).alias(f"__{k}") for k in keys if k not in unique])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys if k not in unique], F.lit(True))
    return last.join(now, list(unique)).where(~same).select(*dict.fromkeys([*unique, *keys]))


def newest_versions(rows: DataFrame, keys: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Per key and unique id the row of the last batch, unless the id has moved away; rows without an id all stay."""
    last = windows.dedup_latest(rows.where(known(unique)), list(dict.fromkeys([*keys, *unique])), [F.col("batch").desc()])
    return last.where(~F.col("gone")).unionByName(rows.where(~known(unique)))


def refresh_incremental(
    stream: DataFrame, store: str, target: str, keys: Sequence[str], place: Build, build: Build, checkpoint: str,
    unique: Sequence[str] = (),
) -> None:
    """Runs all waiting files and recomputes the touched keys of ``target``.

    ``place`` maps new rows to store rows with the ``keys``; ``build`` makes target rows
    from store rows.  Store rows are kept per batch in buckets of their keys, so only the
    touched buckets are read again.

    With ``unique``, a row that comes again in a later batch replaces the earlier one, also
    where it moves to another key: an index beside the store tells the key it had, which
    gets a row that marks it as gone, so a key's own bucket always tells what is left of it.
    Of several rows of one id in a batch the newest load counts.  Rows without a whole id
    (a NULL in ``unique``) replace nothing and stay.

    The target keeps what each batch wrote for the keys it touched, a key that has become
    empty as a row that is not alive; :func:`current` reads the newest state.

    A batch's rows are placed once and kept beside the store until the run ends, as several
    steps need them; so are the rows that ``build`` makes.
    """
    keys, unique = list(keys), list(unique)
    spark = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = staged(place(batch), store, "placed")
        shape = rows.columns
        if unique:
            one = windows.dedup_latest(rows.where(known(unique)), unique, windows.load_order(rows))
            rows = staged(one.unionByName(rows.where(~known(unique))), store, "unique")
            away = moved_away(rows, store, keys, unique, batch_id).withColumn("gone", F.lit(True))
            rows = rows.withColumn("gone", F.lit(False)).unionByName(away, allowMissingColumns=True)
        rows = rows.withColumns({"batch": F.lit(batch_id).cast("long"), "bucket": bucket_of(keys)})
        tables.replace_keys(rows, store, ["batch", "bucket"])
        stored = spark.read.schema(rows.schema).parquet(store).where(F.col("batch") <= batch_id)
        new = stored.where(F.col("batch") == batch_id)
        if unique:
            entries = new.where(known(unique) & ~F.col("gone")).withColumn("part", bucket_of(unique))
            tables.replace_keys(
                entries.select(*dict.fromkeys([*unique, *keys]), "batch", "part"), index_path(store), ["batch", "part"])
        touched = new.select(*keys, "bucket").distinct()
        near = parts_read(spark, store, rows.schema, "bucket", values_of(touched, "bucket")).where(F.col("batch") <= batch_id)
        again = join_keys_semi(near, touched, keys)
        if unique:
            again = newest_versions(again, keys, unique)
        made = staged(build(again.select(*shape)), store, "made").withColumn("alive", F.lit(True))
        dead = anti(touched.select(*keys), made, keys).withColumn("alive", F.lit(False))
        result = made.unionByName(dead, allowMissingColumns=True)
        tables.replace_keys(result.withColumn("batch", F.lit(batch_id)), target, ["batch"])

    if unique:  # the index has to be there before its first rows
        shape = StructType([StructField("batch", LongType()), StructField("part", IntegerType())])
        tables.write_append(spark.createDataFrame([], shape).withColumn("none", F.lit(0)), index_path(store), ["batch", "part"])
    query = (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    remove_folder(spark, staged_path(store))


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right[f"__{k}"])
    return test


def join_keys_semi(df: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys occur in ``touched``; NULL equals NULL."""
    side = touched.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return df.join(side, _equal(df, side, keys), "left_semi")


def anti(touched: DataFrame, made: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = made.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return touched.join(side, _equal(touched, side, keys), "left_anti")


def current(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """The target as of now: per key the rows of the last batch that touched it."""
    keys = list(keys)
    rows = spark.read.parquet(target)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("__batch"))
    last = last.select(*[F.col(k).alias(f"__{k}") for k in keys], "__batch")
    newest = rows.join(last, _equal(rows, last, keys) & (rows["batch"] == last["__batch"]), "left_semi")
    return newest.where("alive").drop("alive", "batch")


def compact(spark: SparkSession, target: str, keys: Sequence[str], into: str) -> None:
    """The current state as a target of one batch, in a new folder; later batches go on from there."""
    last = spark.read.parquet(target).agg(F.max("batch")).first()[0]
    state = current(spark, target, keys).withColumns({"alive": F.lit(True), "batch": F.lit(last)})
    tables.write_replace(state, into, ["batch"])


def append_projection(stream: DataFrame, project: Build, target: str, checkpoint: str) -> None:
    """Stateless projection appended once per input row."""
    query = (
        project(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def refresh_full(build: Callable[[], DataFrame], target: str) -> None:
    """The whole table anew."""
    tables.write_replace(build(), target)


def files_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder in batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
