"""Incremental refresh equals a batch build: later versions win, emptied keys go, key types stay."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lettings.streaming import refresh

WAVES = [
    [(1, "a", 1), (2, "a", 2), (3, "b", 5), (4, "01", 1), (5, "1", 2), (6, None, 3), (7, "2024-01-01", 4)],
    [(1, "b", 10), (2, "b", 7), (6, None, 4)],  # every row of a moves to b
    [(4, "1", 1)],  # and 01 becomes empty
]


@pytest.fixture
def folders(spark, tmp_path):
    def run(waves):
        for rows in waves:
            spark.createDataFrame(rows, "id int, k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1)  # files are taken in order of their change time
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = refresh.files_stream(spark, str(tmp_path / "in"), schema)
        refresh.refresh_incremental(
            stream, str(tmp_path / "store"), str(tmp_path / "out"), ["k"], lambda b: b,
            lambda s: s.groupBy("k").agg(F.sum("v").alias("total")), str(tmp_path / "chk"), unique=["id"])
        state = refresh.current(spark, str(tmp_path / "out"), ["k"])
        assert dict(state.dtypes)["k"] == "string"
        return {r.k: r.total for r in state.collect()}
    return run, tmp_path


def batch_build(waves):
    newest = {}
    for rows in waves:
        for i, k, v in rows:
            newest[i] = (k, v)
    totals = {}
    for k, v in newest.values():
        totals[k] = totals.get(k, 0) + v
    return totals


def test_refresh_equals_batch_build(spark, folders):
    run, path = folders
    assert run(WAVES[:1]) == batch_build(WAVES[:1])
    assert run(WAVES[1:]) == batch_build(WAVES) == {"b": 22, "1": 3, None: 4, "2024-01-01": 4}
    assert run([]) == batch_build(WAVES)
    refresh.compact(spark, str(path / "out"), ["k"], str(path / "compact"))
    state = refresh.current(spark, str(path / "compact"), ["k"]).collect()
    assert {r.k: r.total for r in state} == batch_build(WAVES)


def refreshed(spark, base, waves, wave_names, unique=("id",)):
    """Runs each wave as its own batch; returns the totals per key."""
    for name, rows in zip(wave_names, waves, strict=True):
        spark.createDataFrame(rows, "id int, k string, v int").coalesce(1).write.parquet(f"{base}/in/{name}")
        stream = refresh.files_stream(spark, f"{base}/in/*", spark.read.parquet(f"{base}/in/{name}").schema)
        refresh.refresh_incremental(
            stream, f"{base}/store", f"{base}/out", ["k"], lambda b: b,
            lambda s: s.groupBy("k").agg(F.sum("v").alias("total")), f"{base}/chk", unique=list(unique))
    return {r.k: r.total for r in refresh.current(spark, f"{base}/out", ["k"]).collect()}


def bucket(spark, names, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"{names[0]} {kind}")
    return dict(zip(values, [r[0] for r in df.select(refresh.bucket_of(names)).collect()], strict=True))


def test_a_batch_opens_only_the_buckets_it_touches(spark, tmp_path):
    """All other files of the store and its index are broken between the batches, so opening one would fail."""
    first = [(i, f"k{i % 40}", 1) for i in range(400)]
    refreshed(spark, str(tmp_path), [first], ["a"])
    second = [(3, "k7", 5), (1000, "new", 1)]  # id 3 moves from k3 to k7
    keys = bucket(spark, ["k"], ["k3", "k7", "new"], "string")
    parts = bucket(spark, ["id"], [3, 1000], "int")
    broken = 0
    for folder, name, kept in (("store", "bucket", set(keys.values())), ("store_index", "part", set(parts.values()))):
        for file in (tmp_path / folder).glob("batch=*/*/*.parquet"):
            if int(file.parent.name.removeprefix(f"{name}=")) not in kept:
                file.write_bytes(b"not parquet")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
                broken += 1
    assert broken > 60
    got = refreshed(spark, str(tmp_path), [second], ["b"])
    assert got == batch_build([first, second])


def test_rows_without_a_unique_id_stay(spark, tmp_path):
    waves = [[(None, "a", 1), (1, "a", 2)], [(None, "a", 4), (1, "b", 8)], [(None, None, 16), (1, "a", 32), (None, "b", 64)]]
    assert refreshed(spark, str(tmp_path), waves, "abc") == {"a": 1 + 4 + 32, "b": 64, None: 16}


def test_many_moves_equal_a_batch_build(spark, tmp_path):
    rng = random.Random(9)
    waves = [
        [(i, rng.choice(["a", "b", "c", "d", None]), rng.randrange(100)) for i in rng.sample(range(30), 14)] for _ in range(5)
    ]
    assert refreshed(spark, str(tmp_path), waves, "abcde") == batch_build(waves)


def test_a_batch_that_runs_again_leaves_the_same(spark, tmp_path):
    waves = [[(1, "a", 1), (2, "a", 2)], [(1, "b", 4)]]
    want = refreshed(spark, str(tmp_path), waves, "ab")
    for file in (tmp_path / "chk" / "commits").glob("*1"):  # as if the job had failed before its last commit
        file.unlink()
    (tmp_path / "chk" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert refreshed(spark, str(tmp_path), [[(9, "z", 1)]], "c") == {**want, "z": 1}


def test_a_batch_is_placed_and_built_once(spark, tmp_path):
    placed, built = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(count):
        def same(v):
            count.add(1)
            return v
        return F.udf(same, "int")

    rows = [(i, f"k{i % 5}", 1) for i in range(40)]
    spark.createDataFrame(rows, "id int, k string, v int").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = refresh.files_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/a").schema)
    refresh.refresh_incremental(
        stream, f"{tmp_path}/store", f"{tmp_path}/out", ["k"], lambda b: b.withColumn("v", counting(placed)("v")),
        lambda s: s.groupBy("k").agg(F.sum("v").cast("int").alias("total")).withColumn("total", counting(built)("total")),
        f"{tmp_path}/chk", unique=["id"])
    assert {r.k: r.total for r in refresh.current(spark, f"{tmp_path}/out", ["k"]).collect()} == batch_build([rows])
    assert (placed.value, built.value) == (40, 5)
    assert not (tmp_path / "store_staged").exists()
