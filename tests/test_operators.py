"""Operators against brute force on small frames, with hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from lettings import rules
from lettings.functions import measures, spatial as geo
from lettings.operators import joins, quantiles, reports, reshape, spatial, windows
from lettings.plans import serve


def hot_rows(n=3000, seed=1):
    """Two thirds of the rows share one key, many share one value."""
    rnd = random.Random(seed)
    return [
        (rnd.choice(["hot", "hot", None, "a", "b"]), rnd.choice([5.0, rnd.uniform(-10, 1e6), None, float(rnd.randint(0, 9))]), i)
        for i in range(n)
    ]


def test_quantiles_equal_numpy(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = quantiles.quantiles(df, ["k"], {"lo": (F.col("v"), 0.25), "mid": (F.col("v"), 0.5), "hi": (F.col("v"), 0.99)})
    for r in got.collect():
        values = [v for k, v, _ in rows if k == r.k and v is not None]
        for name, p in (("lo", 25), ("mid", 50), ("hi", 99)):
            assert math.isclose(r[name], np.percentile(values, p), rel_tol=1e-12, abs_tol=1e-12)
    assert got.count() == 4


def test_aggregates_and_medians_of_a_missing_measure(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "k string, v double")
    got = {r.k: (r.n, r.m) for r in quantiles.agg_with_medians(df, ["k"], [F.count("*").alias("n")], {"m": F.col("v")}).collect()}
    assert got == {"a": (2, 1.5), "b": (1, None), None: (1, 4.0)}


def test_row_numbers_and_tiles(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
    numbered = windows.number_rows(df, ["k"], order, "n").collect()
    tiles = {r.i: r.t for r in windows.tiles(df, ["k"], order, 4, "t").collect()}
    for key in ("hot", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [r.i for r in sorted((r for r in numbered if r.k == key), key=lambda r: r.n)] == [r[2] for r in mine]
        q, extra = divmod(len(mine), 4)
        expected = [t for t in range(4) for _ in range(q + (t < extra))]
        assert [tiles[r[2]] - 1 for r in mine] == expected


def test_tiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "k string, i int")
    got = sorted((r.k, r.i, r.t) for r in windows.tiles(df, ["k"], [F.col("i").asc()], 4, "t").collect())
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1)]


def test_dedup_is_idempotent_and_total(spark):
    df = spark.createDataFrame([("a", None, "f", 2), ("a", None, "f", 1), ("b", "2024-01-01", "g", 1), ("b", "2024-01-02", "f", 9)],
                               "k string, _load_ts string, _filename string, _file_row_number int")
    once = windows.dedup_latest(df, ["k"], windows.load_order(df))
    assert sorted((r.k, r._file_row_number) for r in once.collect()) == [("a", 1), ("b", 9)]
    assert windows.dedup_latest(once, ["k"], windows.load_order(once)).count() == 2


def test_top_bottom_needs_six(spark):
    make = lambda n: spark.createDataFrame([(i, 50.0) if i < 2 else (i, float(i)) for i in range(n)], "i int, s double")
    assert windows.top_bottom(make(5), "s", ["i"]).count() == 0
    row = windows.top_bottom(make(6), "s", ["i"]).first()
    assert (row.listings, round(row.avg_top_score, 4), round(row.avg_bottom_score, 4)) == (6, 35.0, 3.0)


def places(n, seed, spread=0.05):
    rnd = random.Random(seed)
    same = (0.1, 51.5)
    return [(i, *(same if rnd.random() < 0.34 else (0.1 + rnd.uniform(-spread, spread), 51.5 + rnd.uniform(-spread, spread)))) for i in range(n)]


def metres(a, b):
    la, lb = math.radians(a[2]), math.radians(b[2])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * rules.EARTH_RADIUS_M * math.asin(math.sqrt(h))


@pytest.mark.parametrize("rows", [4, 4096])
def test_nearby_counts_equal_nested_loop(spark, rows):
    left, right = places(150, 1), places(400, 2)
    a = spark.createDataFrame(left, "id int, longitude double, latitude double")
    b = spark.createDataFrame(right, "poi int, longitude double, latitude double")
    got = {r.id: r.n for r in spatial.nearby_counts(a, "id", b, {"n": F.count("poi")}, 500.0, rows).collect()}
    assert got == {p[0]: sum(metres(p, q) <= 500 for q in right) for p in left}


def test_within_distance_keeps_lonely_rows(spark):
    step = 499.0 / (rules.EARTH_RADIUS_M * math.pi / 180)
    a = spark.createDataFrame([(1, 0.0, 60.0), (2, 5.0, -60.0), (3, -7.0, 10.0)], "id int, longitude double, latitude double")
    b = spark.createDataFrame([(1, 0.0, 60.0 + step), (2, 0.0, 60.0 - step * 501 / 499), (3, 5.0 + 2 * step * 0.999, -60.0)],
                              "poi int, poi_longitude double, poi_latitude double")
    got = sorted((r.id, r.poi) for r in spatial.within_distance(a, b, 500.0).select("id", "poi").collect() if r.poi)
    assert got == [(1, 1), (2, 3)]
    assert spatial.within_distance(a, b, 500.0).count() == 3


SQUARE = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]]
SECOND = [[[2, 0], [3, 0], [3, 1], [2, 1], [2, 0]]]


def test_points_in_areas_with_hole_and_second_polygon(spark):
    import json

    text = json.dumps({"type": "MultiPolygon", "coordinates": [SQUARE, SECOND]})
    single = json.dumps({"type": "Polygon", "coordinates": SQUARE})
    df = spark.createDataFrame([("multi", text), ("single", single)], "area string, g string")
    areas = df.select("area", geo.parse_boundary("g").alias("boundary"))
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.5, 0.5), (3, 2.5, 0.5), (4, 9.0, 9.0), (5, 1.5, 0.5)], "p int, longitude double, latitude double")
    for cell in (0.05, 0.3, 5.0):
        got = sorted((r.p, r.area or "") for r in spatial.point_in_area(points, areas, ["area"], "left", cell=cell).collect())
        assert got == [(1, "multi"), (1, "single"), (2, ""), (3, "multi"), (4, ""), (5, "")]


def test_values_per_key_have_one_grain(spark):
    df = spark.createDataFrame([("hot", i, str(i)) for i in range(2500)] + [("one", 7, "x")], "k string, i int, v string")
    got = reshape.values_per_key(df, ["k"], "v", "i").collect()
    assert sorted(int(r.v) for r in got if r.k == "hot") == list(range(2500))
    assert {(r.k, r.n_values) for r in got} == {("hot", 2500), ("one", 1)}


def test_means_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(1e-5, 1e15), (3e-5, 3e15)], "a double, b double")
    row = df.agg(measures.mean("a").alias("a"), measures.mean("b").alias("b"), measures.weighted_mean("a", "b").alias("w")).first()
    assert row.a == pytest.approx(2e-5, rel=1e-12) and row.b == 2e15 and row.w == pytest.approx(2.5e-5, rel=1e-12)


def test_replies_that_are_no_object_are_errors(spark):
    replies = ["123", "[1]", '"x"', "null", '{"a": 1}', '{"confidence": "high"}', "words", "", None, "```json\n{}\n```"]
    rows = serve.parsed_replies(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string"), "reply")
    assert [r.confidence for r in rows.orderBy("i").collect()] == [
        "error", "error", "error", "error", "medium", "high", "low", "error", "error", "medium"]


def test_null_keys_match_only_where_asked(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    other = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    assert joins.join_null_safe(df, other, ["k"]).count() == 2
    assert joins.join_keys(df, other, ["k"]).count() == 1


def test_profile_matches_pandas(spark):
    import pandas as pd

    rnd = random.Random(3)
    data = [(rnd.choice([None, float(rnd.randint(0, 20)), 500.0 if rnd.random() < 0.02 else 1.0]), "t") for _ in range(400)]
    pdf = pd.DataFrame(data, columns=["v", "t"])
    row = {r.column_name: r for r in reports.profile(spark.createDataFrame(data, "v double, t string")).collect()}["v"]
    s = pdf["v"]
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    outliers = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    for name, want in {"mean": s.mean(), "median": s.median(), "std": s.std(), "skew": s.skew(), "percent_null": s.isna().mean() * 100}.items():
        assert math.isclose(row[name], want, abs_tol=1e-5), name
    assert (row.unique_values, row.outlier_count) == (s.nunique(), outliers)


def test_medians_order_nan_last_and_spread_small_values(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", float("nan")), ("b", 4.0)], "k string, v double")
    got = {r.k: r.m for r in quantiles.medians(df, ["k"], {"m": F.col("v")}).collect()}
    assert got["a"] == 2.0 and math.isnan(got["b"])
    for low, width in ((0.0, 1.0), (1000.0, 0.5)):
        values = spark.range(1_000_000).select((low + F.rand(1) * width).alias("v"))
        largest = values.groupBy(quantiles._bucket(F.col("v"))).count().agg(F.max("count")).first()[0]
        assert largest < 1_000_000 / 10, (low, largest)
    edge = [-math.inf, -1e300, -2.0, -1e-300, 0.0, 5e-324, 1e-300, 0.3, 1.0, 2.0 - 2**-52, 2.0, 1e15, 1.7e308, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(edge)], "i int, v double").select("i", quantiles._bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in rows.orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_one_hot_of_too_many_values_is_an_error(spark):
    df = spark.createDataFrame([("k", v) for v in ("a b", "c", None)], "k string, v string")
    assert reshape.one_hot_found(df, ["k"], "v").first().asDict() == {"k": "k", "v_a_b": 1, "v_c": 1}
    with pytest.raises(ValueError, match="more than 1"):
        reshape.one_hot_found(df, ["k"], "v", most=1)
    with pytest.raises(ValueError, match="equal column names"):
        reshape.one_hot_found(df.union(spark.createDataFrame([("k", "a-b")], df.schema)), ["k"], "v")


def test_ranks_and_tiles_run_no_job_of_their_own(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), (None, 2.0, 3)], "k string, v double, i int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy ranks", "none expected")
    try:
        ranked = windows.rank_by(df, "v", ["i"])
        tiled = windows.top_quartile(df, "k", "v", "i")
        assert not tracker.getJobIdsForGroup("lazy ranks")
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert [(r.i, r["rank"]) for r in ranked.orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]
    assert {r.i: r.segment for r in tiled.collect()} == {1: "top", 2: "rest", 3: "top"}


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "decimal(12,2)", "string", "date", "timestamp", "boolean", "array<int>"])
def test_row_numbers_of_all_kinds(spark, kind):
    rnd = random.Random(5)
    raw = spark.createDataFrame([(i, rnd.choice([None, rnd.randrange(-4, 4), rnd.randrange(-10**6, 10**6)])) for i in range(400)], "i int, n int")
    value = {
        "string": F.concat(F.lit("a common beginning "), F.col("n").cast("string")), "date": F.date_add(F.lit("2024-01-01"), F.col("n")),
        "timestamp": F.timestamp_seconds("n"), "boolean": F.col("n") > 0, "array<int>": F.array("n"),
        "double": F.when(F.col("i") % 50 == 0, float("nan")).otherwise(F.col("n") / 7),
    }.get(kind, F.col("n").cast(kind))
    df = raw.withColumn("v", value).repartition(5)
    for order in ([F.col("v").desc_nulls_last(), F.col("i").asc()], [F.col("v").asc(), F.col("i").desc()]):
        want = df.withColumn("want", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
        got = windows.lazy_row_number(want, [], order, "got")
        assert got.where("got <> want").count() == 0 and got.count() == 400
        want = df.withColumn("want", F.ntile(9).over(Window.partitionBy(F.lit(1)).orderBy(*order)))
        assert windows.tiles(want, [], order, 9, "got").where("got <> want").count() == 0


def test_a_shared_score_is_cut_by_its_tie(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 50).alias("v"))
    by = windows.sort_keys(df, [F.col("v").desc_nulls_last(), F.col("i").asc()])
    assert windows.bucket_starts(windows.dealt_in_order(df, [], by), by).agg(F.max("__n")).first()[0] < 50
    with pytest.raises(ValueError, match="plain columns"):
        windows.sort_keys(df, [(F.col("v") + 1).desc()])


def star_shape(n, seed):
    """A ring of many edges around a middle, with a hole."""
    rnd = random.Random(seed)
    def ring(low, high):
        points = [(math.cos(2 * math.pi * i / n) * rnd.uniform(low, high) + 0.31, math.sin(2 * math.pi * i / n) * rnd.uniform(low, high) + 0.17) for i in range(n)]
        return [list(p) for p in [*points, points[0]]]
    return [ring(0.3, 0.5), ring(0.05, 0.2)]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.02, 0.13, 2.0])
def test_points_in_areas_of_many_edges(spark, cell):
    import json

    shapes = {"a": star_shape(300, 1), "b": star_shape(7, 2), "c": star_shape(300, 1)}
    rows = [(k, json.dumps({"type": "Polygon", "coordinates": v})) for k, v in shapes.items()]
    areas = spark.createDataFrame(rows, "area string, g string").select("area", geo.parse_boundary("g").alias("boundary"))
    rnd = random.Random(3)
    points = [(i, rnd.uniform(-0.3, 0.9), rnd.uniform(-0.5, 0.8)) for i in range(800)] + [(900, None, 0.1), (901, 0.1, None)]
    df = spark.createDataFrame(points, "p int, longitude double, latitude double")
    got = sorted((r.p, r.area or "") for r in spatial.point_in_area(df, areas, ["area"], "left", cell=cell).collect())
    want = []
    for p, x, y in points:
        own = [k for k in shapes if x is not None and y is not None and inside(shapes[k], x, y)]
        want += [(p, k) for k in own] or [(p, "")]
    assert got == sorted(want)
    cells = spatial.area_cells(areas, ["area"], cell)
    if cell == 0.02:  # much of an area needs no edge
        assert cells.where("size(__edges) = 0 and area = 'b'").count() > 0.25 * cells.where("area = 'b'").count()


def test_full_cells_of_pairs_are_many_tasks(spark):
    rnd = random.Random(6)
    def near(n, k):
        return [(i, 0.1 + rnd.uniform(0, 0.004), 51.5 + rnd.uniform(0, 0.003)) for i in range(n)] + [(n + 1, 5.0 + k, 40.0), (n + 2, None, 1.0)]
    left, right = near(300, 0), near(200, 1)
    a = spark.createDataFrame(left, "id int, longitude double, latitude double")
    b = spark.createDataFrame(right, "poi int, poi_longitude double, poi_latitude double")
    want = sorted((p[0], q[0]) for p in left for q in right if None not in p and None not in q and metres(p, q) <= 200)
    for rows in (20, 4096):
        got = spatial.within_distance(a, b, 200.0, rows=rows)
        assert sorted((r.id, r.poi) for r in got.collect() if r.poi is not None) == want
        lonely = {p[0] for p in left} - {i for i, _ in want}
        assert sorted(r.id for r in got.collect() if r.poi is None) == sorted(lonely)
    here = spatial.home_cell(a.where("longitude is not null"), "longitude", "latitude", 200.0)
    there = spatial.neighbour_cells(b.where("poi_longitude is not null"), "poi_longitude", "poi_latitude", 200.0)
    cut, _, on = spatial.split_hot_cells(here, there, ["__cx", "__cy"], (["id"], ["poi"]), 20)
    assert cut.groupBy(*on).count().agg(F.max("count")).first()[0] < 60


def test_nearby_counts_in_a_dense_place(spark):
    rnd = random.Random(8)
    right = [(i, 0.1 + rnd.gauss(0, 0.002), 51.5 + rnd.gauss(0, 0.001)) for i in range(3000)] + [(9000, None, None), (9001, 0.1, None)]
    left = [(i, 0.1 + rnd.uniform(-0.01, 0.01), 51.5 + rnd.uniform(-0.01, 0.01)) for i in range(60)] + [(99, None, 51.5), (98, -0.1, -70.0)]
    a = spark.createDataFrame(left, "id int, longitude double, latitude double")
    b = spark.createDataFrame(right, "poi int, longitude double, latitude double")
    for far, rows in ((500.0, 8), (500.0, 64), (60.0, 2)):
        got = {r.id: r.n for r in spatial.nearby_counts(a, "id", b, {"n": F.count("poi")}, far, rows).collect()}
        assert got == {p[0]: sum(None not in p and None not in q and metres(p, q) <= far for q in right) for p in left}


def test_sorted_lists_come_in_runs(spark, monkeypatch):
    rows = [("hot", f"v{i % 2500:05d}") for i in range(6000)] + [("a", "x"), ("a", "é"), ("a", None), (None, "z"), (None, "y"), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(4)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, set()).add(v)
    monkeypatch.setattr(reshape, "LIST_PART", 100)
    got = {r.k: (r.text, r.n_values) for r in reshape.string_list_distinct(df, ["k"], "v", "text").collect()}
    assert got == {k: (", ".join(sorted(v)), len(v)) for k, v in want.items()}
    runs = reshape.sorted_runs_of(df, ["k"], "v", ", ")
    assert runs.agg(F.max("__n")).first()[0] == 100 and runs.where("k = 'hot'").count() == 25
    monkeypatch.setattr(reshape, "LIST_BYTES", 1000)
    with pytest.raises(Exception, match="one row per value"):
        reshape.string_list_distinct(df, ["k"], "v", "text").collect()


def test_promised_sizes_are_held(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    one = df.agg(F.max("v").alias("top"))
    assert joins.join_null_safe(df, one, []).count() == 2
    with pytest.raises(Exception, match="More than 1 rows"):
        joins.join_null_safe(df, df.select(F.col("v").alias("w")), []).collect()
    many = spark.range(3_000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="More than 1000 rows"):
        windows.minmax_by(many, "k", {"n": ("v", False)}, fixed_parts=True).collect()
    assert windows.minmax_by(df, "k", {"n": ("v", False)}, fixed_parts=True).count() == 2
    with pytest.raises(ValueError, match="at most"):
        joins.picks_frame(spark, [{"k": "x"}] * 1_001, ["k"])


def test_nodes_of_places_are_never_broadcast(spark, tmp_path):
    """Few places, many nodes: broadcasting the nodes once took 8 GB at 60 times the tables."""
    rnd = random.Random(9)
    for name, n in (("a", 200), ("b", 4000)):
        rows = [(i, 0.1 + rnd.uniform(0, 0.02), 51.5 + rnd.uniform(0, 0.02)) for i in range(n)]
        spark.createDataFrame(rows, "id int, longitude double, latitude double").write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in ("a", "b"))
    counted = spatial.nearby_counts(a, "id", b, {"n": F.count(F.lit(1))}, 500.0, 8)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # as many as the places' parts
    try:
        counted.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BuildLeft" not in plan
    assert "REPARTITION_BY_NUM" in plan  # the places' parts do not follow their bytes


def test_nodes_are_listed_once_per_level_and_not_sorted(spark, tmp_path):
    """Nodes inside and on the rim were listed, dealt and sorted in a join each: the longest stages at 60 times the tables."""
    rnd = random.Random(12)
    for name, n in (("a", 200), ("b", 4000)):
        rows = [(i, 0.1 + rnd.uniform(0, 0.02), 51.5 + rnd.uniform(0, 0.02)) for i in range(n)]
        spark.createDataFrame(rows, "id int, longitude double, latitude double").write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in ("a", "b"))
    counted = spatial.nearby_counts(a, "id", b, {"n": F.count(F.lit(1))}, 500.0, 8)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join [__y" in line and "LeftOuter" in line]
    assert len(met) == len(spatial.NODE_LEVELS) and all("ShuffledHashJoin" in line and "BuildRight" in line for line in met)


def test_parts_are_enough_for_the_cores(spark):
    df, usual = spark.range(10), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = [spatial.fixed_parts(df, "id", enough=enough).rdd.getNumPartitions() for enough in (None, 64, 3)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert got == [200, 64, 2 * spark.sparkContext.defaultParallelism]


def test_cells_of_pairs_are_never_broadcast(spark, tmp_path):
    rnd = random.Random(11)
    for name, n, at in (("a", 200, ""), ("b", 300, "poi_")):
        rows = [(i, 0.1 + rnd.uniform(0, 0.01), 51.5 + rnd.uniform(0, 0.01)) for i in range(n)]
        spark.createDataFrame(rows, f"{at or 'id'} int, {at}longitude double, {at}latitude double").write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in ("a", "b"))
    pairs = spatial.within_distance(a, b, 500.0, "inner")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    join = [line for line in plan.splitlines() if "Join" in line][0]  # the join of the pairs is the topmost one
    assert "SortMergeJoin" in join and "REPARTITION_BY_NUM" in plan


def test_few_places_are_counted_for_lonely_rows(spark):
    rnd = random.Random(12)
    def near(n, k):
        return [(i, 0.1 + rnd.uniform(0, 0.02), 51.5 + rnd.uniform(0, 0.02)) for i in range(n)] + [(n + 1, 5.0, 40.0 + k), (n + 2, None, 1.0)]
    left, right = near(150, 0), near(900, 0.0044) + [(2000, 5.0, 40.02)]
    a = spark.createDataFrame(left * 2, "id int, longitude double, latitude double")
    b = spark.createDataFrame(right, "poi int, poi_longitude double, poi_latitude double")
    at = b.selectExpr("poi_longitude as longitude", "poi_latitude as latitude")
    for far in (500.0, 480.0, 60.0):
        want = [p[0] for p in left * 2 if not any(None not in p and None not in q and metres(p, q) <= far for q in right)]
        left_open = {r.id for r in spatial.maybe_lonely(a, at, far).collect()}
        assert set(want) <= left_open and (far < 100 or len(left_open) < 15)
        assert sorted(r.id for r in spatial.within_distance(a, b, far).where("poi is null").collect()) == sorted(want)


@pytest.mark.parametrize("lat", [0.002, -51.3, 89.6])
def test_spans_of_rows_hold_at_any_latitude(spark, lat):
    rnd = random.Random(10)
    wide = 0.02 / math.cos(math.radians(lat))
    left = [(i, 7.0 + rnd.uniform(-wide, wide), lat + rnd.uniform(-0.01, 0.01)) for i in range(40)]
    right = [(i, 7.0 + rnd.uniform(-wide, wide), lat + rnd.uniform(-0.01, 0.01)) for i in range(800)]
    a = spark.createDataFrame(left, "id int, longitude double, latitude double")
    b = spark.createDataFrame(right, "poi int, longitude double, latitude double")
    got = {r.id: r.n for r in spatial.nearby_counts(a, "id", b, {"n": F.count("poi")}, 500.0, 2).collect()}
    assert got == {p[0]: sum(metres(p, q) <= 500 for q in right) for p in left}
