"""Files, lineage and table writes."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettings.operators import reports
from lettings.plans import silver
from lettings.sources import files, quoted, tables


def test_csv_keeps_quotes_newlines_and_markers(spark, tmp_path):
    text = 'id,name,note\n1,"a, ""b""","two\nlines"\n2, N/A ,null\n'
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write(text)
    rows = files.read_csv_text(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a, "b"', "two\nlines"), ("2", None, None)]


def test_append_by_name_follows_first_shape(spark):
    a = spark.createDataFrame([("1", "x")], "Id string, Name string")
    b = spark.createDataFrame([("y", "2", "z")], "NAME string, ID string, extra string")
    c = spark.createDataFrame([("3",)], "id string")
    assert sorted(tuple(r) for r in files.append_by_name([a, b, c]).collect()) == [("1", "x"), ("2", "y"), ("3", None)]


def test_latest_snapshot_is_strict(spark):
    rows = [("c", "c/snapshot_date=2025-06-14/f"), ("c", "c/snapshot_date=2025-12-01/f"), ("c", "c/snapshot_date=2026-1-01/f")]
    df = spark.createDataFrame(rows, "city string, path string")
    assert [r.snapshot_date for r in files.latest_snapshots(df, "city", "path").collect()] == ["2025-12-01"]
    assert files.latest_partition(df, "city", "path").count() == 1
    with pytest.raises(Exception, match="No snapshot_date folder for d"):
        files.latest_snapshots(df.union(spark.createDataFrame([("d", "d/x/f")], df.schema)), "city", "path").collect()


def test_bad_geojson_stops(spark, tmp_path):
    (tmp_path / "bad.geojson").write_text("{not json")
    with pytest.raises(Exception, match="Not a JSON document"):
        files.read_geojson(spark, str(tmp_path)).collect()


def test_lineage_and_load_audit(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.csv").write_text("id,v\n" + "".join(f"{i},x\n" for i in range(5)) + ("7,x,extra\n" if n == "b" else ""))
    rows = files.read_csv_audited(spark, str(tmp_path), ["id", "v"])
    by_file = {r.f: (r.n, r.hi) for r in rows.groupBy(F.substring_index("_filename", "/", -1).alias("f")).agg(
        F.count("*").alias("n"), F.max("_file_row_number").alias("hi")).collect()}
    assert by_file == {"a.csv": (5, 5), "b.csv": (6, 6)}
    kept = files.read_csv_audited(spark, str(tmp_path), ["id", "v"])
    audit = {r.file_name[-5:]: (r.status, r.errors_seen) for r in reports.load_audit(kept, "T", "_filename", "_file_row_number", "_corrupt_record").collect()}
    assert audit == {"a.csv": ("LOADED", 0), "b.csv": ("PARTIALLY_LOADED", 1)}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="is_booked"):
        reports.check_columns(spark.range(1), ["id", "is_booked"])


def test_table_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "t")
    tables.replace_keys(df, path, ["k"])
    tables.replace_keys(spark.createDataFrame([(5, "a")], "v int, k string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]
    df.createOrReplaceTempView("x_calendar")
    assert [r.table_name for r in tables.list_tables(spark, "%_CALENDAR").collect()] == ["x_calendar"]


def test_missing_listing_columns_become_null(spark):
    raw = spark.createDataFrame([("1", "51.0", "0.1", "Entire loft"), ("x", "51.0", "0.1", "Boat"), ("2", "95", "0", "Boat")],
                                "id string, latitude string, longitude string, property_type string")
    rows = silver.clean_listings(raw).collect()
    assert [(r.listing_id, r.property_type, r.price) for r in rows] == [(1, "loft", None)]


def test_files_of_different_headers_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,N/A\n2,x\n")
    (tmp_path / "b.csv").write_text("V,extra,ID\nNULL,e,3\ny,e,4\nz,e,5,too,many\n")
    rows = files.read_csv_text(spark, str(tmp_path), multi_line=False)
    assert rows.columns == ["id", "v"]
    assert sorted((r.id, r.v) for r in rows.collect() if r.id != "5") == [("1", None), ("2", "x"), ("3", None), ("4", "y")]
    audited = files.read_csv_audited(spark, str(tmp_path), ["id", "v"]).orderBy("id").collect()
    assert [(r.id, r.v, r["_corrupt_record"]) for r in audited] == [
        ("1", None, None), ("2", "x", None), ("3", None, None), ("4", "y", None), ("5", "z", "z,e,5,too,many")]
    assert [r["_file_row_number"] for r in audited] == [1, 2, 1, 2, 3]


def test_plain_csv_is_read_in_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},x\n" for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = files.read_csv_positional(spark, str(tmp_path), ["i", "v"])
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("multi_line", [True, False])
def test_blank_lines_before_the_header(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "b.csv").write_text("\n\nv,id\ny,2\n")
    (tmp_path / "c.csv").write_text(" \t\nv,id\nz,3\n")
    (tmp_path / "d.csv").write_text("\n\n")
    rows = files.read_csv_text(spark, str(tmp_path), multi_line)
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x"), ("2", "y"), ("3", "z")]
    rows = files.read_csv_audited(spark, str(tmp_path), ["id", "v"], multi_line).orderBy("id")
    assert [(r.id, r.v, r["_corrupt_record"]) for r in rows.collect()] == [("1", "x", None), ("2", "y", None), ("3", "z", None)]


def quoted_text(rng, newline):
    """A file with quoted line breaks, delimiters and quotes, stray quotes, blank lines, short and long rows."""
    values = ["a", "1", "x y", " pad ", "", "é日", 'say ""hi""', "l1\nl2", "p,q", "\n", '""', 'in " mid', "N/A", 'tail""', "z" * 40]

    def field():
        value = rng.choice(values)
        if value != 'in " mid' and ("\n" in value or "," in value or '""' in value or rng.random() < 0.3):
            return '"' + value.replace("\n", newline) + '"'
        return value

    out = ["id,a,b"]
    for i in range(60):
        row = [str(i), field(), field(), "extra"][: rng.choice([3] * 18 + [2, 4])]
        out += [rng.choice(["", "  ", "\t"])] if rng.random() < 0.05 else []
        out.append(",".join(row))
    return newline.join(out) + newline


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["100", "300", "128m"])
def test_quoted_files_in_splits_equal_the_whole_reader(spark, tmp_path, newline, split):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_bytes(quoted_text(random.Random(f"{i}{newline}{split}"), newline).encode())
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(quoted_text(random.Random(8), newline).encode()))
    settings = {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame, = files._frames_by_header(spark, str(tmp_path), True)
        got = frame.collect()
        tasks = quoted.lines_of(spark, [str(tmp_path / f"{i}.csv") for i in range(3)]).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks > 3 or split == "128m"
    for name in ("0.csv", "1.csv", "2.csv", "z.csv.gz"):
        reader = spark.read.options(**files._csv_options(True, True)).option("columnNameOfCorruptRecord", files.CORRUPT)
        whole = reader.schema(files.text_schema(["id", "a", "b"], corrupt=True)).csv(str(tmp_path / name)).cache().collect()
        own = sorted((r for r in got if r["_filename"].endswith(f"/{name}")), key=lambda r: r["_file_row_number"])
        assert [tuple(r)[:4] for r in own] == [tuple(r) for r in whole]
        assert [r["_file_row_number"] for r in own] == list(range(1, len(own) + 1))


def test_a_record_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "a.csv").write_text(f'id,v\n1,x\n2,"{long}"\n3,"y"\n')
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = files.read_csv_text(spark, str(tmp_path)).orderBy("id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in rows] == [("1", "x"), ("2", long), ("3", "y")]


def test_states_follow_line_by_line():
    rng = np.random.default_rng(4)
    for _ in range(50):
        outside, inside = rng.random(12) < 0.5, rng.random(12) < 0.5
        for start in (False, True):
            want = [start]
            for a, b in zip(outside, inside, strict=True):
                want.append(bool(b if want[-1] else a))
            assert quoted.states(outside, inside, start).tolist() == want


def test_header_search_reads_only_the_beginning(spark, tmp_path, monkeypatch):
    """The end of a packed file is cut off, which reading it to the end would notice."""
    plain = "\n\n" + "id,v\n" + "".join(f"{i},{i * i}\n" for i in range(300_000))
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(plain.encode())[:-1000])
    (tmp_path / "b.csv").write_text("﻿id,v\r\n1,2\r\n")
    (tmp_path / "c.csv").write_text("\n \n")
    (tmp_path / "d d.csv").write_text("x" * 100_000 + ",v")
    got = {f.rsplit("/", 1)[1]: names for f, names in files.file_headers(spark, str(tmp_path))}
    assert got == {"a.csv.gz": ("id", "v"), "b.csv": ("id", "v"), "d%20d.csv": ("x" * 100_000, "v")}
    monkeypatch.setattr(quoted, "LONGEST_HEAD", 50_000)
    with pytest.raises(ValueError, match="No header"):
        files.file_headers(spark, str(tmp_path / "d d.csv"))
