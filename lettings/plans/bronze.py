"""Landing of text files: newest snapshot per group, one text table, lineage, load audit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettings.operators import reports
from lettings.sources import files, tables

SNAPSHOT_FILES = "*.csv*"


def newest_files(spark: SparkSession, folder: str, group: str, pattern: str = SNAPSHOT_FILES) -> list[str]:
    """Paths in the newest snapshot folder of each group; a group without one is an error.

    ``group`` is a pattern whose first bracket names the group within a path.  What is
    gathered are names of files, which a reader needs as a list.
    """
    listing = files.file_listing(spark, folder, pattern).withColumn("group", F.regexp_extract("path", group, 1))
    files.latest_snapshots(listing, "group", "path").collect()  # raises for a group without a snapshot
    return sorted(r["path"] for r in files.latest_partition(listing, "group", "path").select("path").collect())


def land(
    spark: SparkSession, folder: str, group: str, table: str, store: str, multi_line: bool = True,
    run_at: datetime | None = None,
) -> DataFrame:
    """Lands the newest snapshots as the text table ``store``/``table`` and returns it as stored.

    The first file gives the columns, later ones match by name.  Lines that do not fit are
    left out of the table and counted in ``store``/load_audit, which grows by each run.
    """
    paths = newest_files(spark, folder, group)
    names = [n.lower() for n in files.file_headers(spark, paths)[0][1]]
    rows = files.read_csv_audited(spark, paths, names, multi_line)
    staged = f"{store}/_staged_{table}"  # the files are parsed once
    tables.write_replace(rows, staged)
    rows = spark.read.parquet(staged)
    tables.write_replace(rows.where(F.col(files.CORRUPT).isNull()).drop(files.CORRUPT), f"{store}/{table}")
    audit = reports.load_audit(rows, table, "_filename", "_file_row_number", files.CORRUPT)
    tables.write_append(reports.with_run_time(audit, run_at), f"{store}/load_audit")
    return spark.read.parquet(f"{store}/{table}")


def load_audits(spark: SparkSession, store: str, tables_wanted: Sequence[str] = ()) -> DataFrame:
    """All load audits so far."""
    audits = spark.read.parquet(f"{store}/load_audit")
    return audits.where(F.col("table_name").isin(list(tables_wanted))) if tables_wanted else audits
