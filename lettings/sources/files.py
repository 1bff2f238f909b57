"""Readers that land files as text, file selection and lineage."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lettings import rules
from lettings.functions import clean
from lettings.operators import spatial
from lettings.operators.windows import dedup_latest, running_number
from lettings.sources import quoted

CORRUPT = "_corrupt_record"


def _csv_options(header: bool, multi_line: bool) -> dict[str, object]:
    return {
        "header": header, "inferSchema": False, "multiLine": multi_line, "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "enforceSchema": True,
    }


def text_schema(names: Iterable[str], corrupt: bool = False) -> StructType:
    fields = [StructField(n, StringType()) for n in names]
    return StructType(fields + ([StructField(CORRUPT, StringType())] if corrupt else []))


def markers_as_null(df: DataFrame, markers: Sequence[str] = rules.CSV_NULL_MARKERS) -> DataFrame:
    """Every text column trimmed, NULL markers as NULL."""
    return df.select(*[clean.marker_to_null(c, markers).alias(c) for c in df.columns])


def file_headers(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Files and their header names (of the first line that is not blank), in the order of the paths.

    Only the first bytes of a file are read; a blank file has no rows.
    """
    return [(h.file, header_names(h.line)) for h in _heads(spark, path)]


def header_names(line: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([line])))


def _heads(spark: SparkSession, path: str | Sequence[str]) -> list[quoted.Head]:
    return quoted.heads(spark, sorted(spark.read.text(path).inputFiles()))


def _frames_by_header(spark: SparkSession, path: str | Sequence[str], multi_line: bool) -> list[DataFrame]:
    """One frame per different header: its columns, lines that do not fit in ``CORRUPT``, file and row number."""
    groups: dict[tuple[str, ...], list[quoted.Head]] = {}
    for found in _heads(spark, path):
        groups.setdefault(header_names(found.line), []).append(found)
    options = {**_csv_options(True, False), "columnNameOfCorruptRecord": CORRUPT}
    frames = []
    for header, some in groups.items():
        schema = text_schema(header, corrupt=True)
        if multi_line:
            frames.append(_quoted_frame(spark, some, schema, options))
            continue
        raw = spark.read.options(**options).schema(schema).csv([h.file for h in some]).select("*", "_metadata")
        # a query of the kept lines alone is refused, so the column leans on a data column
        kept = F.coalesce(F.nullif(F.col(CORRUPT), F.lit("")), F.when(F.col(CORRUPT).isNotNull(), F.col(f"`{header[0]}`")))
        frames.append(with_row_numbers(raw.withColumn(CORRUPT, kept)))
    return frames


def _quoted_frame(spark: SparkSession, some: list[quoted.Head], schema: StructType, options: dict[str, object]) -> DataFrame:
    """Records cut over splits, then parsed one by one with the reader's own rules."""
    parsing = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
    rows = quoted.records(spark, some).where("number > 1")
    parsed = rows.select(F.from_csv("text", ddl, parsing | {"header": "false", "multiLine": "true"}).alias("r"), "file", "number", "crlf")
    plain = [  # as the reader does it, line breaks inside fields are LF
        F.when(F.col("crlf"), F.replace(F.col("r")[n], F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("r")[n]).alias(n)
        for n in schema.names if n != CORRUPT
    ]
    return parsed.select(*plain, F.col("r")[CORRUPT].alias(CORRUPT), F.regexp_replace("file", "^file:///", "file:/").alias("_filename"), (F.col("number") - 1).alias("_file_row_number"))


def read_csv_text(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """CSV with headers (plain or gzip), every column as text, matched by name across files.

    No column is typed here, so a value can never fail to load.  The first file gives the
    shape.  Plain files are read in many splits, also where fields hold line breaks; without
    ``multi_line`` they hold none, and no line has to be looked at for quotes first.
    """
    frames = [f.drop(CORRUPT, "_filename", "_file_row_number") for f in _frames_by_header(spark, path, multi_line)]
    first = frames[0].columns
    return markers_as_null(append_by_name(frames) if len(frames) > 1 else frames[0]).toDF(*first)


def read_csv_audited(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], multi_line: bool = True
) -> DataFrame:
    """The columns ``names`` (matched by name in any case, missing ones NULL) with lineage and bad lines.

    A line that does not fit its file's header keeps its text in a column of its own.
    """
    out = None
    for frame in _frames_by_header(spark, path, multi_line):
        numbered = frame.withColumn("_load_ts", F.current_timestamp().cast("timestamp_ntz"))
        own = {c.lower(): c for c in numbered.columns}
        found = [
            clean.marker_to_null(own[n.lower()], rules.CSV_NULL_MARKERS).alias(n) if n.lower() in own
            else F.lit(None).cast("string").alias(n) for n in names
        ]
        shaped = numbered.select(*found, CORRUPT, "_filename", "_file_row_number", "_load_ts")
        out = shaped if out is None else out.unionByName(shaped)
    if out is None:
        raise ValueError(f"No file with a header in {path}")
    return out


def read_csv_positional(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """CSV without a header into named text columns, in splits unless fields hold line breaks."""
    reader = spark.read.options(**_csv_options(False, multi_line)).schema(text_schema(names))
    return markers_as_null(reader.csv(path))


def append_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union in the shape of the first frame; later ones match by name in any case."""
    shape = [c.lower() for c in frames[0].columns]
    lowered = [f.toDF(*[c.lower() for c in f.columns]) for f in frames]
    result = lowered[0]
    for frame in lowered[1:]:
        known = frame.select(*[c for c in frame.columns if c in shape])
        result = result.unionByName(known, allowMissingColumns=True)
    return result.select(*shape)


def matches_file(path: Column | str, pattern: str = rules.SALE_FILE_PATTERN) -> Column:
    """Whole-path match of a file pattern."""
    return clean.as_col(path).rlike(f"^(?:{pattern})$")


def match_files(df: DataFrame, path: str, pattern: str = rules.SALE_FILE_PATTERN) -> DataFrame:
    return df.where(matches_file(path, pattern))


SNAPSHOT = r"(?:^|/)snapshot_date=([0-9]{4}-[0-9]{2}-[0-9]{2})(?:/|$)"


def latest_partition(df: DataFrame, group: str, path: str) -> DataFrame:
    """Rows in the newest ``snapshot_date=YYYY-MM-DD`` folder of each group.

    ISO dates sort as text; a folder that does not have exactly that form is
    ignored.
    """
    dated = df.withColumn("snapshot_date", F.nullif(F.regexp_extract(path, SNAPSHOT, 1), F.lit("")))
    newest = dated.groupBy(group).agg(F.max("snapshot_date").alias("snapshot_date"))
    return dated.join(newest.where(F.col("snapshot_date").isNotNull()), [group, "snapshot_date"], "left_semi")


def require_partition(df: DataFrame, group: str) -> DataFrame:
    """Fails at run time for a group without any snapshot folder."""
    checked = F.when(F.col("snapshot_date").isNotNull(), F.col("snapshot_date")).otherwise(
        F.raise_error(F.concat(F.lit("No snapshot_date folder for "), F.col(group)))
    )
    return df.withColumn("snapshot_date", checked)


def latest_snapshots(listing: DataFrame, group: str, path: str) -> DataFrame:
    """Newest snapshot per group of a file listing; a group without one is an error."""
    found = F.nullif(F.regexp_extract(path, SNAPSHOT, 1), F.lit(""))
    newest = listing.groupBy(group).agg(F.max(found).alias("snapshot_date"))
    return require_partition(newest, group)


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, change time and size of files; contents are not read."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return scan.option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def newest_file(listing: DataFrame, path: str = "path", changed: str = "modificationTime") -> DataFrame:
    """The file with the greatest change time; the path decides a tie."""
    best = F.max(F.struct(F.col(changed).alias("changed"), F.col(path).alias("path"))).alias("best")
    return listing.agg(best).select(F.col("best.path").alias("path"))


def read_geojson(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One document per file; text that is not JSON stops the load."""
    paths = [path] if isinstance(path, str) else list(path)
    docs = spark.read.text(paths, wholetext=True).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("_filename")
    )
    good = F.try_parse_json("raw").isNotNull()
    failed = F.raise_error(F.concat(F.lit("Not a JSON document: "), F.col("_filename")))
    return docs.withColumn("raw", F.when(good, F.col("raw")).otherwise(failed)).withColumn(
        "_load_ts", F.current_timestamp().cast("timestamp_ntz")
    )


def with_lineage(df: DataFrame, source: str | None = None) -> DataFrame:
    """File, row number in the file and load time.

    Row numbers come from positions in the scan and one count per file and
    scan partition; no file is gathered in one task.
    """
    numbered = with_row_numbers(df).withColumn("_load_ts", F.current_timestamp().cast("timestamp_ntz"))
    return numbered if source is None else numbered.withColumn("_source", F.lit(source))


def with_row_numbers(df: DataFrame) -> DataFrame:
    """File and row number in the file of scanned rows."""
    placed = df.select(
        *[c for c in df.columns if c != "_metadata"], F.col("_metadata.file_path").alias("_filename"),
        F.monotonically_increasing_id().alias("__at"),
    )
    return running_number(placed, ["_filename"], "__at", "_file_row_number").drop("__at")


def land_cells(df: DataFrame, cols: Sequence[str], row: str, skip_rows: int) -> DataFrame:
    """Sheet rows as arrays of text; leading and all-NULL rows go, numbers stay."""
    cells = F.array(*[F.col(c).cast("string") for c in cols]).alias("cells")
    rest = [c for c in df.columns if c not in cols]
    landed = df.where(F.col(row) > skip_rows).select(*rest, cells)
    return landed.where(F.exists("cells", lambda c: c.isNotNull()))


def scoped_snapshot(df: DataFrame, areas: DataFrame, key: str, cols: Sequence[str], area: str, source: str) -> DataFrame:
    """Copy of a shared table of points, cut to those inside an area, with the area and its origin.

    The areas' extent is a plain range filter, which the scan can use; a point in several
    areas goes to the first by name.
    """
    near = spatial.in_extent(df, areas)
    placed = spatial.point_in_area(near, areas, [area])
    one = dedup_latest(placed, [key], [F.col(area).asc()])
    return snapshot(one, [*cols, area], source)


def snapshot(df: DataFrame, cols: Sequence[str], source: str) -> DataFrame:
    """Copy of the named columns of a shared table with its origin."""
    return df.select(*cols, F.lit(source).alias("_source"), F.current_timestamp().cast("timestamp_ntz").alias("_load_ts"))
