"""CSV files whose quoted fields hold line breaks, read in splits.

Whether a line begins inside a quoted field depends on all lines before it.  But a line
only maps that one bit to another, so a first pass gives each split's map, a running
composition over the splits gives each one's start, and a second pass cuts every split
into whole records on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

HEAD_BYTES, LONGEST_HEAD = 1 << 14, 1 << 24
_GAP = r"[\x00-\x20]*"
_QUOTED = r'"(?:[^"]|"")*"(?:[^",][^,]*)?'
_PLAIN = r'[^",\x00-\x20][^,]*'
#: A line that begins outside of quotes and ends inside: whole fields, then one that is not closed.
OPENS = rf'^(?:{_GAP}(?:{_QUOTED}|{_PLAIN})?,)*{_GAP}"(?:[^"]|"")*$'


@dataclass(frozen=True)
class Head:
    """A file's first line that is not blank (None in a blank file), if lines end with CR LF, and if it is one split."""

    file: str
    line: str | None
    crlf: bool
    whole: bool


def head(spark: SparkSession, path: str) -> Head:
    """What the beginning of a file tells.

    Only the first bytes are read, plain or unpacked, through Spark's file systems.
    """
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    system = place.getFileSystem(settings)
    size, stream = system.getFileStatus(place).getLen(), system.open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings).getCodec(place)
        stream = codec.createInputStream(stream) if codec else stream
        gzip = codec is not None and path.endswith(".gz")
        whole_file = gzip or size <= byte_size(spark.conf.get("spark.sql.files.openCostInBytes"))
        data, step = b"", HEAD_BYTES
        while True:
            more = bytes(stream.readNBytes(step))
            data += more
            *whole, rest = data.decode("utf-8", "replace").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
            ended = len(more) < step
            line = next((x for x in ([*whole, rest] if ended else whole) if x.strip()), None)
            if line is not None or ended:
                end = data.find(b"\n")
                return Head(path, line, end > 0 and data[end - 1 : end] == b"\r", whole_file)
            if len(data) >= LONGEST_HEAD:
                raise ValueError(f"No header in the first {len(data)} bytes of {path}")
            step = len(data)
    finally:
        stream.close()


def byte_size(text: str) -> int:
    """Bytes of a Spark size such as 4194304, 64k or 128MB."""
    digits = text.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits.rstrip("kmg")) << unit


def heads(spark: SparkSession, files: Sequence[str]) -> list[Head]:
    """The files that are not blank; several are opened at a time."""
    with ThreadPoolExecutor(16) as pool:
        return [h for h in pool.map(lambda f: head(spark, f), files) if h.line is not None]


def lines_of(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lines in the order of the files, with the split they stand in; LF ends a line."""
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        "value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"),
    )


def exits(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line ends inside quotes if it begins outside, and if it begins inside.

    To begin inside is to begin with a quote.
    """
    quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
    outside, inside = np.zeros(len(values), bool), np.ones(len(values), bool)
    if quoted.any():
        some = values.filter(pa.array(quoted))
        outside[quoted] = pc.match_substring_regex(some, OPENS).to_numpy(zero_copy_only=False)
        led = pc.binary_join_element_wise(pa.scalar('"'), some, "")
        inside[quoted] = pc.match_substring_regex(led, OPENS).to_numpy(zero_copy_only=False)
    return outside, inside


def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line begins inside quotes (one more entry: the state after the last), from the state at the first."""
    swaps = outside & ~inside
    swapped = np.concatenate([[False], np.logical_xor.accumulate(swaps)]) if len(swaps) else np.zeros(1, bool)
    fixed = np.concatenate([[True], outside == inside])
    value = np.concatenate([[start], outside]) ^ swapped
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), 0))
    return value[last] ^ swapped


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one split of one file."""
    split = batch.column("split").to_numpy()
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero((np.diff(split) != 0) | (np.diff(file) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        if b > a:
            yield batch.column("file")[a].as_py(), int(split[a]), batch.slice(a, b - a)


def blank(values: pa.Array) -> np.ndarray:
    return pc.invert(pc.match_substring_regex(values, r"[^\x00-\x20﻿]")).to_numpy(zero_copy_only=False)


def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: the states after it and the number of records that begin in it, for both states before it."""
    now: tuple[str, int] | None = None
    ends, counts = [False, True], [0, 0]
    out: list[tuple] = []
    for batch in batches:
        for file, split, rows in stretches(batch):
            if (file, split) != now:
                if now:
                    out.append((*now, *ends, *counts))
                now, ends, counts = (file, split), [False, True], [0, 0]
            values = rows.column("value")
            outside, inside = exits(values)
            empty = blank(values)
            for i in range(2):
                begun = states(outside, inside, ends[i])
                counts[i] += int((~begun[:-1] & ~empty).sum())
                ends[i] = bool(begun[-1])
    if now:
        out.append((*now, *ends, *counts))
    names = ("file", "split", "after_outside", "after_inside", "n_outside", "n_inside")
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))


def split_starts(lines: DataFrame) -> DataFrame:
    """Per split whether it begins inside quotes and how many records began before it; one row per split."""
    found = lines.mapInArrow(
        maps, "file string, split long, after_outside boolean, after_inside boolean, n_outside long, n_inside long")
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    a, b = F.col("after_outside").cast("int"), F.col("after_inside").cast("int")
    swaps = F.sum(F.when((a == 1) & (b == 0), 1).otherwise(0))
    with_swaps = found.withColumns({"upto": swaps.over(order) % 2, "earlier": F.coalesce(swaps.over(before), F.lit(0)) % 2})
    fixed = F.last(F.when(a == b, (a + F.col("upto")) % 2), ignorenulls=True).over(before)
    begun = with_swaps.withColumn("inside", ((F.coalesce(fixed, F.lit(0)) + F.col("earlier")) % 2).cast("boolean"))
    n = F.when(F.col("inside"), F.col("n_inside")).otherwise(F.col("n_outside"))
    return begun.select("file", "split", "inside", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("before"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, or parts of them where a split cuts one: ``file``, ``number``, ``split``, ``part`` and ``text``.

    ``part`` is null for a whole record.
    """
    now: tuple[str, int] | None = None
    inside, number = False, 0
    held: list[str] = []  # lines of the record that is not closed yet
    begun_here = False

    def flush(out: list[tuple], cut: bool) -> None:
        if held:
            out.append((*now, number, 0 if cut or not begun_here else None, "\n".join(held)))
            held.clear()

    for batch in batches:
        out: list[tuple] = []
        for file, split, rows in stretches(batch):
            if (file, split) != now:
                if now:
                    flush(out, inside)
                now = (file, split)
                inside, number = rows.column("inside")[0].as_py(), rows.column("before")[0].as_py()
                begun_here = False
            raw = rows.column("value")
            begun = states(*exits(raw), inside)
            empty = blank(raw)
            starts = np.flatnonzero(~begun[:-1])
            texts = raw.to_pylist()
            # lines before the first start go on with the record that is open
            at = int(starts[0]) if len(starts) else len(texts)
            held += texts[:at]
            ends = np.append(starts[1:], len(texts))[: len(starts)]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                flush(out, False)
                if empty[a] and b == a + 1:
                    continue
                number, begun_here = number + 1, True
                held += texts[a:b]
            inside = bool(begun[-1])
            if not inside:
                flush(out, False)
        if out:
            yield as_pieces(out)
    out = []
    if now:
        flush(out, inside)
    if out:
        yield as_pieces(out)


def as_pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "split", "number", "part", "text"])


def records(spark: SparkSession, files: Sequence[Head]) -> DataFrame:
    """The records of files with ``file``, ``number`` (from 1, the header), ``text`` and ``crlf``.

    Files of one split are cut in one pass; else a pass finds the splits' starts first (one
    row per split, which goes to all tasks), and records that a split cuts are put together.
    """
    kinds = sorted({(h.whole, h.crlf) for h in files})
    parts = [
        _records(spark, [h.file for h in files if (h.whole, h.crlf) == (whole, crlf)], not whole).withColumn("crlf", F.lit(crlf))
        for whole, crlf in kinds
    ]
    return reduce(DataFrame.unionByName, parts)


def _records(spark: SparkSession, files: Sequence[str], split: bool) -> DataFrame:
    lines = lines_of(spark, files)
    if split:
        cut = lines.join(F.broadcast(split_starts(lines)), ["file", "split"])
    else:
        cut = lines.withColumns({"inside": F.lit(False), "before": F.lit(0).cast("long")})
    cut = cut.select("value", "file", "split", "inside", "before")
    found = cut.mapInArrow(pieces, "file string, split long, number long, part int, text string")
    whole = found.where("part is null").select("file", "number", "text")
    if not split:
        return ended(whole)
    parts = found.where("part is not null").groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return ended(whole.unionByName(parts))


def ended(rows: DataFrame) -> DataFrame:
    """Records without the CR of a CR LF at their end."""
    return rows.withColumn("text", F.regexp_replace("text", r"\r\z", ""))
