"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lettings.llm.common import slices, split_words, written

SEPARATORS = r"[\x00-/:-`{-\x7f]+"
WINDOW, BLOCK, LANE = 13, 2, 1024
TABLE_BITS = 18
BLOCK_BYTES = 8 << 20  # of benchmark text held by a task at once; its windows take some 20 times that


class Patterns:
    """Shift table and buckets for the windows of one length, whose words are numbers."""

    def __init__(self, windows: np.ndarray):
        self.windows = windows
        self.m = windows.shape[1]
        self.block = min(BLOCK, self.m)
        bits = (1 << TABLE_BITS) - 1
        self.factors = np.array([1, 0x9E3779B1][: self.block], np.int64)
        self.bits = bits
        self.shift = np.full(bits + 1, self.m - self.block + 1, np.int16)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.code(windows[:, end - self.block : end]), self.m - end)
        suffix = self.code(windows[:, self.m - self.block :])
        self.order = order = np.argsort(suffix, kind="stable")
        self.first = np.searchsorted(suffix[order], np.arange(bits + 2))
        self.prefix = self.code(windows[:, : self.block])

    def code(self, blocks: np.ndarray) -> np.ndarray:
        mixed = (blocks.astype(np.int64) * self.factors).sum(axis=1)
        return (mixed ^ (mixed >> 15)) & self.bits

    def at(self, codes: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Hash of the block of words that begins at each place."""
        mixed = codes[where]
        for i in range(1, self.block):
            mixed = mixed + codes[where + i] * self.factors[i]
        return (mixed ^ (mixed >> 15)) & self.bits

    def search(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window begins, and which (row of ``windows``).

        Texts are cut into lanes of window starts and all lanes step at once: the shift
        of the block that ends the window says how far a lane may jump.
        """
        last = np.maximum(begins[1:] - self.m + 1, begins[:-1])  # first start without room
        counts = -(-(last - begins[:-1]) // LANE)
        text = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[:-1][text] + nth * LANE
        stop = np.minimum(at + LANE, last[text])
        stopped: list[np.ndarray] = []
        while len(at):
            step = self.shift[self.at(codes, at + self.m - self.block)]
            stopped.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        places = np.concatenate(stopped) if stopped else np.zeros(0, np.int64)
        bucket = self.at(codes, places + self.m - self.block)
        n = self.first[bucket + 1] - self.first[bucket]
        of = np.repeat(np.arange(len(places)), n)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        pattern = self.order[self.first[bucket][of] + inside]
        same = self.prefix[pattern] == self.at(codes, places)[of]
        of, pattern = of[same], pattern[same]
        for i in range(self.m):
            same = codes[places[of] + i] == self.windows[pattern, i]
            of, pattern = of[same], pattern[same]
        return places[of], pattern


class Matcher:
    """All windows of the items, by length: an item with fewer words than a window is one itself."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        rows = [(str(i), t) for i, t in items if t]
        flat, begins = split_words(pc.ascii_lower(pa.array([t for _, t in rows], pa.string())), SEPARATORS)
        self.vocabulary = pc.unique(flat)
        codes = pc.index_in(flat, value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(begins)
        self.names: dict[int, list[list[str]]] = {}
        self.patterns = []
        for m in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            item = np.flatnonzero(sizes >= window if m == window else sizes == m)
            count = sizes[item] - m + 1
            owner = np.repeat(item, count)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - begins[:-1][item], count)
            windows, which = np.unique(codes.astype(np.int32)[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0)
            named: list[list[str]] = [[] for _ in range(len(windows))]
            for k, i in pairs.tolist():
                named[k].append(rows[i][0])
            self.names[m] = named
            self.patterns.append(Patterns(windows))

    def codes(self, flat: pa.Array) -> np.ndarray:
        """Numbers of the words; all that no item has share one."""
        found = pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), len(self.vocabulary))
        return found.to_numpy(zero_copy_only=False).astype(np.int64)


def mark(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns ``keep``, n_words, ``hits`` (merged stretches of hit words: start, end) and ``items``.

    Items go to the tasks in blocks of a checked size, and what a block finds is written
    before the next one starts, so a task and the driver hold one block of them at any size
    of the benchmark.

    Null and empty texts have no words and no hits; null and empty items have no window; a
    null id of an item is the text ``None``; repeated rows each get their hits; columns
    of the same name as an added one are replaced.
    """
    added = ("n_words", "hits", "items")
    keep = tuple(c for c in keep if c not in added)
    stretch = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([
        *[docs.schema[c] for c in keep], StructField("n_words", LongType()),
        StructField("hits", ArrayType(stretch)), StructField("items", ArrayType(StringType())),
    ])
    given = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    spark = docs.sparkSession
    source = docs.withColumn("__text", F.col(text)) if text not in keep else docs
    column = "__text" if text not in keep else text
    out = None
    for i in range(blocks):
        part = given.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == i) if blocks > 1 else given
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        final = i == blocks - 1
        before = source if out is None else out
        names = list(dict.fromkeys([*keep, column]))
        fields = [before.schema[c] for c in names]
        wanted = schema if final else StructType([*fields, *schema.fields[-3:]])
        out = before.select(*names, *([] if out is None else added)).mapInArrow(
            searcher(sent, column, [*keep] if final else names, window), wanted
        )
        if not final:
            out = written(out)
            sent.destroy()
    return out


def searcher(sent, column: str, keep: list[str], window: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for whole in batches:
            for batch in slices(whole, column):
                texts = batch.column(batch.schema.get_field_index(column))
                flat, begins = split_words(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
                codes, rows = matcher.codes(flat), len(begins) - 1
                cover = np.zeros(len(codes) + 1, np.int64)
                found: list[set[str]] = [set() for _ in range(rows)]
                if "hits" in batch.schema.names:
                    earlier(batch, begins, cover, found)
                for p in matcher.patterns:
                    places, which = p.search(codes, begins)
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + p.m, -1)
                    text_of = np.searchsorted(begins, places, side="right") - 1
                    for row, k in set(zip(text_of.tolist(), which.tolist(), strict=True)):
                        found[row].update(matcher.names[p.m][k])
                covered = np.cumsum(cover)[:-1] > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(batch.schema.get_field_index(c)) for c in keep],
                        pa.array(np.diff(begins)), pa.array(stretches(covered, begins), kind),
                        pa.array([sorted(s) for s in found], pa.list_(pa.string())),
                    ],
                    names=[*keep, "n_words", "hits", "items"],
                )

    return run


def earlier(batch: pa.RecordBatch, begins: np.ndarray, cover: np.ndarray, found: list[set[str]]) -> None:
    """Adds what an earlier block of items has hit."""
    hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
    items = batch.column(batch.schema.get_field_index("items")).to_pylist()
    for row, (spans, names) in enumerate(zip(hits, items, strict=True)):
        found[row].update(names)
        for s in spans:
            cover[begins[row] + s["start"]] += 1
            cover[begins[row] + s["end"]] -= 1


def stretches(covered: np.ndarray, begins: np.ndarray) -> list[list[dict[str, int]]]:
    """Runs of covered words of each text, counted from its first word."""
    out: list[list[dict[str, int]]] = [[] for _ in range(len(begins) - 1)]
    hit = np.flatnonzero(covered)
    if not len(hit):
        return out
    text = np.searchsorted(begins, hit, side="right") - 1
    cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(text) > 0)) + 1
    for run in np.split(np.arange(len(hit)), cut):
        row = text[run[0]]
        out[row].append({"start": int(hit[run[0]] - begins[row]), "end": int(hit[run[-1]] - begins[row]) + 1})
    return out


def with_verdict(marked: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.withColumn("n_hit", n_hit).withColumns({
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    }).drop("hits", "items")


ORACLE = f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item, least(len(w), {WINDOW}) as m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') as v
  from (select item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)),
lengths as (select distinct m from windows),
places as (
  select doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') as v
  from (select doc_id, w, m, unnest(range(1, cast(len(w) - m + 2 as bigint))) as i from d, lengths where len(w) >= m)),
hits as (select doc_id, i, p.m, item from places p join windows using (m, v)),
words as (
  select doc_id, count(distinct i + k) as n_hit
  from (select distinct doc_id, i, m, unnest(range(0, cast(m as bigint))) as k from hits) group by doc_id),
found as (
  select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as named
  from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(named, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join found using (doc_id)
"""
