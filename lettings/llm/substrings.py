"""Substring deduplication: FM-indexes per shard decide which long word sequences an earlier document has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lettings.llm.common import (
    dealt_by_key, gram_hashes, hash_words, mix, slices, sorted_runs, split_words, starts_with_room, written,
)
from lettings.llm.fmindex import FMIndex
from lettings.session import stable

WINDOW, GRAM = 50, 18
RUN = 64  # most windows of a content; searches of a shard go on as long as its longest content
SHARD_WORDS = 400_000
SECOND = np.uint64(0x5851F42D4C957F2D)
BROADCAST_BYTES = 64 << 20
SPLIT = r"[ \t-\r]+"
LAST_ID = (1 << 63) - 1


def least_grams(h: np.ndarray, window: int) -> np.ndarray:
    """Smallest gram hash inside the window from each word on."""
    least = gram_hashes(h, GRAM)
    width, done = window - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return least


def cut_runs(h: np.ndarray, begins: np.ndarray, window: int):
    """Runs of windows of a text that share the smallest gram: text, start (from its first word), count, gram."""
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    place = np.flatnonzero(starts_with_room(begins, window, len(h)))
    least = least_grams(h, window)[place]
    text = np.searchsorted(begins, place, side="right") - 1
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    return text[first], place[first] - begins[text[first]], count, least[first]


def runs(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, begins = split_words(batch.column(1), SPLIT)
                text, start, count, least = cut_runs(hash_words(flat), begins, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), pa.array(least.view(np.int64)),
                     pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["class", "gram", "start", "count"],
                )
    return docs.select("class", "text").mapInArrow(run, "class long, gram long, start int, count int")


def segments(docs: DataFrame, window: int) -> DataFrame:
    """The words (as hashes) of the runs in ``parts`` of each text; runs that follow each other make one segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, begins = split_words(batch.column(2), SPLIT)
                h, out = hash_words(flat), []
                for row, parts in enumerate(batch.column(3).to_pylist()):
                    merged: list[list[int]] = []
                    for start, count in sorted((p["start"], p["count"]) for p in parts):
                        if merged and merged[-1][1] == start:
                            merged[-1][1] += count
                        else:
                            merged.append([start, start + count])
                    for start, end in merged:
                        out.append((row, start, h[begins[row] + start : begins[row] + end + window - 1].tobytes()))
                rows = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                    names=["id", "class", "start", "words"],
                )
    return docs.mapInArrow(run, "id long, class long, start int, words binary")


def window_hashes(parts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begins = joined(batch.column(2))
            place = np.flatnonzero(starts_with_room(begins, window, len(flat)))
            h = gram_hashes(flat, window)[place]
            row = np.searchsorted(begins, place, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array((place - begins[row]).astype(np.int32))],
                names=["h", "class", "start", "at"],
            )
    return parts.select("class", "start", "words").mapInArrow(run, "h long, class long, start int, at int")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    begins = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), begins


def run_starts(new: np.ndarray) -> np.ndarray:
    """Where runs begin after the first one; runs of one repeated word are cut in pieces of ``RUN`` windows."""
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(new) + 1]])
    inner = [np.arange(a, b, RUN) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.concatenate(inner)[1:]


def stretches(parts: DataFrame, window: int) -> DataFrame:
    """Runs of the windows ``at`` of each segment, cut where the smallest gram changes or a run is long, with words and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (words, at) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                places, h = np.sort(np.array(at)), np.frombuffer(words, np.uint64)
                least = least_grams(h, window)[places]
                cuts = run_starts((np.diff(places) > 1) | (least[1:] != least[:-1]))
                for first, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
                    own = h[places[first] : places[end - 1] + window].tobytes()
                    out.append((row, int(places[first]), int(least[first].view(np.int64)), own, hashlib.md5(own).digest()))
            rows = pa.array([o[0] for o in out], pa.int64())
            start = pc.add(batch.column(2).take(rows), pa.array([o[1] for o in out], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(rows) for i in range(2)], pa.array([o[2] for o in out], pa.int64()), start,
                 pa.array([o[3] for o in out], pa.binary()), pa.array([o[4] for o in out], pa.binary())],
                names=["id", "class", "gram", "start", "words", "content"],
            )
    return parts.select("id", "class", "start", "words", "at").mapInArrow(
        run, "id long, class long, gram long, start int, words binary, content binary"
    )


def search_shards(contents: DataFrame, window: int) -> DataFrame:
    """Per content the stretches (start, end) that an earlier document than its first has."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, ["shard"]):
            for a, b in zip(edges, edges[1:], strict=False):
                shard = rows.slice(a, b - a).combine_chunks()
                texts = [np.frombuffer(w, np.uint64) for w in shard["words"].to_pylist()]
                owners = shard["first"].to_numpy()
                found: list[list[dict[str, int]]] = [[] for _ in texts]
                for i, start, end in FMIndex(texts, owners, window).earlier_matches(owners, window):
                    found[i].append({"start": start, "end": end})
                yield pa.RecordBatch.from_arrays(
                    [shard["content"].combine_chunks(), shard["first"].combine_chunks(), pa.array(found, kind)],
                    names=["content", "first", "found"],
                )
    return dealt_by_key(contents, ["shard"]).mapInArrow(
        run, "content binary, first long, found array<struct<start:int,end:int>>"
    )


def content_windows(contents: DataFrame, window: int) -> DataFrame:
    """Every window of each content: two hashes of 64 bits over its words, and where it begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begins = joined(batch.column(2))
            place = np.flatnonzero(starts_with_room(begins, window, len(flat)))
            row = np.searchsorted(begins, place, side="right") - 1
            keys = [gram_hashes(h, window)[place].view(np.int64) for h in (flat, mix(flat ^ SECOND))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0]), pa.array(keys[1]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array((place - begins[row]).astype(np.int32))],
                names=["h", "g", "content", "first", "at"],
            )
    return contents.select("content", "first", "words").mapInArrow(
        run, "h long, g long, content binary, first long, at int"
    )


def search_windows(contents: DataFrame, window: int) -> DataFrame:
    """What ``search_shards`` finds, by the smallest owner of each window: no gram is gathered in a task.

    Owners are combined map-side; the smallest ones are a table of their own, so that the
    join with it can split a window that very many contents have.
    """
    rows = content_windows(contents, window)
    least = rows.groupBy("h", "g").agg(F.min("first").alias("least"), F.max("first").alias("last"))
    least = stable(least.where("least < last").select("h", "g", "least"))
    later = rows.join(least, ["h", "g"]).where("first > least")
    span = F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    return later.groupBy("content").agg(F.min("first").alias("first"), F.collect_list(span).alias("found"))


def searched_contents(contents: DataFrame, window: int) -> DataFrame:
    """Contents with what earlier documents have of them, by shards of whole grams or by windows.

    Grams with more words than a shard may have, at most one per shard, go by windows.
    """
    grams = stable(contents.groupBy("gram").agg(F.sum(F.octet_length("words") / 8).alias("n")))
    shards = max(1, int(-(-(grams.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS)))
    full = grams.where(F.col("n") > SHARD_WORDS).select("gram")
    light = contents.join(F.broadcast(full), "gram", "left_anti")
    found = search_shards(light.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))), window)
    if full.isEmpty():
        return found
    heavy = contents.join(F.broadcast(full), "gram", "left_semi")
    some = search_windows(heavy, window).select("content", "found")
    return found.unionByName(heavy.select("content", "first").join(some, "content", "left"))


def fits(df: DataFrame, spans: str) -> bool:
    """Whether rows with lists of places can be broadcast: their size is summed, not guessed."""
    places = F.greatest(F.coalesce(F.size(spans), F.lit(0)), F.lit(0))
    return (df.agg(F.sum(64 + 40 * places)).first()[0] or 0) <= BROADCAST_BYTES


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys of two classes or more; as a table of its own, so that a join with it can split a hot key."""
    ends = df.groupBy(key).agg(F.min("class").alias("a"), F.max("class").alias("b"))
    return stable(ends.where("a < b").select(key))


def identified(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, DataFrame]:
    """A column of 64 bits that stands for the text, and the smallest and last id of each text.

    A second hash tells where different texts share the first; these get another one.
    """
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    shared: list[int] = []
    while True:
        first = F.xxhash64(F.col(text))
        name = F.when(first.isin(shared), F.xxhash64(F.lit(len(shared)), F.col(text))).otherwise(first) if shared else first
        ids = stable(docs.select(id_.alias("id"), name.alias("class"), second_hash(F.col(text)).alias("h")).groupBy("class").agg(
            F.min("id").alias("id"), F.max("id").alias("last"), F.min("h").alias("a"), F.max("h").alias("b"),
        ))
        more = [r[0] for r in ids.where("a <> b").select("class").collect()]  # about n^2 / 2^65 of n texts
        if not more:
            return name, ids.select("class", "id", "last")
        shared += more


def second_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


def repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW,
    identity: tuple[Column, DataFrame] | None = None,
) -> DataFrame:
    """Per different text: ``class``, ``first`` (its smallest id) and the stretches ``gone`` of that document.

    Only texts with copies or stretches have a row.  What can repeat is found in two
    rounds, by the smallest gram of a window and then by the window's hash, so the
    segments that remain repeat elsewhere; equal ones are one content.  Shards of
    contents, dealt by gram, are indexed and searched: equal windows have equal grams and
    meet in a shard.  The contents of a gram with more than ``SHARD_WORDS`` words are
    not indexed but compared window by window, so no shard grows with the input.
    """
    name, ids = identity or identified(docs, text, doc_id)
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), name.alias("class"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    all_runs = written(runs(keyed, window))
    grams = repeated(all_runs, "gram")
    left = all_runs.join(grams, "gram", "left_semi").select("class", "start", "count").distinct()
    parts = left.groupBy("class").agg(F.collect_list(F.struct("start", "count")).alias("parts"))
    parts = stable(parts.join(ids.select("class", "id"), "class"))
    small = fits(parts, "parts")
    found = keyed.join(F.broadcast(parts) if small else parts, ["id", "class"]).select("id", "class", "text", "parts")
    pieces = written(segments(found, window))
    hashes = window_hashes(pieces, window)
    places = hashes.join(repeated(hashes, "h"), "h", "left_semi").groupBy("class", "start").agg(F.collect_set("at").alias("at"))
    kept = written(stretches(pieces.join(places, ["class", "start"]), window))
    contents = written(kept.groupBy("content").agg(
        F.min("id").alias("first"), F.first("gram").alias("gram"), F.first("words").alias("words"),
    ))
    searched = searched_contents(contents, window)
    gone = kept.select("id", "class", "content", "start", (F.octet_length("words") / 8).cast("int").alias("n")).join(searched, "content")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    gone = gone.withColumn("span", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("found"))))
    gone = gone.groupBy("class").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("span.start")).alias("start"), (F.col("start") + F.col("span.end")).alias("end"),
    )).alias("gone"))
    copies = ids.where("id < last").select("class", F.col("id").alias("first"))
    both = copies.join(gone, "class", "full")
    return stable(both)


def cut(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, and ``kept``: the words left, joined by one space.

    A word goes if a window over it also starts in a document with a smaller id; windows
    are judged on the texts as given.  A later copy of a whole text goes whole if it has a
    window.  Null ids count as the largest, so their windows never cause a removal.

    Null and empty texts have no words; texts shorter than a window stay; rows of equal
    ids do not remove each other's words; an empty table gives no rows; only the named
    columns are read.
    """
    identity = identified(docs, text, doc_id)
    fate = repeats(docs, text, doc_id, window, identity)
    small = fits(fate, "gone")
    rows = docs.select(F.col(doc_id).alias("doc_id"), identity[0].alias("class"), F.col(text).alias("text"))
    both = rows.join(F.broadcast(fate) if small else fate, "class", "left").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)) > F.col("first")).alias("copy"), "gone",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, begins = split_words(batch.column(1), SPLIT)
                n = np.diff(begins)
                cover = np.zeros(len(flat) + 1, np.int64)
                copies = pc.fill_null(batch.column(2), False).to_pylist()
                for row, (copy, gone) in enumerate(zip(copies, batch.column(3).to_pylist(), strict=True)):
                    if copy and n[row] >= window:
                        gone = [{"start": 0, "end": n[row]}]
                    for s in gone or ():
                        cover[begins[row] + s["start"]] += 1
                        cover[begins[row] + s["end"]] -= 1
                stays = np.cumsum(cover)[:-1] <= 0
                kept = np.concatenate([[0], np.cumsum(stays)])[begins]
                lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(stays)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(n - np.diff(kept)), pc.binary_join(lists, " ")],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


ORACLE = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as v
  from (select doc_id, w, unnest(range(1, cast(len(w) - {WINDOW - 2} as bigint))) as i from w where len(w) >= {WINDOW})),
firsts as (select v, min(doc_id) as first from windows group by v),
hit as (
  select distinct doc_id, i + k as p
  from (select doc_id, i, unnest(range(0, {WINDOW})) as k from windows join firsts using (v) where first < doc_id)),
gone as (select doc_id, list(p) as ps, count(*) as n from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(case when n is null then array_to_string(w, ' ') when n = len(w) then '' else array_to_string(
    list_transform(list_filter(list_zip(w, range(1, cast(len(w) + 1 as bigint))), lambda x: not list_contains(ps, x[2])),
      lambda x: x[1]), ' ') end) as kept_sha256
from w left join gone using (doc_id)
"""
