"""MinHash near-duplicates by a multi-index Hamming join over chunks of the signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lettings.llm.common import (
    components, dealt_by_key, gram_hashes, hash_words, in_block_pairs, mix, slices, sorted_runs, split_words,
    starts_with_room,
)
from lettings.session import stable

SHINGLE, PERCENT = 5, 85
SYMBOLS, CHUNKS, ERRORS = 50, 10, 1  # 16-bit symbols; each chunk may differ in so many symbols
DISTANCE = CHUNKS * (ERRORS + 1) - 1  # by pigeonhole some chunk of closer signatures has few enough errors
SIGNATURE_BLOCK, SET_BLOCK, SET_BYTES, SMALL = 1000, 500, 32 << 20, 16
BROADCAST_IDS = 500_000
SPLIT = r"[ \t-\r]+"


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Distinct shingle hashes of each text, sorted; where each text's begin; a digest of its words."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    flat, begins = split_words(lower, SPLIT)
    h, n = hash_words(flat), np.diff(begins)
    room = starts_with_room(begins, SHINGLE, len(h))
    x = gram_hashes(h, SHINGLE)[room]
    text = np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0))
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = [gram_hashes(h[begins[i] : begins[i + 1]], int(n[i]))[0] ^ np.uint64(n[i]) for i in short]
        x, text = np.concatenate([x, np.array(own, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    if len(x):
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (text[1:] != text[:-1])])
        x, text = x[first], text[first]
    starts = np.searchsorted(text, np.arange(len(n) + 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat), " ").to_pylist()
    digests = [hashlib.md5(t.encode()).digest() if k else None for t, k in zip(joined, n, strict=True)]
    return x, starts, digests


def signatures(x: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """MinHash symbols of 16 bits (texts x symbols); the texts all have a shingle."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(1, 1 << 63, symbols, dtype=np.uint64)
    out = np.zeros((len(starts) - 1, symbols), np.uint16)
    for j in range(symbols):
        least = np.minimum.reduceat((x ^ salts[j]) * factors[j], starts[:-1])
        out[:, j] = mix(least) >> np.uint64(48)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk with every choice of one symbol left out."""
    width = sig.shape[1] // CHUNKS
    wide, keys = sig.astype(np.uint64), []
    for c in range(CHUNKS):
        for out in range(width):
            key = np.full(len(sig), c * width + out + 1, np.uint64)
            for j in range(width):
                if j != out:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, c * width + j])
            keys.append(key)
    return np.stack(keys, axis=1)


def forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``near(i, left)`` says which of the places ``left`` are linked with ``i``."""
    left, edges = np.arange(n), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            linked = near(queue.pop(), left)
            edges += [(root, int(j)) for j in left[linked]]
            queue += left[linked].tolist()
            left = left[~linked]
    return edges


def sign(docs: DataFrame) -> DataFrame:
    """Per row of ``__id``, ``__text``: words' digest, number of shingles and signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                x, starts, digests = shingles(batch.column(batch.schema.get_field_index("__text")))
                counts = np.diff(starts)
                full = counts > 0
                sig = iter(signatures(x, np.append(starts[:-1][full], len(x)), SYMBOLS) if full.any() else ())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(c)) for c in ("__id", "__given", "__md5")],
                     pa.array(digests, pa.binary()), pa.array(counts.astype(np.int64)),
                     pa.array([next(sig).tobytes() if f else None for f in full], pa.binary())],
                    names=["__id", "__given", "__md5", "class", "n_shingles", "sig"],
                )
    return docs.mapInArrow(run, "__id long, __given long, __md5 string, class binary, n_shingles long, sig binary")


def keyed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = as_matrix(batch.column(1))
            keys = chunk_keys(sig)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "cid"])
    return classes.select("cid", "sig").mapInArrow(run, "key long, cid long")


def as_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def signature_edges(members: DataFrame) -> DataFrame:
    """A spanning forest, per bucket, of the pairs whose signatures are within the distance."""
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, names):
            cid, sig = rows["cid"].to_numpy(), as_matrix(rows["sig"])
            size, found = np.diff(edges), []
            for s in range(2, SMALL + 1):
                at = edges[:-1][size == s]
                for i in range(s if len(at) else 0):
                    for j in range(i + 1, s):
                        near = (sig[at + i] != sig[at + j]).sum(axis=1) <= DISTANCE
                        found.append(np.stack([cid[at[near] + i], cid[at[near] + j]]))
            for a, b in zip(edges[:-1][size > SMALL], edges[1:][size > SMALL], strict=True):
                own = sig[a:b]
                pairs = forest(b - a, lambda i, left, own=own: (own[left] != own[i]).sum(axis=1) <= DISTANCE)
                found.append(np.array([(cid[a + i], cid[a + j]) for i, j in pairs], np.int64).reshape(-1, 2).T)
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            low, high = both.min(axis=0), both.max(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(low[low < high]), pa.array(high[low < high])], names=["a", "b"])

    return dealt_by_key(members, names, ["cid"]).mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                x, starts, _ = shingles(batch.column(2))
                sets = [x[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["cid", "root", "shingles"]
                )
    return docs.mapInArrow(run, "cid long, root long, shingles binary")


def exact_edges(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest, per group, of the pairs whose full sets are similar enough."""
    names = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in sorted_runs(batches, names):
            cid, found = rows["cid"].to_numpy(), []
            column = rows["shingles"]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(s, np.uint64) for s in column.slice(a, b - a).to_pylist()]
                found += [(cid[a + i], cid[a + j]) for i, j in linked_sets(sets, percent)]
            both = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return dealt_by_key(members, names, ["cid"]).mapInArrow(run, "a long, b long").where("a <> b")


def linked_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Forest of the sets with percent * union <= 100 * intersection, counted on the sets themselves."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(code.max() + 1, np.int64)

    def near(i: int, left: np.ndarray) -> np.ndarray:
        possible = (100 * sizes[left] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[left])
        out = np.zeros(len(left), bool)
        if possible.any():
            mine = code[starts[i] : starts[i + 1]]
            flag[mine] = 1
            some = left[possible]
            if 4 * len(some) > len(sizes):
                shared = np.add.reduceat(flag[code], starts[:-1])[some]
            else:
                shared = np.array([flag[code[starts[j] : starts[j + 1]]].sum() for j in some])
            flag[mine] = 0
            out[possible] = 100 * shared >= percent * (sizes[i] + sizes[some] - shared)
        return out

    return forest(len(sets), near)


def blocked(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Adds the pair of blocks (columns i, j); ``blocks`` is computed over counts of the key."""
    return in_block_pairs(df, key, "cid", blocks, ("i", "j"))


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links) and kept.

    Texts of the same words are one class.  Signatures of 50 symbols are cut into 10
    chunks; two signatures that differ in at most 19 symbols have a chunk with at most one
    error, so they share a key that leaves one symbol of a chunk out.  Within the keys,
    pairs within the distance give candidate groups, and within these links are decided on
    the full shingle sets.  At each step a group gives a forest, not all its pairs; a full
    group is dealt out by pairs of blocks.

    Rows without words have no shingles, are linked with nothing and kept.  Rows of one id
    are one document.  Rows with a null id take part; they are kept where no linked row
    has an id.  An empty table gives no rows.  Only the named columns are read.
    """
    rows, known, least = grouped(docs, text, doc_id, percent)
    final = rows.join(known.join(least, "root").select("class", "component"), "class", "left").select(
        F.col("__given").alias("doc_id"), "n_shingles",
        F.when(F.col("class").isNull(), F.col("__given")).otherwise(F.col("component")).alias("component_id"),
    )
    return final.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def redundant(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """How many rows stay if one row of each group stays: ``doc_id``, ``text_md5`` and ``stay``.

    The row with the smallest id stays (nulls last), of one id the text with the smallest
    words' digest and md5.  Rows that agree in id and text are listed once, with 0 if all
    go and 1 if one of several stays; rows that are not listed stay.  Rows without words
    are never listed.
    """
    rows, known, _ = grouped(docs, text, doc_id, percent)
    pairs = rows.where(F.col("class").isNotNull()).groupBy("__given", "__md5").agg(
        F.count(F.lit(1)).alias("n"), F.first("class").alias("class"))
    rooted = pairs.join(known.select("class", "root"), "class")
    order = F.struct(F.col("__given").isNull().alias("anonymous"), "__given", "class", "__md5")
    best = rooted.groupBy("root").agg(F.min(order).alias("best"))
    first = F.col("__given").eqNullSafe(F.col("best.__given")) & (F.col("__md5") == F.col("best.__md5"))
    return rooted.join(best, "root").where(~first | (F.col("n") > 1)).select(
        F.col("__given").alias("doc_id"), F.col("__md5").alias("text_md5"), first.cast("int").alias("stay"),
    )


def grouped(docs: DataFrame, text: str, doc_id: str, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows; ``class``, ``cid`` and ``root`` of the classes of equal words; the smallest id per root."""
    given = F.col(doc_id).cast("long")
    anonymous = -1 - F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 62))
    named = docs.select(F.coalesce(given, anonymous).alias("__id"), given.alias("__given"), F.col(text).alias("__text"), F.md5(F.col(text)).alias("__md5"))
    rows = stable(sign(named))
    classes = stable(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("__id").alias("cid"), F.min("__given").alias("first_id"), F.first("sig").alias("sig"),
    ))
    keys = stable(keyed(classes))
    full = keys.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count(F.lit(1)).alias("n"))
    # merged at every size, so that the plan of a small input is that of a large one
    members = keys.join(full.where("a < b").select("key", "n").hint("merge"), "key").join(classes.select("cid", "sig"), "cid")
    near = signature_edges(blocked(members, "key", F.ceil(F.col("n") / SIGNATURE_BLOCK)).drop("n"))
    groups = components(near, "a", "b").select(F.col("node").alias("cid"), "root")
    groups = stable(groups)
    small = groups.count() <= BROADCAST_IDS
    found = named.join(F.broadcast(groups) if small else groups, F.col("__id") == F.col("cid"))
    sets = stable(shingle_sets(found.select("cid", "root", "__text")).distinct())
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / SET_BLOCK), F.ceil(F.col("bytes") / SET_BYTES))
    links = exact_edges(blocked(sets.join(sizes, "root"), "root", blocks).drop("n", "bytes"), percent)
    labels = components(links, "a", "b").select(F.col("node").alias("cid"), "root")
    known = classes.select("class", "cid", "first_id").join(labels, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = stable(known)
    return rows, known, known.groupBy("root").agg(F.min("first_id").alias("component"))


ORACLE = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
s as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_transform(range(1, cast(len(w) - {SHINGLE - 2} as bigint)), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) end) as s from w),
items as materialized (select doc_id, len(s) as n, unnest(s) as x from s),
links as materialized (
  select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) as (select doc_id, doc_id from w union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join least using (doc_id)
"""
