"""Hard negatives from cover trees over norm-augmented vectors, searched best first."""

from __future__ import annotations

import contextlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lettings.llm.common import written
from lettings.session import stable

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of its positive.
LOW, HIGH = 50, 95
SCALE, LARGEST = 256, 1 << 26
#: Radii shrink by this from level to level; nodes with no more points are leaves; smaller groups join their parent.
BASE, LEAF, LEAST = 1.3, 64, 8
TREE_ROWS, BLOCK_QUERIES, CHUNK = 2_048, 1_024, 512
BROADCAST_BYTES = 32 << 20
ANCHORS_PER_PART = 10_000
NONE = np.iinfo(np.int64).max


@dataclass
class CoverTree:
    """Points under nodes, each with its centre, and the radii that cover all points below it.

    A point x gets one more coordinate, ``sqrt(M^2 - |x|^2)`` with the largest norm M, so all
    have norm M and a query (with 0 there) is the nearer the higher its inner product is.
    ``radius`` covers the augmented points, ``plain`` the given ones.  A node's children
    are centres further apart than the next radius, its own centre first.
    """

    vectors: np.ndarray
    labels: np.ndarray
    keys: list[str]
    ids: np.ndarray  # points x rows kept, the smallest first, NONE where there are fewer
    centre: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    plain: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    points: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rank = np.argsort(np.argsort(self.ids[:, 0], kind="stable"), kind="stable")
        norms = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        self.norm2 = float(norms.max(initial=0.0))
        if not self.centre and len(self.vectors):
            self.build(np.column_stack([self.vectors, np.sqrt(np.maximum(self.norm2 - norms, 0))]).astype(np.float64))

    def build(self, spread: np.ndarray) -> None:
        def distances(members: np.ndarray, centre: int, columns: int) -> np.ndarray:
            return np.sqrt(((spread[members, :columns] - spread[centre, :columns]) ** 2).sum(axis=1))

        every, d = np.arange(len(spread)), spread.shape[1]
        work: list[tuple[int, int, np.ndarray]] = [(-1, 0, every)]
        while work:
            parent, centre, members = work.pop()
            away = distances(members, centre, d)
            node, radius = len(self.centre), float(away.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.plain.append(float(distances(members, centre, d - 1).max()))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if len(members) <= LEAF or radius == 0:
                self.points.append(members)
                continue
            own: list[np.ndarray] = []
            rest, near = members[np.argsort(-away, kind="stable")], centre
            while len(rest):
                covered = distances(rest, near, d) <= radius / BASE
                group = rest[covered]
                if len(group) <= LEAST:
                    own.append(group)
                else:
                    work.append((node, near, group))
                rest = rest[~covered]
                near = int(rest[0]) if len(rest) else -1
            self.points.append(np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64))


@dataclass
class Queries:
    """A block of queries; the windows (of scores) are padded with empty ones."""

    keys: list[str]
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sources: np.ndarray  # the positive score that a window comes from


def products(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products of integer rows, exact."""
    if exact_floats:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1], 1)
    return np.pad(a, ((0, 0), (0, d - a.shape[1]))), np.pad(b, ((0, 0), (0, d - b.shape[1])))


class Search:
    """The best ``k`` points in each window of each query, higher scores first, ties by smallest id."""

    def __init__(self, tree: CoverTree, queries: Queries, k: int, same: bool, floor: np.ndarray | None = None) -> None:
        self.tree, self.queries, self.k, self.same = tree, queries, k, same
        self.at, self.of = same_width(tree.vectors, queries.vectors)
        wide = float(np.abs(self.at).max(initial=0)) * float(np.abs(self.of).max(initial=0)) * self.at.shape[1]
        self.floats = wide < 2.0**52  # then all sums are exact in floats
        self.norm2 = (self.of.astype(np.float64) ** 2).sum(axis=1)
        n, w = queries.low.shape
        self.scores = np.full((n, w, k), np.iinfo(np.int64).min, np.int64)
        self.found = np.full((n, w, k), -1, np.int64)
        self.floor = (queries.low if floor is None else np.maximum(queries.low, floor)).copy()  # lower scores cannot enter any more
        self.verified = 0

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, window, point and score of all that is found."""
        waiting: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.at) and len(self.of):
            self.enter(waiting, [0], np.arange(len(self.of)))
        while waiting:
            _, node, who, lower, upper = heapq.heappop(waiting)
            who = who[self.wanted(who, lower, upper)]
            if len(who):
                points = self.tree.points[node]
                for a in range(0, len(points), CHUNK):
                    self.verify(points[a : a + CHUNK], who)
                self.enter(waiting, self.tree.children[node], who)
        query, window, place = np.nonzero(self.found >= 0)
        return query, window, self.found[query, window, place], self.scores[query, window, place]

    def wanted(self, who: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Queries with a window that the bounds meet, above what is found in it."""
        return ((upper[:, None] >= self.floor[who]) & (lower[:, None] <= self.queries.high[who])).any(axis=1)

    def enter(self, waiting: list, nodes: list[int], who: np.ndarray) -> None:
        if not nodes:
            return
        tree = self.tree
        middle = products(self.of[who], self.at[[tree.centre[n] for n in nodes]], self.floats).astype(np.float64)
        both = (self.norm2[who] + tree.norm2)[:, None]
        slack = 1e-9 * both + 1e-6
        radius, plain = np.array([tree.radius[n] for n in nodes]), np.array([tree.plain[n] for n in nodes])
        away = np.sqrt(np.maximum(both - 2 * middle, 0))
        reach = np.sqrt(self.norm2[who])[:, None] * plain
        upper = np.minimum((both - np.maximum(away - radius, 0) ** 2) / 2, middle + reach) + slack
        lower = np.maximum((both - (away + radius) ** 2) / 2, middle - reach) - slack
        for i, node in enumerate(nodes):
            meets = self.wanted(who, lower[:, i], upper[:, i])
            if meets.any():
                some = upper[meets, i]
                heapq.heappush(waiting, (-float(some.max()), node, who[meets], lower[meets, i], some))

    def verify(self, points: np.ndarray, who: np.ndarray) -> None:
        self.verified += len(points) * len(who)
        scores = products(self.of[who], self.at[points], self.floats)
        equal = self.tree.labels[points][None, :] == self.queries.labels[who][:, None]
        within = (scores >= self.floor[who].min(axis=1)[:, None]) & (scores <= self.queries.high[who].max(axis=1)[:, None])
        q, p = np.nonzero(within & (equal if self.same else ~equal))
        s, q, p = scores[q, p], who[q], points[p]
        for w in range(self.floor.shape[1]):
            hit = (s >= self.floor[q, w]) & (s <= self.queries.high[q, w])
            if hit.any():
                self.merge(w, q[hit], p[hit], s[hit])

    def merge(self, w: int, q: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        old = np.unique(q)
        q = np.concatenate([q, np.repeat(old, self.k)])
        p = np.concatenate([p, self.found[old, w].ravel()])
        s = np.concatenate([s, self.scores[old, w].ravel()])
        q, p, s = q[p >= 0], p[p >= 0], s[p >= 0]
        order = np.lexsort((self.tree.rank[p], -s, q))
        q, p, s = q[order], p[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        first = place < self.k
        q, p, s, place = q[first], p[first], s[first], place[first]
        self.found[q, w, place], self.scores[q, w, place] = p, s
        self.floor[old, w] = np.maximum(self.floor[old, w], self.scores[old, w, self.k - 1])


class Best:
    """The best ``k`` rows in each window of a block's queries over all trees so far."""

    def __init__(self, queries: Queries, k: int) -> None:
        self.queries, self.k = queries, k
        shape = (*queries.low.shape, k)
        self.scores = np.full(shape, np.iinfo(np.int64).min, np.int64)
        self.ids = np.full(shape, NONE, np.int64)
        self.own = np.zeros(shape, bool)

    def add(self, tree: CoverTree, same: bool) -> None:
        q, w, p, s = Search(tree, self.queries, self.k, same, self.scores[:, :, -1]).run()
        n = (tree.ids[p] != NONE).sum(axis=1)
        own = np.array([self.queries.keys[a] == tree.keys[b] for a, b in zip(q.tolist(), p.tolist(), strict=True)], bool)
        old = np.nonzero(self.ids != NONE)
        q, w = np.concatenate([np.repeat(q, n), old[0]]), np.concatenate([np.repeat(w, n), old[1]])
        s = np.concatenate([np.repeat(s, n), self.scores[old]])
        ids = np.concatenate([tree.ids[p][tree.ids[p] != NONE], self.ids[old]])
        own = np.concatenate([np.repeat(own, n), self.own[old]])
        order = np.lexsort((ids, -s, w, q))
        q, w, s, ids, own = q[order], w[order], s[order], ids[order], own[order]
        if not len(q):
            return
        starts = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (w[1:] != w[:-1])]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        first = place < self.k
        at = q[first], w[first], place[first]
        self.scores[at], self.ids[at], self.own[at] = s[first], ids[first], own[first]

    def rows(self) -> pa.RecordBatch:
        q, w, k = np.nonzero(self.ids != NONE)
        ids = self.ids[q, w, k]
        return pa.RecordBatch.from_pydict({
            "key": pa.array(self.queries.keys, pa.string()).take(pa.array(q)), "source": self.queries.sources[q, w],
            "score": self.scores[q, w, k], "id": pa.array(ids, mask=ids == NONE - 1), "own": self.own[q, w, k],
        })


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, as doubles are multiplied; saturated at 2^26 in size."""
    return F.transform(
        vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long")
    )


def usable(vector: Column, label: Column) -> Column:
    """No null label, vector or component, and finite components only."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(sound, F.lit(False))


def classes(rows: DataFrame, kept: int) -> DataFrame:
    """One row per label and vector, with the ``kept`` smallest ids of its rows (nulls last); combined before it is shuffled."""
    order = Window.partitionBy("key").orderBy(F.col("id").asc_nulls_last())
    first = rows.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= kept)
    held = F.array_sort(F.collect_list(F.struct("__nth", "id")))
    return first.groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.transform(held, lambda x: x["id"]).alias("ids"),
    )


def int_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[inside] = flat
    return out


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of so many rows at most."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def packed(df: DataFrame, n: int, rows: int, make) -> DataFrame:
    """Rows of neighbouring labels in pickled pieces of at most ``rows``: ``low`` and ``high`` label, ``piece``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_pieces(batches, rows):
            labels = table["label"].to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"low": [min(labels)], "high": [max(labels)], "piece": [pickle.dumps(vars(make(table)), protocol=5)]})

    placed = df.repartitionByRange(max(1, -(-n // rows)), "label", "key")
    return written(placed.mapInArrow(run, "low string, high string, piece binary"))


def as_tree(kept: int):
    def make(table: pa.Table) -> CoverTree:
        ids = np.full((len(table), kept), NONE, np.int64)
        for i, own in enumerate(table["ids"].to_pylist()):
            for j, x in enumerate(own):
                ids[i, j] = NONE - 1 if x is None else x  # a null id comes after all others
        return CoverTree(int_rows(table["vector"]), np.array(table["label"].to_pylist(), object), table["key"].to_pylist(), ids)
    return make


def as_queries(low: int | None, high: int | None):
    """Blocks of queries: without percentages one window takes all scores, else there is one per positive score."""
    def make(table: pa.Table) -> Queries:
        least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        if low is None:
            sources = np.zeros((len(table), 1), np.int64)
            lows, highs = np.full_like(sources, least), np.full_like(sources, most)
        else:
            sources = int_rows(table["scores"])
            real = np.arange(sources.shape[1])[None, :] < table["scores"].combine_chunks().value_lengths().to_numpy()[:, None]
            lows = np.where(real, -(-low * sources // 100), most)
            highs = np.where(real, high * sources // 100, least)
        return Queries(table["key"].to_pylist(), np.array(table["label"].to_pylist(), object), int_rows(table["vector"]), lows, highs, sources)
    return make


def restored(kind: type, piece: pa.Buffer):
    """A tree or block from its pickled fields."""
    out = kind.__new__(kind)
    out.__dict__.update(pickle.loads(piece))
    return out


@contextlib.contextmanager
def small_batches(spark, rows: int):
    """Few rows at a time go to Python, as each holds a whole tree."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


FOUND = "key string, source long, score long, id long, own boolean"


def searched(trees: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """The best ``k`` rows per query and window; every block of queries meets every tree that can have some.

    Blocks are sent to the trees' tasks in portions of bounded size, one portion after the
    other.  What a task's earlier trees have found raises the bounds for the later ones, and
    only the task's best rows leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tree = None
        best: dict[int, Best] = {}
        for batch in batches:
            for number, piece, block in zip(*[batch.column(c) for c in ("number", "piece", "block")], strict=True):
                piece = piece.as_buffer()
                if held is None or not piece.equals(held):
                    held, tree = piece, restored(CoverTree, piece)
                if number.as_py() not in best:
                    best[number.as_py()] = Best(restored(Queries, block.as_buffer()), k)
                best[number.as_py()].add(tree, same)
        for found in best.values():
            yield found.rows()

    spark = trees.sparkSession
    sized = blocks.select("number", F.octet_length("block").alias("bytes")).orderBy("number").collect()  # a number per block
    portions: list[list[int]] = []
    filled = 0
    for r in sized:
        if not portions or filled + r["bytes"] > BROADCAST_BYTES:
            portions.append([])
            filled = 0
        portions[-1].append(r["number"])
        filled += r["bytes"]
    b, t = blocks.alias("b"), trees.alias("t")
    if same:
        meet = (F.col("b.low") <= F.col("t.high")) & (F.col("t.low") <= F.col("b.high"))
    else:
        meet = ~((F.col("b.low") == F.col("t.high")) & (F.col("b.high") == F.col("t.low")) & (F.col("t.low") == F.col("t.high")))
    parts = []
    with small_batches(spark, 8):
        for numbers in portions:
            portion = b.where(F.col("number").between(numbers[0], numbers[-1]))
            both = t.join(F.broadcast(portion), meet).select("b.number", "t.piece", "b.block")
            parts.append(written(both.mapInArrow(run, FOUND)))
    out = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        out = out.union(part)
    order = Window.partitionBy("key", "source").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered_blocks(pieces: DataFrame) -> DataFrame:
    return stable(pieces.select(F.monotonically_increasing_id().alias("number"), "low", "high", F.col("piece").alias("block")))


def mine(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives: anchor_id, positive_id, rank, negative_id and both scores.

    Scores are inner products of ``floor(scale * x)``.  An anchor's positives are its best
    ``positives`` other rows of the same label; a positive's negatives are the best
    ``negatives`` rows of other labels with a score between ``low`` and ``high`` percent of
    its own.  Higher scores come first, ties by smaller id, null ids last.

    Rows with a null label, a null vector or a null, NaN or infinite component take no
    part.  Repeated rows count separately, so the second row of an anchor's id is another
    row.  A row with a null id is no anchor.  Vectors of different lengths are filled up
    with zeros.  Components are limited to 2^26 in size.  An empty table gives no rows;
    other columns are not read.  Equal vectors of a label are one point with its smallest
    ids, so a common vector is no large group; anchors that share it are searched once.
    """
    kept = positives + 1  # an anchor's own row may be among the first ones
    sound = rows.where(usable(F.col(vector), F.col(label))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        quantised(F.col(vector), scale).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).withColumn("key", F.md5(F.concat_ws(":", "label", F.array_join(F.col("vector").cast("array<string>"), ","))))
    sound = written(sound)
    points = written(classes(sound.drop("anchor"), kept))
    trees = packed(points, points.count(), TREE_ROWS, as_tree(kept))
    anchors = sound.where(F.col("anchor") & F.col("id").isNotNull()).select("id", "key")
    counts = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    asked = written(points.join(counts, "key").select("key", "label", "vector", "n"))
    n_asked, most = asked.agg(F.count(F.lit(1)), F.max("n")).first()

    blocks = numbered_blocks(packed(asked, n_asked, BLOCK_QUERIES, as_queries(None, None)))
    near = searched(trees, blocks, kept, same=True)
    entry = F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "own")
    near = written(near.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("near")))
    # a class of one row has the anchor itself as its only entry, which is no positive
    alone = F.size(F.filter("near", lambda e: e["own"])) == 1
    scores = F.array_distinct(F.transform(
        F.filter("near", lambda e: ~(F.col("alone") & e["own"])), lambda e: e["positive_score"]))
    windows = near.withColumn("alone", alone).select("key", scores.alias("scores")).where(F.size("scores") > 0)
    windowed = written(asked.join(windows, "key").select("key", "label", "vector", "scores"))
    blocks = numbered_blocks(packed(windowed, n_asked, BLOCK_QUERIES, as_queries(low, high)))
    far = searched(trees, blocks, negatives, same=False)
    far = written(far.groupBy("key", F.col("source").alias("positive_score")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("far")
    ))
    # anchors of one vector are dealt to parts, each with the vector's few results
    parts = max(1, -(-(most or 0) // ANCHORS_PER_PART))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    by_key = far.groupBy("key").agg(F.collect_list(F.struct("positive_score", "far")).alias("all_far"))
    results = near.join(by_key, "key").select("key", "near", "all_far", part)
    dealt = anchors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).join(results, ["key", "part"])
    own = F.array_position(F.transform("near", lambda e: e["own"] & (e["positive_id"] == F.col("id"))), True)
    others = F.slice(F.filter("near", lambda e, i: i + 1 != F.col("own_at")), 1, positives)
    chosen = dealt.withColumn("own_at", F.coalesce(own, F.lit(0))).select(
        F.col("id").alias("anchor_id"), "all_far", F.explode(others).alias("p"))
    paired = chosen.select(
        "anchor_id", "p.positive_id", "p.positive_score",
        F.explode(F.flatten(F.transform(
            F.filter("all_far", lambda f: f["positive_score"] == F.col("p.positive_score")), lambda f: f["far"],
        ))).alias("n"),
    )
    return paired.select(
        "anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), "n.negative_id", "positive_score",
        F.col("n.negative_score").alias("negative_score"),
    )


ORACLE = """
with v as (
  select row_number() over () as nr, vec_id, label as old_label, embedding,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select nr, vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from v),
scores as (
  select a.nr as a_nr, a.vec_id as anchor_id, b.nr as b_nr, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(a.e, b.e) as bigint) as score
  from q a join q b on a.nr <> b.nr where a.vec_id % 50 = 0),
positives as (
  select * from (
    select a_nr, anchor_id, other_id as positive_id, score as positive_score, b_nr as p_nr,
      row_number() over (partition by a_nr order by score desc, other_id) as n
    from scores where same) where n <= 5),
negatives as (
  select p.anchor_id, p.positive_id, s.other_id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.a_nr, p.p_nr order by s.score desc, s.other_id) as n
  from positives p join scores s on s.a_nr = p.a_nr and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score
from negatives where n <= 3
"""
