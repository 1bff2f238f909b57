"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettings.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows):
    sound = [
        (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    def order(s, i):
        return (-s, i is None, i or 0)

    out = []
    for at, (anchor, label, v) in enumerate(sound):
        if anchor is None or anchor % 50:
            continue
        scored = [(score(v, w), i, own) for k, (i, own, w) in enumerate(sound) if k != at]
        near = sorted(((s, i) for s, i, own in scored if own == label), key=lambda x: order(*x))[:5]
        for p, positive in near:
            far = [(s, i) for s, i, own in scored if own != label and 50 * p <= 100 * s <= 95 * p]
            for rank, (s, i) in enumerate(sorted(far, key=lambda x: order(*x))[:3]):
                out.append((anchor, positive, rank + 1, i, p, s))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Clusters with exact copies of one vector, ties, null and odd components, repeated rows, null ids and labels."""
    rng = random.Random(11)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = []
    for i in range(700):
        v = [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]
        out.append((i, v, rng.randrange(4) if i % 3 else 1))
    common = [0.5, 0.25, 0.0, -1.0, 0.5, 0.0, 0.0, 1.0]
    out += [(1000 + i, common, 1 if i % 4 else 2) for i in range(300)]
    out += [(2000, [1.0, None], 1), (2001, None, 1), (2002, [float("nan")] * 8, 2), (2003, [float("inf")] * 8, 2)]
    out += [(2004, common, None), (None, common, 1), (None, common, 3), (None, [0.0] * 8, 3), (2050, [], 2), (2100, [2.0, 1.0], 1)]
    out += [out[50], out[50], out[100], (2150, [0.0] * 8, 0), (2200, [-x for x in common], 5)]
    return out


def mined(df):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0).collect()), key=str)


@pytest.mark.parametrize(("tree", "block", "portion"), [(2_048, 1_024, 32 << 20), (90, 7, 1)])
def test_negatives(spark, rows, monkeypatch, tree, block, portion):
    for name, value in (("TREE_ROWS", tree), ("BLOCK_QUERIES", block), ("BROADCAST_BYTES", portion), ("ANCHORS_PER_PART", block)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"key": F.lit(1), "id": F.lit(2), "own": F.lit("x")})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert mined(df) == plain_negatives(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_no_vectors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def tree_of(vectors):
    n = len(vectors)
    ids = np.arange(n, dtype=np.int64)[:, None]
    return negatives.CoverTree(vectors, np.array(["x"] * n, object), [str(i) for i in range(n)], ids)


def test_radii_cover_and_every_point_is_in_one_node():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(m, 6, (200, 5)) for m in rng.normal(0, 300, (10, 5))]).astype(np.int64)
    tree = tree_of(vectors)
    norms = (vectors.astype(float) ** 2).sum(axis=1)
    wide = np.column_stack([vectors, np.sqrt(norms.max() - norms)])

    def below(node):
        return np.concatenate([tree.points[node], *[below(c) for c in tree.children[node]]])

    assert sorted(below(0).tolist()) == list(range(len(vectors)))
    assert len(tree.centre) > 10
    for node, centre in enumerate(tree.centre):
        members = below(node)
        assert np.linalg.norm(wide[members] - wide[centre], axis=1).max() <= tree.radius[node] + 1e-6
        assert np.linalg.norm(vectors[members] - vectors[centre], axis=1).max() <= tree.plain[node] + 1e-6


def test_search_skips_nodes_outside_of_the_windows():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(m, 3, (200, 6)) for m in rng.normal(0, 400, (20, 6))]).astype(np.int64)
    tree = tree_of(vectors)
    asked = vectors[::100]
    high = (asked**2).sum(axis=1)[:, None]
    queries = negatives.Queries(["q"] * len(asked), np.array(["y"] * len(asked), object), asked, high // 2, high * 95 // 100, high)
    search = negatives.Search(tree, queries, 3, same=False)
    q, _, p, s = search.run()
    scores = asked @ vectors.T
    for i in range(len(asked)):
        inside = np.flatnonzero((scores[i] >= queries.low[i, 0]) & (scores[i] <= queries.high[i, 0]))
        best = inside[np.lexsort((inside, -scores[i][inside]))][:3]
        assert sorted(zip(s[q == i].tolist(), p[q == i].tolist(), strict=True)) == sorted(
            zip(scores[i][best].tolist(), best.tolist(), strict=True))
    assert search.verified < 0.5 * scores.size


def test_lists_of_different_lengths_become_rows():
    got = negatives.int_rows(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())))
    assert got.tolist() == [[1, 2], [0, 0], [3, 0]]
