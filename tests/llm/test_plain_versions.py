"""Operators without SQL next to plain versions of their methods."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import fixtures as fx
from lettings.llm import pseudonyms, quality, sharding, toxicity


@pytest.fixture(scope="module")
def rows():
    return [*fx.corpus(9, 80), *[(2000 + i, "a heavy text " * 9, "en", "h", 0) for i in range(150)]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, fx.SCHEMA).repartition(4)


def spread(*parts):
    text = ":".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain_packing(rows, shards, bundles, heavy, pieces):
    """Shard of each row with a distinct (id, text), by the greedy method in loops."""
    items = [(r[0], hashlib.md5((r[1] or "").encode()).hexdigest(), (len((r[1] or "").encode()) + 8, len(fx.words(r[1])), 1)) for r in rows]
    whole = [max(1, sum(v[d] for _, _, v in items)) for d in range(3)]
    groups = defaultdict(lambda: [0, 0, 0])
    for _, g, v in items:
        groups[g] = [a + b for a, b in zip(groups[g], v, strict=True)]
    cut = {g: max(1, math.ceil(max(x / w for x, w in zip(v, whole, strict=True)) * shards * pieces))
           for g, v in groups.items() if max(x / w for x, w in zip(v, whole, strict=True)) > heavy / shards}
    units, of = defaultdict(lambda: [0, 0, 0]), []
    for i, g, v in items:
        unit = f"{g}:{spread(i, g) % cut[g]}" if g in cut else f"b{int(g[:8], 16) % bundles}"
        units[unit] = [a + b for a, b in zip(units[unit], v, strict=True)]
        of.append(unit)
    names = [u for u in sorted(units) if ":" not in u] + [u for u in sorted(units) if ":" in u]
    vectors = [[x / w for x, w in zip(units[u], whole, strict=True)] for u in names]
    left, where = [[1.0 / shards] * 3 for _ in range(shards)], {}
    for k in sorted(range(len(names)), key=lambda k: -max(vectors[k])):
        scores = [sum(a * b for a, b in zip(room, vectors[k], strict=True)) for room in left]
        best = max(range(shards), key=lambda s: (round(scores[s], 15), -s))
        left[best] = [a - b for a, b in zip(left[best], vectors[k], strict=True)]
        where[names[k]] = best
    return [where[u] for u in of]


def test_packing_equals_the_greedy_method(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(fx.prose(rng, rng.randrange(1, 90))), "en", "a", 0) for i in range(400)]
    rows += [(1000 + i, "a heavy text " * 9, "en", "h", 0) for i in range(150)]
    got = {r["doc_id"]: r["shard"] for r in sharding.pack(spark.createDataFrame(rows, fx.SCHEMA).repartition(4), shards=6).collect()}
    want = plain_packing(rows, 6, sharding.BUNDLES, sharding.HEAVY, sharding.PIECES)
    assert [got[r[0]] for r in rows] == want


def test_posteriors_equal_the_moments_in_loops(docs, rows, spark):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows) if r[0] is not None and i % 3], "doc_id long, quality int")
    model = quality.fit(docs, labels, "text", "doc_id")
    scored = [r.asDict() for r in quality.evidence(docs, model, "text", "source", "lang").collect()]
    unit = quality.UNIT

    def good(r):
        return math.floor(1 / (1 + math.exp(-r["__logit"])) * unit + 0.5)

    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r in scored:
        for table, key in ((paths, (r["__host"], r["__path"])), (hosts, r["__host"])):
            table[key][0] += good(r)
            table[key][1] += 1
    n = len(scored)
    mean = sum(g for g, _ in hosts.values()) / unit / n
    away = sum(k * (g / unit / k - mean) ** 2 for g, k in hosts.values())
    s1 = round(quality.strength(away, len(hosts) - 1, n, sum(k * k for _, k in hosts.values()), mean), 4)
    inner = sum(k * (g / unit / k - hosts[h][0] / unit / hosts[h][1]) ** 2 for (h, _), (g, k) in paths.items())
    squares = sum(k * k / hosts[h][1] for (h, _), (_, k) in paths.items())
    s2 = round(quality.strength(inner, len(paths) - len(hosts), n, squares, mean), 4)
    got = quality.classify(docs, labels).collect()
    want = []
    for r in scored:
        g, k = hosts[r["__host"]]
        host = (g / unit + s1 * mean) / (k + s1)
        g, k = paths[r["__host"], r["__path"]]
        path = min(max(((g - good(r)) / unit + s2 * host) / (k - 1 + s2), 1e-6), 1 - 1e-6)
        logit = r["__logit"] + math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        want.append((str(r["doc_id"]), r["text"] or "", host, path, 1 / (1 + math.exp(-logit))))
    got = sorted((str(r["doc_id"]), r["text"] or "", r["host_posterior"], r["path_posterior"], r["posterior"]) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-5)


def test_chain_scores_equal_plain_sums(docs, rows, spark):
    chain = toxicity.Chain(
        ("first", "second"), ("w1", "w", "only", "here", "one"), 0,
        ((-0.5, np.array([0.3, 0.7, 2.0, -1.0, 0.4])), (0.2, np.array([0.1, -0.6, 0.5, 0.5, 0.9, 1.7]))),
    )
    want = []
    for r in rows:
        present = set(re.findall(r"[^\W\d_]+", (r[1] or "").lower()))
        scores = []
        for b, w in chain.models:
            z = b + sum(w[i] for i, word in enumerate(chain.vocabulary) if word in present)
            z += sum(w[len(chain.vocabulary) + k] * s for k, s in enumerate(scores))
            scores.append(1 / (1 + math.exp(-z)))
        want.append((str(r[0]), *scores))
    got = sorted((str(r["doc_id"]), *r["scores"]) for r in toxicity.predict(docs, chain).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)


def test_words_of_the_sample_are_words_of_scoring(spark):
    texts = ["İstanbul ΣΑΣ ſtraße É", "A1b2 c_d", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, __text string")
    got = {r["doc_id"]: r["__w"] for r in toxicity.word_lists(df).collect()}
    flat, begins = toxicity.letter_words(__import__("pyarrow").array(texts))
    words = flat.to_pylist()
    assert [got[i] for i in range(4)] == [list(dict.fromkeys(words[a:b])) for a, b in zip(begins, begins[1:], strict=False)]
    assert got[1] == ["a", "b", "c", "d"] and got[2] == got[3] == []


def plain_feistel(digits, key, domain):
    half = len(digits) // 2
    halves = [digits[:half], digits[half:]]
    value, size = [int(h) for h in halves], [10 ** len(h) for h in halves]
    for i in range(pseudonyms.ROUNDS):
        changed, other = (0, 1) if i % 2 == 0 else (1, 0)
        noise = hashlib.sha256(f"{key}:{domain}:{i}:{len(digits)}:{value[other]}".encode()).hexdigest()[:12]
        value[changed] = (value[changed] + int(noise, 16)) % size[changed]
    return "".join(str(v).zfill(len(h)) for v, h in zip(value, halves, strict=True))


def test_digits_are_permuted_by_the_network(spark):
    rng = random.Random(4)
    numbers = ["".join(rng.choice("0123456789") for _ in range(n)) for n in range(2, 20) for _ in range(4)]
    df = spark.createDataFrame([(d,) for d in numbers], "d string")
    got = {r["d"]: r["e"] for r in df.select("d", pseudonyms.permuted_digits(F.col("d"), "k", "test").alias("e")).collect()}
    assert got == {d: plain_feistel(d, "k", "test") for d in numbers}
    assert Counter(map(len, got.values())) == Counter(map(len, numbers))
