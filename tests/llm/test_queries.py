"""The registered queries next to their SQL, the pipeline next to plain versions of its stages."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
import fixtures as fx
from checks.compare import compare, connect
from lettings.llm import mixing
from lettings.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("ok" if name in ORACLES else "rows-only"), line
    assert "TYPES" not in line, line


@pytest.mark.parametrize("name", ["op8_divergence_rules", "op10_feistel_pseudonyms"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.judged(spark, docs, SF).collect()
    right = [(r["doc_id"] in {k["doc_id"] for k in kept}) == bool(quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality]
    assert sum(right) >= 0.97 * len(right)

    unique = corpus_pipeline.deduplicated(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in unique) == sorted(r[0] for r in fx.near_duplicates([tuple(r) for r in rows], corpus_pipeline.NEAR_PERCENT) if r[3])

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in clean) == sorted(r[0] for r in fx.benchmark_hits([tuple(r) for r in rows], items) if not r[4])

    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    taken = mixing.mix(docs).select("doc_id", "size", "taken").collect()
    assert mixed == Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in taken if r["taken"] * 2 >= r["size"]})

    shards = corpus_pipeline.sharded(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in shards) == sorted((r["doc_id"], r["text"]) for r in rows)
    assert {n for n, _ in corpus_pipeline.STAGES} and all(set(corpus_pipeline.COLUMNS) <= set(r.asDict()) for r in shards[:1])
