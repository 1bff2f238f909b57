"""The corpus pipeline: documents are judged, deduplicated, decontaminated, mixed and put into shards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettings.llm import decontamination, mixing, neardup, quality, sharding
from lettings.llm.common import scratch, table, written
from lettings.operators import windows
from lettings.session import remove_folder, shared_folder

NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    judged_docs = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged_docs.where("kept").select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id (nulls last).

    Documents with 80 % of their shingles in common are linked.  Of rows that repeat an id
    and a text one stays, so does one of copies without an id; rows without words all stay.
    """
    docs = docs.select(*COLUMNS)
    listed = written(neardup.redundant(docs, percent=NEAR_PERCENT))
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.md5("d.text") == F.col("l.text_md5"))
    side = F.broadcast(listed) if listed.count() <= neardup.BROADCAST_IDS else listed
    marked = docs.alias("d").join(side.alias("l"), same, "left").select("d.*", "l.stay")
    unique = marked.where("stay is null").select(*COLUMNS)
    if listed.where("stay = 1").isEmpty():
        return unique
    order = [F.col(c).asc_nulls_last() for c in ("lang", "source", "n_chars")]
    return unique.union(windows.top_k_per(marked.where("stay = 1"), ["doc_id", "text"], 1, order).select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    marked = decontamination.mark(docs.select(*COLUMNS), items, keep=COLUMNS)
    return decontamination.with_verdict(marked).where("not contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (never more than twice), to the nearest whole document."""
    return mixing.taken_rows(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.pack(docs.select(*COLUMNS)).select(*COLUMNS, "size", "law", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", judged),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier is fitted and the packing is greedy, which SQL does not express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again.

    What a stage writes on its way, and the result before, are removed once its own result is there.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
