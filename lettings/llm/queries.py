"""The registered queries of the operators, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from lettings.llm import (
    conversations, decontamination, mixing, neardup, negatives, pseudonyms, quality, rules, secrets, sharding, substrings,
    tokencounts, toxicity,
)
from lettings.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


@query("op3_sainte_lague_mix", mixing.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_vector_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    return sharding.pack(crc).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "law", "shard", "slot", "grown_shard"
    )


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_wu_manber", decontamination.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.with_verdict(decontamination.mark(docs, items)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query("op8_divergence_rules", rules.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_divergence", 6).alias("char_divergence"), F.round("word_divergence", 6).alias("word_divergence"),
    )


@query("op10_feistel_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_empirical_bayes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"), keep_text=False).select(
        "doc_id", "document_p", "host_posterior", "path_posterior", "posterior", "kept"
    )


@query("op2_classifier_chain")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels name two categories: junk (no quality), then toxic, which sees the first one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = toxicity.fit(docs, labels, ("junk", "toxic"))
    score = F.transform("scores", lambda s: F.round(s, 6))
    return toxicity.predict(docs, chain).select(
        "doc_id", score[0].alias("junk_p"), score[1].alias("toxic_p"), (score[0] >= toxicity.THRESHOLD).alias("junk"),
        (score[1] >= toxicity.THRESHOLD).alias("toxic"),
    )


@query("op6_multi_index_minhash", neardup.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_fm_index", substrings.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op11_checkpointed_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.digest(conversations.repair(conversations.damage(rows)), rows)


@query("op12_cover_tree_negatives", negatives.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op13_prefix_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all prefixes are made for every text; the query reads the last one of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return tokencounts.totals(tokencounts.prefix_counts(docs))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
