"""Counts of all prefixes against the library, each prefix encoded anew."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lettings.llm import tokencounts
from lettings.llm.queries import QUERIES

PIECES = [
    "a", "b", "'re", "'r", "'ll", "'ve", "'s", "'", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "the", " the", "12", " 3", "!!", "-",
    "é", "ß", "日本", " ", "　", "\u0085", "\x1c", "​", "᠎", "<|endoftext|>", "<|endof", "<", "😀", "é",
    "ndatwh", "123456", "\u0000", "Ş", "'RE", "﻿",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokencounts.VOCABULARY))


def encoded(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(1500)]
    counts, begins, totals = tokencounts.counter(tokencounts.VOCABULARY).batch_counts(pa.array(texts))
    for i, text in enumerate(texts):
        want = [encoded(library, text[:n]) for n in range(1, len(text) + 1)]
        assert counts[begins[i] : begins[i + 1]].tolist() == want, text
        assert totals[i] == (want or [0])[-1]


def test_a_full_store_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "KEPT_UNITS", 5)
    monkeypatch.setattr(tokencounts, "KEPT_PAIRS", 5)
    counter = tokencounts.PrefixCounter(public_tokenizers.path(tokencounts.VOCABULARY))
    texts = [f"one {i} and  {i * 7} more'll {'x' * i}" for i in range(40)]
    for _ in range(2):
        assert counter.batch_counts(pa.array(texts))[2].tolist() == [encoded(library, t) for t in texts]


def test_columns(spark, library):
    texts = [None, "", " ", "plain words", "plain words", "a  b\n\n c'll <|endoftext|> d", "é" * 50, "word " * 40_000, "x" * 200_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, prefix_tokens string")
    counted = tokencounts.prefix_counts(df)
    got = {r["doc_id"]: r for r in tokencounts.totals(counted).collect()}
    for i, text in enumerate(texts):
        n = encoded(library, text or "")
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)
    budget = 7
    cut = {r["doc_id"]: r["text"] for r in tokencounts.truncate(counted, budget).collect()}
    at = {r["doc_id"]: r["n"] for r in counted.select("doc_id", tokencounts.tokens_of_prefix(F.col("prefix_tokens"), 4).alias("n")).collect()}
    for i, text in enumerate(texts):
        fitting = [n for n in range(min(len(text or ""), 300) + 1) if encoded(library, text[:n] if text else "") <= budget]
        assert len(cut[i] or "") == fitting[-1]
        assert at[i] == encoded(library, (text or "")[:4])
    assert tokencounts.prefix_counts(df.where("doc_id < 0")).count() == 0


def test_query_counts_as_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r[0], len((r[1] or "").encode()), n := encoded(library, r[1] or ""), n > 512) for r in docs)
    got = QUERIES["op13_prefix_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, got)) == want


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
