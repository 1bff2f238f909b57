"""Toxicity by a classifier chain: each category's model sees the probabilities of the earlier ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lettings.llm.common import slices, split_words, spread
from lettings.llm.quality import features, fit_logistic
from lettings.session import stable

MAX_LABELS, WORDS, FOLDS = 20_000, 128, 5
NOT_LETTERS = r"\PL+"
THRESHOLD = 0.5


@dataclass(frozen=True)
class Chain:
    """Vocabulary, then per category intercept and weights: numbers, words, earlier categories."""

    categories: tuple[str, ...]
    vocabulary: tuple[str, ...]
    numbers: int
    models: tuple[tuple[float, np.ndarray], ...]

    def predict(self, numbers: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probabilities (rows x categories) for the words present: pairs of row and word."""
        out = np.zeros((len(numbers), len(self.categories)))
        v = len(self.vocabulary)
        for i, (intercept, w) in enumerate(self.models):
            z = intercept + numbers @ w[: self.numbers] + out[:, :i] @ w[self.numbers + v :]
            z += np.bincount(row, weights=w[self.numbers : self.numbers + v][word], minlength=len(numbers))
            out[:, i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> list[tuple[float, np.ndarray]]:
    """One model per column of ``y``; later ones are trained with out-of-fold probabilities of the earlier ones."""
    models = []
    for i in range(y.shape[1]):
        models.append(fit_logistic(x, y[:, i]))
        if i + 1 < y.shape[1]:
            outside = np.zeros(len(x))
            for f in range(folds):
                b, w = fit_logistic(x[fold != f], y[fold != f, i])
                outside[fold == f] = 1 / (1 + np.exp(-np.clip(b + x[fold == f] @ w, -30, 30)))
            x = np.column_stack([x, outside])
    return models


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], text: str = "text", doc_id: str = "doc_id",
        max_labels: int = MAX_LABELS, n_words: int = WORDS, folds: int = FOLDS) -> Chain:
    """Fits the chain on at most ``max_labels`` labelled documents (those with the smallest hashes of ids).

    The vocabulary is, per category, the ``n_words`` words whose presence tells most
    (log-likelihood ratio), from counts grouped in Spark.  The sample reaches the driver as
    numbers and word places only.  Their texts are read once, and cut in words as in scoring.
    """
    usable = labels.where(F.col(doc_id).isNotNull())
    for c in categories:
        usable = usable.where(F.col(c).isNotNull())
    some = usable.groupBy(doc_id).agg(*[F.max(c).cast("int").alias(f"__y{i}") for i, c in enumerate(categories)])
    some = F.broadcast(some.orderBy(spread(F.col(doc_id)), doc_id).limit(max_labels))
    ys = [f"__y{i}" for i in range(len(categories))]
    sample = docs.select(doc_id, F.col(text).alias("__text")).join(some, doc_id).select(
        F.col(doc_id).alias("__id"), *ys, features(F.col("__text")).alias("__x"), "__text")
    rows = stable(word_lists(sample).withColumnRenamed("__id", doc_id))
    n, *positive = rows.agg(F.count(F.lit(1)), *[F.sum(y) for y in ys]).first()
    counts = rows.select(F.explode("__w").alias("w"), *ys).groupBy("w").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]
    )
    vocabulary: dict[str, int] = {}
    for y, k in zip(ys, positive, strict=True):
        if n and k and k < n:
            for r in counts.where("n >= 3").orderBy(ratio(y, int(k), int(n)).desc(), "w").limit(n_words).collect():
                vocabulary.setdefault(r["w"], len(vocabulary))
    names = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    seen = rows.select(doc_id, *ys, "__x", F.array_intersect("__w", names).alias("__w")).orderBy(doc_id, "__x").limit(max_labels).collect()
    if not seen:
        return Chain(tuple(categories), (), 0, tuple((0.0, np.zeros(i)) for i in range(len(categories))))
    x = np.zeros((len(seen), len(vocabulary)))
    for i, r in enumerate(seen):
        x[i, [vocabulary[w] for w in r["__w"]]] = 1.0
    numbers = np.array([r["__x"] for r in seen], float).reshape(len(seen), -1)
    y = np.array([[r[c] for c in ys] for r in seen], float).reshape(len(seen), len(ys))
    fold = np.arange(len(seen)) % folds
    models = fit_chain(np.column_stack([numbers, x]), y, fold, folds)
    return Chain(tuple(categories), tuple(vocabulary), numbers.shape[1], tuple(models))


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased runs of letters of each text, and where a text's runs begin."""
    return split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS)


def word_lists(rows: DataFrame) -> DataFrame:
    """``__w``, the distinct words, in place of ``__text``."""
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                flat, begins = letter_words(batch.column(batch.schema.get_field_index("__text")))
                lists = [pc.unique(flat.slice(a, b - a)).to_pylist() for a, b in zip(begins, begins[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(batch.schema.get_field_index(f.name)) for f in fields], pa.array(lists, pa.list_(pa.string()))],
                    names=[*[f.name for f in fields], "__w"],
                )

    return rows.mapInArrow(run, StructType([*fields, StructField("__w", ArrayType(StringType()))]))


def ratio(y: str, positive: int, n: int):
    """Log-likelihood ratio of a word's presence and the label."""
    def cell(observed, row, column):
        return F.when(observed > 0, observed * F.log(observed * n / (row * column))).otherwise(0.0)

    a, b = F.col(y), F.col("n") - F.col(y)
    c, d = positive - F.col(y), (n - positive) - (F.col("n") - F.col(y))
    has, lacks = F.col("n"), n - F.col("n")
    return F.round(cell(a, has, F.lit(positive)) + cell(b, has, F.lit(n - positive))
                   + cell(c, lacks, F.lit(positive)) + cell(d, lacks, F.lit(n - positive)), 6)


def predict(docs: DataFrame, chain: Chain, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``scores``, a probability per category in the chain's order.

    Null, empty and blank texts are scored as texts without words; long texts are read
    whole; repeated rows score alike; an empty table gives no rows; a column named
    ``scores`` is replaced.
    """
    keep = tuple(c for c in keep if c != "scores")
    schema = StructType([*[docs.schema[c] for c in keep], StructField("scores", ArrayType(DoubleType()))])
    given = docs.select(
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"), features(F.col(text)).alias("__x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(list(chain.vocabulary), pa.string())
        for whole in batches:
            for batch in slices(whole, "__text"):
                names, rows = batch.schema.names, len(batch)
                flat, begins = letter_words(batch.column(names.index("__text")))
                found = pc.index_in(flat, value_set=vocabulary)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows), np.diff(begins))[known]
                word = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.unique(row * (len(vocabulary) + 1) + word)
                row, word = np.divmod(pairs, len(vocabulary) + 1)
                numbers = np.array(batch.column(names.index("__x")).to_pylist(), float).reshape(rows, -1)
                scores = chain.predict(numbers[:, : chain.numbers], row, word)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(names.index(f"__{i}")) for i in range(len(keep))], pa.array(scores.tolist(), pa.list_(pa.float64()))],
                    names=[*keep, "scores"],
                )

    return given.mapInArrow(run, schema)
