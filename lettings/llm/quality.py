"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lettings.llm.common import SPACES, spread, words, written
from lettings.session import stable

MAX_LABELS = 20_000
THRESHOLD = 0.5
UNIT = 1_000_000  # probabilities are summed as whole millionths, so sums do not depend on the order
BROADCAST_SITES = 100_000
FEATURES = ("size", "upper", "digit", "symbol", "mark", "length", "distinct", "again")


def features(text: Column) -> Column:
    """The document's evidence as an array of doubles, in the order of ``FEATURES``."""
    t = F.coalesce(text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    def counted(p: Column) -> Column:
        n, chars = F.greatest(F.size(p["w"]), F.lit(1)), F.greatest(p["length"], F.lit(1))
        again = F.zip_with(
            F.slice(p["w"], F.lit(1), F.greatest(F.size(p["w"]) - 1, F.lit(0))), F.slice(p["w"], F.lit(2), n), lambda x, y: x == y
        )
        return F.array(
            F.log1p(F.size(p["w"]).cast("double")), p["upper"] / chars, p["digit"] / chars, p["symbol"] / chars,
            p["mark"] / chars, p["solid"] / n, F.size(F.array_distinct(p["w"])) / n, F.size(F.filter(again, lambda x: x)) / n,
        )

    parts = F.struct(
        words(text).alias("w"), F.length(t).alias("length"), left(r"[^\p{Lu}]+").alias("upper"),
        left("[^0-9]+").alias("digit"), left(r"[^#*$%&|<>]+").alias("symbol"), left("[^!?]+").alias("mark"),
        left(SPACES).alias("solid"),
    )
    return F.transform(F.array(parts), counted)[0]


@dataclass(frozen=True)
class Linear:
    """A logistic model over standardised features."""

    intercept: float
    weights: tuple[float, ...]

    def logit(self, x: Column) -> Column:
        out = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            out = out + F.lit(float(w)) * x[i]
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 15) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps; intercept and weights for the features as given."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return float(np.log(share / (1 - share))), np.zeros(d)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    z = np.column_stack([np.ones(n), (x - mean) / sd])
    b = np.zeros(d + 1)
    penalty = np.full(d + 1, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        change = np.linalg.solve((z * w[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b = b + np.clip(change, -5, 5)
        if np.abs(change).max() < 1e-8:
            break
    weights = b[1:] / sd
    return float(b[0] - weights @ mean), weights


def sample_labels(labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled ids, those with the smallest hashes; ids with different labels count as 1 if any does."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    one = known.groupBy(doc_id).agg(F.max(label).alias(label))
    return one.orderBy(spread(F.col(doc_id)), doc_id).limit(limit)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        max_labels: int = MAX_LABELS) -> Linear:
    """Fits the document classifier on at most ``max_labels`` labelled documents, which reach the driver as features."""
    some = F.broadcast(sample_labels(labels, label, max_labels, doc_id))  # bounded by the parameter
    rows = docs.select(doc_id, text).join(some, doc_id).select(
        doc_id, F.col(label).cast("int").alias("y"), features(F.col(text)).alias("x")
    ).orderBy(doc_id, "x").limit(max_labels).collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    intercept, weights = fit_logistic(x, np.array([r["y"] for r in rows], float))
    return Linear(intercept, tuple(weights.tolist()))


def key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))


def evidence(docs: DataFrame, model: Linear, text: str, host: str, path: str) -> DataFrame:
    """Adds the document's logit and its site's keys."""
    logit = F.greatest(F.least(model.logit(features(F.col(text))), F.lit(12.0)), F.lit(-12.0))
    return docs.withColumns({"__host": key(F.col(host)), "__path": key(F.col(path)), "__logit": F.round(logit, 6)})


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(spread_: float, groups: int, n: float, squares: float, mean: float) -> float:
    """Prior rows by the method of moments: the more groups differ, the fewer."""
    noise = mean * (1 - mean)
    between = (spread_ - groups * noise) / max(n - squares / max(n, 1), 1e-9)
    return float(np.clip(noise / max(between, 1e-9) - 1, 1.0, 1e6))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior share of good documents per path and host, and the global share.

    Rows are summed to paths before anything is shuffled, paths to hosts, hosts to one row.
    """
    good = F.round(probability(F.col("__logit")) * UNIT).cast("long")
    paths = stable(scored.groupBy("__host", "__path").agg(F.sum(good).alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("__host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    top = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n"), F.count(F.lit(1)).alias("k"),
                    F.sum(F.pow("host_n", F.lit(2))).alias("squares")).first()
    n = int(top["n"] or 0)
    mean = float(np.clip((top["good"] or 0) / UNIT / max(n, 1), 1e-3, 1 - 1e-3))
    host_mean = F.col("host_good") / UNIT / F.col("host_n")
    away = hosts.agg(F.sum(F.col("host_n") * F.pow(host_mean - mean, F.lit(2)))).first()[0] or 0.0
    s1 = round(strength(away, top["k"] - 1, n, top["squares"] or 0, mean), 4)
    both = paths.join(hosts, "__host").withColumn("host_posterior", (host_mean * F.col("host_n") + s1 * mean) / (F.col("host_n") + s1))
    own = F.col("good") / UNIT / F.col("n")
    inner = both.agg(F.sum(F.col("n") * F.pow(own - host_mean, F.lit(2))).alias("away"), F.count(F.lit(1)).alias("k"),
                     F.sum(F.pow("n", F.lit(2)) / F.col("host_n")).alias("squares")).first()
    s2 = round(strength(inner["away"] or 0.0, inner["k"] - top["k"], n, inner["squares"] or 0, mean), 4)
    return both.select("__host", "__path", "host_posterior", "good", "n", F.lit(s2).alias("prior_rows")), mean


def combine(scored: DataFrame, site: DataFrame, mean: float, threshold: float = THRESHOLD) -> DataFrame:
    """Adds document_p, host_posterior, path_posterior, posterior and kept.

    The path's posterior leaves the document itself out.  The classifier's odds are moved
    by how the path's odds differ from the global ones.
    """
    site = stable(site)
    site = F.broadcast(site) if site.count() <= BROADCAST_SITES else site
    p = F.round(probability(F.col("__logit")) * UNIT).cast("long")
    path = (F.col("good") - p) / UNIT + F.col("prior_rows") * F.col("host_posterior")
    path = path / (F.col("n") - 1 + F.col("prior_rows"))
    path = F.greatest(F.least(path, F.lit(1 - 1e-6)), F.lit(1e-6))
    out = scored.join(site, ["__host", "__path"]).withColumns({
        "document_p": F.round(probability(F.col("__logit")), 6), "host_posterior": F.round("host_posterior", 6),
        "path_posterior": F.round(path, 6),
    }).withColumn("posterior", F.round(probability(
        F.col("__logit") + log_odds(F.col("path_posterior")) - F.lit(float(np.log(mean / (1 - mean))))
    ), 6))
    return out.withColumn("kept", F.col("posterior") >= threshold).drop("__host", "__path", "__logit", "good", "n", "prior_rows")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source",
             path: str = "lang", keep_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """Judges each document by its text and its site; see ``combine`` for the added columns.

    Null, empty and blank texts have the features of no words (and are judged by them);
    null hosts and paths are sites of their own; repeated rows count separately; without
    usable labels all evidence is even; an empty table gives no rows; columns named as an
    added one are replaced.
    """
    model = fit(docs, labels, text, doc_id)
    docs = docs.drop("document_p", "host_posterior", "path_posterior", "posterior", "kept", "good", "n", "prior_rows")
    scored = evidence(docs, model, text, host, path)
    # the scores are written, so that each text is looked at once
    scored = written(scored) if keep_text else stable(scored.drop(text))
    site, mean = sites(scored)
    return combine(scored, site, mean, threshold)
