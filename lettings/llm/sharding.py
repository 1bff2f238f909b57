"""Sharding by vector bin packing over bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lettings.llm.common import n_words, numbered_copies, running_total, spread
from lettings.session import stable

SHARDS, BUNDLES, HEAVY, PIECES = 24, 4096, 0.5, 16
DIMENSIONS = ("bytes", "tokens", "rows")


def place(items: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item (rows of shares of the whole, one column per dimension).

    Largest first; each goes where its dot product with the residual capacity is highest,
    the first such bin of several.  Bins may go over capacity, then the residual is negative.
    """
    where = np.zeros(len(items), np.int64)
    left = np.full((bins, items.shape[1]), 1.0 / bins)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        best = int(np.argmax(left @ items[i]))
        where[i], left[best] = best, left[best] - items[i]
    return where


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, bundles: int = BUNDLES,
    heavy: float = HEAVY, pieces: int = PIECES,
) -> DataFrame:
    """Adds size, law, shard, slot and grown_shard; sizes, words and rows of the shards are near equal.

    Equal texts are a group and stay together, unless the group exceeds ``heavy`` of a
    shard in a dimension: then it is dealt in pieces of 1 / ``pieces`` of a shard, as one
    shard could not hold it.  Other groups are gathered by hash in ``bundles`` bundles,
    so that what is placed is bounded: bundles and pieces, at any number of documents.
    Slots number a shard's rows from 0 in an order given by the ids.

    A null text counts as an empty one; empty texts are one group; repeated rows count
    separately; an empty table gives no rows; columns of the same name are replaced.
    """
    base = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumns({
        "__group": F.md5(F.coalesce(F.col(text), F.lit(""))),
        "size": (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long"),
        "__tokens": n_words(F.col(text)),
    })
    pairs = stable(base.groupBy("__group", doc_id).agg(
        F.sum("size").alias("bytes"), F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    groups = stable(pairs.groupBy("__group").agg(
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("rows"),
    ))
    totals = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    whole = {d: max(int(totals[d] or 0), 1) for d in DIMENSIONS}
    # equal rows that are more than a small part of a piece are told apart, so they can be dealt
    base = numbered_copies(base, ["__group", doc_id], "__nth", int(totals["rows"] or 0) // (8 * shards * pieces), pairs)
    share = F.greatest(*[F.col(d) / whole[d] for d in DIMENSIONS])
    big = groups.where(share > heavy / shards)
    big_rows = sorted(big.collect())  # at most dimensions * shards / heavy groups have such a share
    bundle = F.concat(F.lit("b"), F.conv(F.substring("__group", 1, 8), 16, 10).cast("long") % bundles)
    small = groups.where(share <= heavy / shards).groupBy(bundle.alias("unit")).agg(
        *[F.sum(d).alias(d) for d in DIMENSIONS]
    ).collect()  # at most ``bundles`` rows

    spark = docs.sparkSession
    cuts = [
        (r["__group"], max(1, int(np.ceil(max(r[d] / whole[d] for d in DIMENSIONS) * shards * pieces)))) for r in big_rows
    ]
    cut = F.broadcast(spark.createDataFrame(cuts, "__group string, __pieces int"))
    first = F.col("__nth") == 0
    base = base.withColumn("__at", F.when(first, spread(F.col(doc_id), F.col("__group"))).otherwise(
        spread(F.col(doc_id), F.col("__group"), F.col("__nth")))).drop("__nth")
    piece = F.concat("__group", F.lit(":"), F.col("__at") % F.col("__pieces"))
    names = [r["unit"] for r in sorted(small)]
    vectors = [[r[d] / whole[d] for d in DIMENSIONS] for r in sorted(small)]
    if cuts:  # equal texts have equal vectors, so a piece's rows tell all; at most all groups' pieces are collected
        of = {r["__group"]: [r[d] / whole[d] / r["rows"] for d in DIMENSIONS] for r in big_rows}
        for r in sorted(base.join(cut, "__group").groupBy("__group", piece.alias("unit")).count().collect()):
            names.append(r["unit"])
            vectors.append([v * r["count"] for v in of[r["__group"]]])
    where = place(np.array(vectors).reshape(len(names), len(DIMENSIONS)), shards)

    units = F.broadcast(spark.createDataFrame([(u, int(w)) for u, w in zip(names, where, strict=True)], "__unit string, shard int"))
    unit = F.when(F.col("__pieces").isNull(), bundle).otherwise(piece)
    dealt = base.join(cut, "__group", "left").withColumn("__unit", unit).join(units, "__unit")
    dealt = running_total(dealt, "shard", ["__at", "size"], F.lit(1), "slot", int(totals["rows"] or 0))
    return dealt.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).drop(
        "__group", "__tokens", "__pieces", "__unit", "__at"
    )
