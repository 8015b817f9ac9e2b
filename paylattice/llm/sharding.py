"""Weighted rendezvous sharding of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import store


def best_shard(key: Column, weights: list[float], first: int = 0) -> Column:
    """Struct (score, shard) of the winning shard among ``first`` onwards.

    Each shard draws a number from the key; the largest ``-weight / ln(draw)`` wins, so
    a shard wins in proportion to its weight and a new shard only takes keys.
    """
    def score(shard: int, weight: float) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((F.lit(-float(weight)) / F.log(draw)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[score(first + i, w) for i, w in enumerate(weights)]))


def assign(df: DataFrame, key: str, weights: list[float], parts: int = 1024) -> DataFrame:
    """The rows of ``df`` with ``shard``, ``grown_shard`` (with one more shard of mean weight) and ``slot``.

    The key and the weights alone decide the shard; a null key has a shard like any
    other value.  Slots count 0, 1, 2 ... within a shard.  Rows are numbered in
    ``parts`` salted pieces of each shard, and the pieces' sizes give the offsets, so
    neither a shard nor a repeated key is sorted in one task.  The offsets, at most
    shards x parts rows, are broadcast.  A column of ``df`` named like a result is replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    own = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    extra = best_shard(F.col(key), [sum(weights) / len(weights)], len(weights))
    won = (df.select(*own, best_shard(F.col(key), weights).alias("__won"))
           .select(*own, F.col("__won.shard").alias("shard"), F.greatest("__won", extra)["shard"].alias("grown_shard"),
                   F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("__part")))
    rows = store(won, "shards")
    before = W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
               .select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    within = F.row_number().over(W.partitionBy("shard", "__part").orderBy(key))
    return (rows.withColumn("__row", within).join(F.broadcast(offsets), ["shard", "__part"])
            .select(*own, "shard", (F.col("__before") + F.col("__row") - 1).alias("slot"), "grown_shard"))


def shard_documents(docs: DataFrame, weights: list[float]) -> DataFrame:
    """Digest rows of all documents: size in bytes plus 16, CRC-32 of the text (null: empty), shard and slot."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return assign(rows, "doc_id", weights).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
