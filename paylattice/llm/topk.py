"""Exact top-k by integer inner product: norm-sorted blocks, rotated partial sums, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, prepare, store

#: Vectors of a block and queries of a block: what one task holds at once.
BLOCK, QUERY_BLOCK, STEP = 16_384, 2_048, 1_024
#: Vectors, chosen by a hash of their id, from which the rotation is taken.
ROTATION_SAMPLE = 20_000
LOWEST = np.iinfo(np.int64).min


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) whose vector is there and has finite components only, each once."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(fine).distinct()


def fewest(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each different vector: more of them are never in a result."""
    order = W.partitionBy("v").orderBy("id")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1).drop("__n")


def matrix(table: pa.Table | pa.RecordBatch, width: int, name: str = "v") -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    rows = table[name].to_pylist()
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[place < k]


def search_block(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
                 turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best of each query in a block.

    Vectors are taken by descending length.  In rotated coordinates the leading part of
    the product is computed, and lengths of the rest bound what can be missing; only
    pairs that may reach a query's k-th best so far are multiplied in full, in integers.
    """
    order = np.argsort(-(vectors * vectors).sum(axis=1), kind="stable")
    vectors, ids = vectors[order], ids[order]
    lead = max(1, turn.shape[1] // 4)
    q, v = queries @ turn, vectors @ turn
    q_rest, v_rest = np.linalg.norm(q[:, lead:], axis=1), np.linalg.norm(v[:, lead:], axis=1)
    q_all, v_all = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    whole, others = queries.astype(np.int64), vectors.astype(np.int64)
    floor = floor.astype(float)
    found = (np.zeros(0, np.int64),) * 3
    for a in range(0, len(ids), STEP):
        b = min(a + STEP, len(ids))
        alive = np.flatnonzero(q_all * v_all[a] * (1 + 1e-9) + 1 >= floor)
        if not len(alive):
            break
        bound = q[alive, :lead] @ v[a:b, :lead].T + np.outer(q_rest[alive], v_rest[a:b])
        bound += 1e-9 * np.outer(q_all[alive], v_all[a:b]) + 1
        i, j = np.nonzero(bound >= floor[alive][:, None])
        i, j = alive[i], j + a
        apart = query_ids[i] != ids[j]
        i, j = i[apart], j[apart]
        parts = [(whole[i[s : s + 200_000]] * others[j[s : s + 200_000]]).sum(axis=1) for s in range(0, len(i), 200_000)]
        got = (i, ids[j], np.concatenate(parts) if parts else np.zeros(0, np.int64))
        found = tuple(np.concatenate(x) for x in zip(found, got, strict=True))
        keep = best(*found, k)
        found = tuple(x[keep] for x in found)
        count = np.bincount(found[0], minlength=len(floor))
        last = np.full(len(floor), LOWEST, np.int64)
        np.copyto(last, np.iinfo(np.int64).max)
        np.minimum.at(last, found[0], found[2])
        floor = np.where(count >= k, np.maximum(floor, last.astype(float)), floor)
    return found


def top_k(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) for each query.

    Ties go to the smaller id, a row never finds rows of its own id.  Rows with a null id,
    a null vector or a component that is null or not finite take no part, rows that
    repeat id and vector count once, and a shorter vector ends in zeros.  Exact: blocks of
    candidates are sorted by length; the block of the longest gives every query a first
    bound, and a query only meets the blocks whose longest vector can still reach it.
    """
    spark = df.sparkSession
    prepare(spark)

    def whole(rows: DataFrame) -> DataFrame:
        return usable(rows, key, vector).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))

    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = store(fewest(whole(df), k).withColumn("size", size), "vectors")
    asked = store(whole(queries).withColumn("size", size), "queries")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, wide, 1)
    blocks = rows.repartitionByRange(max(1, -(-n // BLOCK)), F.desc("size"), "id").withColumn("block", F.spark_partition_id())
    blocks = store(blocks, "blocks")
    longest = {r.block: r.longest for r in blocks.groupBy("block").agg(F.sqrt(F.max("size")).alias("longest")).collect()}  # a row per block
    order = sorted(longest)
    reach = np.array([longest[b] for b in order])
    sample = [r.v for r in rows.orderBy(F.xxhash64("id")).limit(ROTATION_SAMPLE).select("v").collect()]
    fit = np.zeros((len(sample), width))
    for i, x in enumerate(sample):
        fit[i, : len(x)] = x
    turn = np.linalg.svd(fit.T @ fit)[0]
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-m // QUERY_BLOCK)))).cast("int"))

    def cell(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q_ids = left["id"].to_numpy()
        i, ids, scores = search_block(matrix(left, width), q_ids, left["floor"].to_numpy(), matrix(right, width),
                                      right["id"].to_numpy(), turn, k)
        return pa.table({"query_id": q_ids[i], "vec_id": ids, "score": scores})

    def search(cells: DataFrame) -> DataFrame:
        """``cells``: (part, block, id, v, floor), a row for each block that a query must see."""
        pairs = cells.select(F.col("part").alias("for_part"), F.col("block").alias("of_block")).distinct()
        there = blocks.select(F.col("block").alias("of_block"), "id", "v").join(pairs, "of_block")
        return (cells.groupBy("part", "block").cogroup(there.groupBy("for_part", "of_block"))
                .applyInArrow(cell, "query_id long, vec_id long, score long"))

    if not order:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    begin = asked.withColumn("block", F.lit(order[0])).withColumn("floor", F.lit(LOWEST))
    first = store(search(begin.select("part", "block", "id", "v", "floor")), "first-block")
    kth = first.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k)
    bounded = asked.join(kth.select(F.col("query_id").alias("id"), "s"), "id", "left").withColumn("floor", F.coalesce("s", F.lit(LOWEST)))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, floor = np.sqrt(b["size"].to_numpy()), b["floor"].to_numpy().astype(float)
            # blocks come by descending length, so those that matter are the first ones
            ends = [int((r * reach * (1 + 1e-9) + 1 >= f).sum()) for r, f in zip(size, floor, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([order[1:e] for e in ends], pa.list_(pa.int32()))], ["id", "blocks"])

    wanted = arrow_map(bounded.select("id", "size", "floor"), needed, "id long, blocks array<int>")
    cells = bounded.join(wanted, "id").select("part", F.explode("blocks").alias("block"), "id", "v", "floor")
    found = first.unionByName(search(store(cells, "cells")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_hundredth(df: DataFrame) -> DataFrame:
    """Top 10 of the rows whose id is divisible by 100."""
    return top_k(df, df.where("vec_id % 100 = 0"), 10)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
