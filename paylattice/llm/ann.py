"""Approximate nearest neighbours by cosine: balanced posting lists behind a graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, prepare, store
from .topk import best, fewest, matrix, usable

#: Vectors the centroids are fitted on, chosen by a hash of their id, and the largest number of centroids.
FIT_SAMPLE, MOST_CENTROIDS = 20_000, 4_096
#: Vectors a posting list should have, without replicas.
LIST_SIZE = 128
#: A vector joins further lists up to this ratio of the distance to its nearest centroid.
REPLICA_RATIO, MOST_REPLICAS = 1.10, 4
#: A query reads the lists up to this ratio of the distance to its nearest centroid.
PROBE_RATIO, LEAST_PROBES = 1.25, 16
NEIGHBOURS, BEAM = 24, 64


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fit_centroids(x: np.ndarray, number: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Balanced k-means on unit vectors: a centroid with many members counts as farther away."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(number, len(x)), replace=False)]
    load = np.zeros(len(centres))
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - load, axis=1) for a in range(0, len(x), 4096)])
        count = np.bincount(owner, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        empty = count == 0
        centres = unit(np.where(empty[:, None], x[rng.choice(len(x), len(centres))], total))
        load = 0.05 * np.clip(count / max(len(x) / len(centres), 1e-9) - 1, -1, 4)
    return centres


class Graph:
    """Centroids with links to their nearest ones, searched best-first from a few entries."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres.astype(np.float32)
        n = len(centres)
        near = [np.argsort(-(self.centres[a : a + 1024] @ self.centres.T), axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
                for a in range(0, n, 1024)]
        self.links = np.concatenate(near) if n > 1 else np.zeros((n, 0), np.int64)
        self.entries = np.linspace(0, n - 1, min(n, 16)).astype(int)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids found for each query and their cosines, nearest first; ``width`` is the beam."""
        queries = queries.astype(np.float32)
        m, n = len(queries), len(self.centres)
        width = min(width, n)
        score = np.full((m, n), -np.inf, np.float32)
        score[:, self.entries] = queries @ self.centres[self.entries].T
        done = np.zeros((m, n), bool)
        active = np.arange(m)
        while len(active):
            own = score[active]
            top = np.argpartition(-own, width - 1, axis=1)[:, :width] if width < n else np.tile(np.arange(n), (len(active), 1))
            value = np.where(done[active[:, None], top], -np.inf, np.take_along_axis(own, top, 1))
            pick = value.argmax(axis=1)
            going = np.isfinite(value[np.arange(len(active)), pick])
            active, step = active[going], top[going, pick[going]]
            done[active, step] = True
            if self.links.shape[1]:
                ahead = self.links[step]
                fresh = ~np.isfinite(score[active[:, None], ahead])
                values = np.einsum("md,mkd->mk", queries[active], self.centres[ahead])
                kept = score[active[:, None], ahead]
                score[active[:, None], ahead] = np.where(fresh, values, kept)
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        return order, np.take_along_axis(score, order, 1)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def exact_cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; equal rows give equal results wherever they stand."""
    return (left * right).sum(axis=1) / (np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1)))


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine, ties to the smaller id.

    Every row is indexed; centroids are fitted on a bounded sample.  A vector on a
    boundary is replicated to several lists.  Of equal vectors the k + 1 smallest ids are
    kept, which loses nothing, so that a hot vector cannot fill a list.  Rows with a null
    id, a null or zero vector or components that are null or not finite take no part,
    rows that repeat id and vector count once, a shorter vector ends in zeros, and a row
    never finds rows of its own id.  With few rows there is one list and the result is exact.
    """
    spark = df.sparkSession
    prepare(spark)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = store(fewest(usable(df, key, vector).where(size > 0), k), "vectors")
    asked = store(usable(queries, key, vector).where(size > 0), "queries")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0], 1)
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    sample = rows.orderBy(F.xxhash64("id")).limit(FIT_SAMPLE).select("v").toArrow()
    number = max(1, min(MOST_CENTROIDS, n // LIST_SIZE))
    graph = Graph(fit_centroids(unit(matrix(sample, width)), number))
    shared = spark.sparkContext.broadcast(graph)  # at most MOST_CENTROIDS vectors

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres
        for b in batches:
            for part in (b.slice(a, 2048) for a in range(0, b.num_rows, 2048)):
                cosine = unit(matrix(part, width)).astype(np.float32) @ centres.T
                some = min(MOST_REPLICAS, len(centres))
                order = np.argsort(-cosine, axis=1, kind="stable")[:, :some]
                away = distance(np.take_along_axis(cosine, order, 1))
                near = away <= REPLICA_RATIO * away[:, :1] + 1e-6
                row, column = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(order[row, column], pa.int32()), part["id"].take(pa.array(row)), part["v"].take(pa.array(row))],
                                                 ["list", "id", "v"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in batches:
            for part in (b.slice(a, 256) for a in range(0, b.num_rows, 256)):
                order, cosine = found.search(unit(matrix(part, width)), max(BEAM, len(found.centres) // 2))
                away = distance(cosine)
                near = np.isfinite(cosine) & ((away <= PROBE_RATIO * away[:, :1] + 1e-6) | (np.arange(order.shape[1]) < LEAST_PROBES))
                row, column = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(order[row, column], pa.int32()), part["id"].take(pa.array(row)), part["v"].take(pa.array(row))],
                                                 ["list", "id", "v"])

    def cell(_, left: pa.Table, right: pa.Table) -> pa.Table:
        got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        q_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        if len(q_ids) and len(ids):
            q, v = matrix(left, width), matrix(right, width)
            for a in range(0, len(q), 512):
                rough = unit(q[a : a + 512]) @ unit(v).T
                rough[q_ids[a : a + 512][:, None] == ids[None, :]] = -np.inf
                kth = np.partition(rough, max(rough.shape[1] - k, 0), axis=1)[:, max(rough.shape[1] - k, 0)]
                i, j = np.nonzero((rough >= kth[:, None] - 1e-9) & np.isfinite(rough))
                score = exact_cosines(q[a + i], v[j])
                keep = best(i, ids[j], score, k)
                got = tuple(np.concatenate(x) for x in zip(got, (q_ids[a + i[keep]], ids[j[keep]], score[keep]), strict=True))
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    schema = "list int, id long, v array<double>"
    posting, wanted = arrow_map(rows, lists, schema).withColumnRenamed("list", "of_list"), arrow_map(asked, probes, schema)
    found = wanted.groupBy("list").cogroup(posting.groupBy("of_list")).applyInArrow(cell, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(df: DataFrame) -> DataFrame:
    """The five nearest of the rows whose id is divisible by 50."""
    return nearest(df, df.where("vec_id % 50 = 0"), 5)
