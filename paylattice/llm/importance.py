"""Importance resampling towards a target: hashed word n-grams, bucket gains, Gumbel draw of the best."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, slices, store

#: One byte between words of lower-cased text; words are digits, a-z and everything beyond ASCII.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN = re.compile(APART.encode())
#: Stands between two texts; no word holds it.
SENTINEL = b"\n"
#: Bytes that one pass of the pattern sees at most, unless a single word is longer.
WINDOW_BYTES = 1_000_000
#: Words up to this length are appended to a hash by table.
TABLED = 64


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """(document of each word, the words, words carried over) for windows of a batch.

    All texts are joined with sentinels and one pass of the pattern finds the words of a
    window; a window ends between two words.  The last word of a window leads the next
    one, as the first half of a pair; it is then not counted again.
    """
    rows = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    joined = SENTINEL.join(rows).lower()
    begins = np.cumsum([0] + [len(x) + len(SENTINEL) for x in rows[:-1]])
    at, carried, carried_doc = 0, pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    while at < len(joined):
        edge = BETWEEN.search(joined, at + WINDOW_BYTES)
        end = edge.start() if edge else len(joined)
        parts = pc.split_pattern_regex(pa.array([joined[at:end]], pa.large_binary()), APART).values
        sizes = pc.binary_length(parts).to_numpy()
        starts = at + np.cumsum(sizes + 1) - sizes - 1  # every byte that parts two words is one byte long
        there = sizes > 0
        at = end
        if not there.any():
            continue
        words = pa.concat_arrays([carried, parts.filter(pa.array(there))])
        doc = np.append(carried_doc, np.searchsorted(begins, starts[there], "right") - 1)
        yield doc, words, len(carried)
        carried, carried_doc = words[-1:], doc[-1:]


@cache
def crc_tables() -> np.ndarray:
    """For n up to ``TABLED`` and each byte of a CRC-32: what it becomes when n zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    state = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    steps = [state]
    for _ in range(TABLED):
        state = (state >> np.uint32(8)) ^ one[state & np.uint32(255)]
        steps.append(state)
    return np.stack(steps)


def crc_joined(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each text whose first part has CRC ``first`` and whose second has ``second`` and up to ``TABLED`` bytes."""
    tables = crc_tables()
    moved = tables[sizes, 0, first & np.uint32(255)]
    for k in range(1, 4):
        moved ^= tables[sizes, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return moved ^ second


def features_of(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents of words, documents of features, buckets of features) for windows of a batch.

    Features are runs of 1 to ``longest`` (1 or 2) words of one document.  Each distinct
    word of a window is hashed once; the hash of a pair follows from those of its words.
    """
    for doc, words, carried in words_of(texts):
        coded = words.dictionary_encode()
        names, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        crc = np.array([zlib.crc32(x) for x in names], np.uint32)
        docs, found = [doc[carried:]], [crc[ids[carried:]]]
        if longest > 1 and len(ids) > 1:
            inside = doc[1:] == doc[:-1]  # pairs across a sentinel are none
            a, b = ids[:-1][inside], ids[1:][inside]
            lead = crc_joined(crc, np.full(len(crc), zlib.crc32(b" "), np.uint32), np.ones(len(crc), np.int64))
            sizes = pc.binary_length(coded.dictionary).to_numpy()[b]
            joint = crc_joined(lead[a], crc[b], np.minimum(sizes, TABLED))
            for i in np.flatnonzero(sizes > TABLED):
                joint[i] = zlib.crc32(names[b[i]], int(lead[a[i]]))
            docs.append(doc[1:][inside])
            found.append(joint)
        yield doc[carried:], np.concatenate(docs), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all rows of ``texts(text)`` fall into each bucket.

    Each task sends one row a bucket; what comes back has ``buckets`` rows at most.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, _, found in features_of(batch["text"], longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    counted = arrow_map(texts.select("text"), job, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in counted.collect():  # a row a bucket
        counts[row.bucket] = row.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares of each bucket, target to raw."""
    n, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    ratio = (target + 1.0) * (all_raw + n) / ((raw + 1.0) * (all_target + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            words, features, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for doc, of, found in features_of(batch["text"], longest, len(gain)):
                words += np.bincount(doc, minlength=n)
                features += np.bincount(of, minlength=n)
                total += np.bincount(of, weights=gain[found], minlength=n).astype(np.int64)  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x) for x in (words, features, total // np.maximum(features, 1)))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, job, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> F.Column:
    """floor(-1000 * ln(-ln(u))) where u comes from the digest of seed and doc_id; null without a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25,
             seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs(doc_id, text)``.

    A feature is a run of 1 to ``longest`` (at most 2) consecutive words; its bucket is
    its CRC-32 modulo ``buckets``.  A bucket gains by being likelier among the features of
    all ``target(text)`` rows than among those of all ``docs``.  ``weight`` is the floored
    mean gain of a document's features, ``score`` adds Gumbel noise that depends on
    ``seed`` and doc_id alone, so the highest scores are a draw without replacement.
    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) highest
    scores are drawn, ties to the smaller doc_id; ``rank`` counts them from 1.

    Null and empty texts have no features and weight 0.  A row without doc_id has a weight
    but no score and is never drawn.  Rows that repeat are scored and drawn one by one; among
    equal score and doc_id the higher weight comes first.  Without target rows, or with empty
    tables, the smoothed shares still hold.  Other columns are ignored.

    Scores lie within a span that does not depend on the input (some hundred thousand
    values), so rows are counted by score; those counts give each score's first rank, and
    only rows of equal score, which the noise spreads, are ordered together.
    """
    if longest not in (1, 2):
        raise ValueError("runs of one or two words")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + gumbel(seed))
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scored = store(scored.withColumn("fit", fit), "scored")

    spark = docs.sparkSession
    counted = scored.where("fit").groupBy("score").agg(F.count("*").alias("n")).toPandas()  # a row for each value of the score
    counted = counted.sort_values("score", ascending=False, ignore_index=True)
    before = counted["n"].cumsum() - counted["n"]
    drawn = percent * int(counted["n"].sum()) // 100
    counted = counted.assign(before=before)[before < drawn]
    starts = spark.createDataFrame(pa.table({c: pa.array(counted[c].to_numpy(), pa.int64()) for c in ("score", "before")}))
    # without these rows the join is empty; a row can only be drawn when its score begins before the last place
    best = scored.where("fit").join(F.broadcast(starts), "score")
    place = F.row_number().over(W.partitionBy("score").orderBy("doc_id", F.desc("weight"), "n_features")) + F.col("before")
    best = best.select("doc_id", "n_features", "weight", "score", place.cast("long").alias("rank"))
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    least = int(counted["score"].min()) if len(counted) else None
    rest = scored if least is None else scored.where(~F.col("fit") | (F.col("score") < least))
    return best.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
