"""Removal of repeated paragraphs by banded MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    LOWER, PACKED, KeyBitmap, KeyPacker, MarkPacker, Prefix, arrow_map, discard, flat_bytes, key_bitmap, mark_bitmaps, mix, shingles, slices,
    store, words,
)
from .ngram_join import resolve

#: Words of a shingle; a paragraph with fewer is left alone.
SHINGLE = 5
#: A passage is cut before a word pair whose hash is the least of so many on either side: cuts depend on near words only.
REACH = 6
#: Most hashes of a signature, and the similarity at which pairs should not collide.
MOST_HASHES, UNLIKE = 100, 0.3
LINE = np.uint8(10)
#: A text is removed by these bytes of it.
SPAN = "struct<start: long, end: long>"


def bands(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, hashes of one): of those that find a pair of similarity ``threshold`` with probability ``recall``, the one that least often finds ``UNLIKE`` pairs."""
    best = None
    for rows in range(1, MOST_HASHES):
        number = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if number * rows > MOST_HASHES:
            break
        false = 1 - (1 - UNLIKE**rows) ** number
        best = min(best or (false, number, rows), (false, number, rows))
    return best[1], best[2]


class Units:
    """Paragraphs of a batch: its lines, and passages that lie anywhere in a text.

    A line is a unit if it has five words.  Passages are cut by content over the whole
    text, whatever its line breaks: text that stands inside a longer line of one document
    and on lines of its own in another has the same passages in both.  What lies before
    the first and behind the last cut of a text is no passage.  Lines share tokens with
    lines only, passages with passages.  For each unit: ``row``, ``number`` (of the line
    among those with a word, -1 for passages), ``start`` and ``end`` in bytes of the text, and
    its distinct shingles ``tokens[at[i]:at[i + 1]]``.
    """

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = flat_bytes(batch["text"])
        low = LOWER[data]
        start, end, first = (np.asarray(x, np.int64) for x in words(low, offsets))
        hashes, n = Prefix(low).ranges(start, end), len(start)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        breaks = np.flatnonzero(low == LINE)
        line = np.searchsorted(breaks, start)
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]))[:n])
        tail = np.append(head[1:], n)[: len(head)]
        self.lines = np.bincount(doc[head], minlength=batch.num_rows)
        number = np.arange(len(head)) - np.searchsorted(head, first[doc[head]])
        before = np.append(-1, breaks)[line[head]] + 1
        behind = np.append(breaks + 1, len(low))[np.searchsorted(breaks, end[tail - 1])]
        long = tail - head >= SHINGLE
        lo, hi = self.passages(hashes, doc, first)
        self.row = np.concatenate([doc[head][long], doc[lo]])
        self.number = np.concatenate([number[long], np.full(len(lo), -1)])
        begin = offsets[self.row]
        self.start = np.concatenate([np.maximum(before, offsets[doc[head]])[long], start[lo]]) - begin
        self.end = np.concatenate([np.minimum(behind, offsets[doc[head] + 1])[long], start[hi]]) - begin
        lo, hi = np.concatenate([head[long], lo]), np.concatenate([tail[long], hi])
        counts = hi - lo - SHINGLE + 1
        unit = np.repeat(np.arange(len(lo)), counts)
        at = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[unit]
        tokens = shingles(hashes, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
        tokens = np.where(self.number[unit] < 0, mix(tokens + np.uint64(1)), tokens)  # a passage never meets the line it stands in
        order = np.lexsort((tokens, unit))
        tokens = tokens[order]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (unit[1:] != unit[:-1]))[: len(tokens)]
        self.tokens, unit = tokens[fresh], unit[fresh]
        self.size = np.bincount(unit, minlength=len(lo))
        self.at = np.append(0, np.cumsum(self.size))
        self.nodes = nodes_of(self.tokens, self.at)

    @staticmethod
    def passages(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of each passage and the word behind its last."""
        n = len(hashes)
        if n <= 2 * REACH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = mix(hashes + np.roll(mix(hashes), -1))
        at = np.arange(n)
        cut = (at - first[doc] >= REACH) & (first[doc + 1] - at > REACH + 1)
        for far in range(1, REACH + 1):
            least = pair[far:] < pair[:-far]
            cut[far:] &= least
            cut[:-far] &= ~least
        cut = np.flatnonzero(cut)
        same = doc[cut[1:]] == doc[cut[:-1]]
        return cut[:-1][same], cut[1:][same]


def signatures(tokens: np.ndarray, at: np.ndarray, number: int, rows: int) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets that lie end to end."""
    flat = tokens ^ (tokens >> np.uint64(29))
    keys = np.zeros((len(at) - 1, number), np.uint64)
    for band in range(number):
        total = np.full(len(at) - 1, band + 1, np.uint64)
        for r in range(rows):
            salt = mix(np.array([band * rows + r + 1], np.uint64))[0] | np.uint64(1)
            total = mix(total + np.minimum.reduceat(flat * salt, at[:-1]))
        keys[:, band] = total
    return keys


def nodes_of(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit identity of non-empty sets that lie end to end: a hash of the sum of their mixed members."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(tokens), at[:-1]) + np.diff(at).astype(np.uint64)).view(np.int64)


def some_sets(tokens: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those sets of a run of sets, end to end again."""
    size = np.diff(at)[chosen]
    to = np.append(0, np.cumsum(size))
    place = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1][chosen], size)
    return tokens[place], to


def first_hashes(threshold: float, missed: float) -> int:
    """How many least hashes pairs of similarity ``threshold`` share none of, or none with unlike marks, with probability ``missed`` at most."""
    return int(np.ceil(np.log(missed) / np.log1p(-threshold * 255 / 256)))


def first_keys(docs: DataFrame, number: int) -> DataFrame:
    """Packed least hashes of all units, marked by set; a set that a task meets often sends its keys twice, as more are not counted."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = MarkPacker(), {}
        for b in slices(batches):
            units, fresh = Units(b), []
            for k, node in enumerate(units.nodes.tolist()):
                times = seen.get(node, 0)
                if times < 2:
                    seen[node] = times + 1
                    fresh.append(k)
            if len(seen) > 300_000:
                seen.clear()
            if fresh:
                fresh = np.array(fresh)
                keys = signatures(*some_sets(units.tokens, units.at, fresh), number, 1)
                yield from packer.add(packer.marked(keys, units.nodes[fresh].view(np.uint64)[:, None]).ravel())
        yield from packer.flush()

    return arrow_map(docs.select("text"), job, PACKED)


def colliding(docs: DataFrame, often: KeyBitmap, shared: KeyBitmap, number: int) -> DataFrame:
    """A row per document with those of its units that may have a copy or a near one and, apart from them, a row per distinct unit that may have a near one.

    A unit with copies has all its least hashes ``often``, one that is near another has
    one ``shared`` with another set.  Copies need no set: only the second ones send theirs.
    The first rows have doc_id, key, n (lines with a word) and the lists numbers, starts, ends and
    nodes; the second a (node), n (size) and tokens.
    """
    both = docs.sparkSession.sparkContext.broadcast((often, shared))
    names = ["doc_id", "key", "n", "numbers", "starts", "ends", "nodes", "a", "tokens"]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, shared), seen = both.value, set()
        for b in slices(batches):
            units = Units(b)
            keys = signatures(units.tokens, units.at, number, 1) if len(units.nodes) else np.zeros((0, number), np.uint64)
            near = shared.has(keys.ravel()).reshape(keys.shape).any(axis=1)
            some = np.flatnonzero(near | often.has(keys.ravel()).reshape(keys.shape).all(axis=1))
            some = some[np.argsort(units.row[some], kind="stable")]
            own = pa.array(np.append(0, np.cumsum(np.bincount(units.row[some], minlength=b.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(own, pa.array(x[some], pa.int64())) for x in (units.number, units.start, units.end, units.nodes)]
            nothing = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(units.lines, pa.int64()), *lists, *nothing], names)
            out = []
            for k in np.flatnonzero(near).tolist():
                node = int(units.nodes[k])
                if node not in seen:
                    seen.add(node)
                    out.append((node, int(units.size[k]), units.tokens[units.at[k] : units.at[k + 1]].tobytes()))
            if len(seen) > 300_000:
                seen.clear()
            if out:
                a, n, t = zip(*out, strict=True)
                none, empty = pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([none, none, pa.array(n, pa.int64()), *[empty] * 4,
                                                  pa.array(a, pa.int64()), pa.array(t, pa.binary())], names)

    return arrow_map(docs, job, "doc_id long, key long, n long, numbers array<long>, starts array<long>, ends array<long>, nodes array<long>, "
                                "a long, tokens binary")


def keys_of(batch: pa.RecordBatch, number: int, rows: int) -> np.ndarray:
    """Band keys of stored sets."""
    data, offsets = flat_bytes(batch["tokens"])
    return signatures(data.view(np.uint64), offsets // 8, number, rows)


def packed_again(sets: DataFrame, number: int, rows: int) -> DataFrame:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = KeyPacker(most_alike=2)
        for batch in batches:
            for b in slices(iter([batch]), "tokens"):
                yield from packer.add(keys_of(b, number, rows).ravel())
        yield from packer.flush()

    return arrow_map(sets.select("tokens"), job, PACKED)


def still_colliding(sets: DataFrame, repeated: KeyBitmap, number: int, rows: int) -> DataFrame:
    """(keys, a, n, tokens) of the sets that have repeated band keys, with these."""
    shared = sets.sparkSession.sparkContext.broadcast(repeated)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(iter([batch]), "tokens"):
                keys = keys_of(b, number, rows)
                hit = shared.value.has(keys.ravel()).reshape(keys.shape)
                own = pa.array([k[h].tobytes() for k, h in zip(keys, hit, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([own, b["a"], b["n"], b["tokens"]], ["keys", "a", "n", "tokens"]).filter(pa.array(hit.any(axis=1)))

    return arrow_map(sets.select("a", "n", "tokens"), job, "keys binary, a long, n long, tokens binary")


def repeated_paragraphs(docs: DataFrame, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """(doc_id, key, n_paragraphs, removed, spans): of each group of similar paragraphs all but the first are listed.

    Paragraphs are lines of five words or more, and passages cut by content (``Units``).
    Two are similar when the Jaccard similarity of their distinct 5-word shingles (ASCII
    white space parts words, A-Z lower-cased) reaches ``percent``; groups are the
    components of that relation, lines and passages apart.  First is the paragraph of the smallest doc_id (null
    last), then the earliest; one that overlaps the first of its group stays too, as it
    is the same text.  ``removed`` has the numbers of lines that go (lines with a word
    count from 0), ``spans`` the bytes of all that goes, which may overlap.  Lines with
    fewer than five words have no shingle and go only inside a passage; null and empty
    texts have no paragraph.  Only sets that share one of a few least hashes with another set are fetched at all; of
    these, candidates collide in one of the bands.  Numbers of hashes and bands follow from the wanted recall, of whose
    misses the hashes take a fifth; similarity is then exact on 64-bit shingle
    hashes.  ``key`` names rows of equal id and text, which are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    number, rows = bands(percent / 100, 1 - (1 - recall) * 0.8)
    first = first_hashes(percent / 100, (1 - recall) * 0.2)
    found = store(colliding(docs, *mark_bitmaps(first_keys(docs, first)), first), "paragraphs")
    # sets that share least hashes with others, but no band, fall out here
    sets = store(found.where("a is not null").select("a", "n", "tokens").dropDuplicates(["a"]), "colliding")
    hits = store(still_colliding(sets, key_bitmap(packed_again(sets, number, rows), 2), number, rows), "colliding-sets")
    discard(sets)
    none = docs.sparkSession.createDataFrame([], "a long, b long")

    def fetch(nodes: DataFrame) -> DataFrame:
        return hits.select(F.col("a").alias("node"), "tokens").join(nodes.select("node").distinct(), "node", "left_semi")

    known = resolve(hits.select("keys", "a", "n", (F.col("n") + number).alias("rest")), None, [none], fetch, percent, ordered=False)

    own = found.where("a is null")
    each = own.select("doc_id", "key", F.explode(F.arrays_zip("numbers", "starts", "ends", "nodes")).alias("p")).select("doc_id", "key", "p.*")
    each = each.join(known.withColumnRenamed("node", "nodes"), "nodes", "left").withColumn("root", F.coalesce("component", "nodes"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "starts", "ends")
    least = each.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    overlap = (F.col("key") == F.col("first.key")) & (F.col("starts") < F.col("first.ends")) & (F.col("ends") > F.col("first.starts"))
    gone = (each.join(least, "root").where(~overlap).groupBy("key")
            .agg(F.array_sort(F.collect_set(F.when(F.col("numbers") >= 0, F.col("numbers")))).alias("removed"),
                 F.array_sort(F.collect_set(F.struct(F.col("starts").alias("start"), F.col("ends").alias("end")))).alias("spans")))
    return own.select("doc_id", "key", "n").join(gone, "key", "left").select(
        "doc_id", "key", F.col("n").alias("n_paragraphs"), F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
        F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """A text without those bytes; spans are in order and may overlap."""
    if not text or not spans:
        return text
    data, kept, at = text.encode(), [], 0
    for span in spans:
        kept.append(data[at : max(at, span["start"])])
        at = max(at, span["end"])
    return b"".join([*kept, data[at:]]).decode()


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """All rows and columns of ``docs``; the text without repeated paragraphs."""
    found = repeated_paragraphs(docs, percent).where("size(spans) > 0").dropDuplicates(["key"])
    names = docs.columns
    key, spans = (next(n for n in (base + "_" * i for i in range(99)) if n not in names) for base in ("row_key", "row_spans"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [without_spans(t, r or []) for t, r in zip(b["text"].to_pylist(), b[spans].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b[c] for c in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(joined.select(*names, spans), job, fields)


def paragraph_report(docs: DataFrame) -> DataFrame:
    """Per row: number of lines with a word, numbers of the removed lines, removed spans, and how many paragraphs are removed."""
    return repeated_paragraphs(docs).select("doc_id", "n_paragraphs", F.size("spans").cast("long").alias("n_removed"), "removed", "spans")
