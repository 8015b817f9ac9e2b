"""Removal of byte strings that an earlier document holds, by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BUCKET_BITS, KeyBitmap, KeyPacker, Prefix, arrow_map, bucket_tasks, flat_bytes, id_bitmap, key_bitmap, mix, slices, store,
)

#: Length of the strings that count, and of the grams whose least hash files a string.
LENGTH, GRAM = 50, 24
#: A run of strings filed under one gram is cut after so many.
LONGEST_RUN = 64
#: So many runs of different content under one file key are compared in one task; under keys with more, single strings are
#: dealt by their own hashes.
HEAVY = 10_000
#: Bytes of runs that are refined at once.
REFINED = 500_000
#: Runs a task gathers before it sends them, without and with their bytes.
SENT, SENT_WITH_BYTES = 300_000, 40_000
#: Buckets of rows that no bucket holds: settled spans, and heavy keys or the runs under them.
SETTLED, APART = -1, -2
LATE = np.iinfo(np.int64).max
RUN = np.dtype([("file", "<u4"), ("content", "<u8"), ("rank", "<i8"), ("key", "<i8"), ("start", "<i4"), ("count", "u1")])
SPAN = np.dtype([("start", "<i4"), ("stop", "<i4")])
PARTS = "bucket int, key long, keys binary, data binary"
NAMES = ["bucket", "key", "keys", "data"]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of one document with the same file key: key, first string, number, document.

    A string's file key is the least gram hash within it, so equal strings have equal
    keys wherever they are, and neighbours mostly share theirs.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    file = least_of(Prefix(data).grams(GRAM), LENGTH - GRAM + 1)
    turn = np.zeros(len(data) + 1, np.int32)
    np.add.at(turn, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(turn, offsets[1:], -1)
    inside = np.cumsum(turn[: len(file)]) == 0
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (file[1:] != file[:-1])
    start = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (file[1:] != file[:-1])
    count = np.flatnonzero(last) + 1 - start
    if (count > LONGEST_RUN).any():
        parts = -(-count // LONGEST_RUN)
        step = np.arange(parts.sum()) - np.repeat(np.append(0, np.cumsum(parts)[:-1]), parts)
        start, end = np.repeat(start, parts) + step * LONGEST_RUN, np.repeat(start + count, parts)
        count = np.minimum(LONGEST_RUN, end - start)
    return file[start], start, count, np.searchsorted(offsets, start, "right") - 1


def file_keys(docs: DataFrame) -> DataFrame:
    """Packed file keys of each document, once each."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = KeyPacker(most_alike=2)
        for b in slices(batches):
            file, _, _, doc = runs(*flat_bytes(b["text"]))
            order = np.lexsort((doc, file))
            file, doc = file[order], doc[order]
            yield from packer.add(file[np.append(True, (file[1:] != file[:-1]) | (doc[1:] != doc[:-1]))] if len(file) else file)
        yield from packer.flush()

    return arrow_map(docs.select("text"), job, "bucket int, keys binary")


def packed_spans(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document of spans found in a task, overlapping ones merged."""
    if not len(key):
        return
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    fresh = np.append(True, key[1:] != key[:-1])
    doc = np.cumsum(fresh) - 1
    shift = doc * (int(stop.max()) + 1)  # documents apart, so that one running maximum serves all
    reach = np.maximum.accumulate(stop + shift)
    head = np.append(True, (start + shift)[1:] > reach[:-1])
    first = np.flatnonzero(head)
    spans = np.zeros(len(first), SPAN)
    spans["start"], spans["stop"] = start[first], np.maximum.reduceat(stop + shift, first) - shift[first]
    own = key[first]
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    blobs = [spans[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(spans)), strict=True)]
    yield batch_of(np.full(len(cut), SETTLED), own[cut], blobs)


def batch_of(bucket, key, keys: list[bytes], data: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(keys), pa.int64()),
         pa.array(keys, pa.binary()), pa.array(data, pa.binary()) if data else pa.nulls(len(keys), pa.binary())], NAMES)


def joined(data: np.ndarray) -> bytes:
    """Bytes of texts one after another, from bytes objects or from rows of equal length."""
    return b"".join(data) if data.dtype == object else data.tobytes()


def by_bucket(file: np.ndarray, rows: np.ndarray, data: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows for the buckets of the file keys; ``data`` adds the bytes of each run, one after another."""
    bucket = (file >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, int)
    ends = np.append(cut[1:], len(rows))
    blobs = [rows[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    texts = [joined(data[order[a:b]]) for a, b in zip(cut, ends, strict=True)] if data is not None else None
    if blobs:
        yield batch_of(bucket[cut], None, blobs, texts)


def place_of(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of a document's key and a place in it."""
    return mix(key.view(np.uint64) + (start.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def beaten(file: np.ndarray, content: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which rows have the file key and the content of a row of smaller rank."""
    if not len(file):
        return np.zeros(0, bool)
    order = np.lexsort((rank, content, file))
    file, content, sorted_rank = file[order], content[order], rank[order]
    fresh = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (content[1:] != content[:-1])))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(sorted_rank[fresh], np.diff(np.append(fresh, len(order)))) < sorted_rank
    return out


def run_rows(file: np.ndarray, content: np.ndarray, rank: np.ndarray, key: np.ndarray, start: np.ndarray, count) -> np.ndarray:
    rows = np.zeros(len(file), RUN)
    rows["file"] = (file << np.uint64(BUCKET_BITS)) >> np.uint64(32)  # the bits behind those of the bucket
    for name, values in (("content", content), ("rank", rank), ("key", key), ("start", start), ("count", count)):
        rows[name] = values
    return rows


def sent_runs(docs: DataFrame, wanted: KeyBitmap, places: KeyBitmap | None = None, heavy: np.ndarray | None = None) -> DataFrame:
    """Packed runs whose file key is wanted, and spans that the task could already settle.

    With ``places`` only runs at those places, together with their bytes; those under ``heavy`` file keys go apart,
    anywhere.

    Of equal runs that a task holds at once only those of the smallest document go on; the others hold
    nothing that this document doesn't, so they are removed.
    """
    shared = docs.sparkSession.sparkContext.broadcast((wanted, places, np.zeros(0, np.int64) if heavy is None else heavy))
    with_bytes = places is not None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_wanted, places_wanted, apart = shared.value
        held, files, texts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, files, texts, size
            if held:
                file, rows = np.concatenate(files), np.concatenate(held)
                data = np.array(texts, object) if with_bytes else None
                held, files, texts, size = [], [], [], 0
                gone = beaten(file, rows["content"], rows["rank"])
                yield from packed_spans(rows["key"][gone], rows["start"][gone], rows["start"][gone] + rows["count"][gone].astype(np.int64) - 1 + LENGTH)
                rest = ~gone
                if with_bytes and len(apart):
                    away = np.flatnonzero(rest & np.isin((file >> np.uint64(32 - BUCKET_BITS)).view(np.int64), apart))
                    rest[away] = False
                    for a in range(0, len(away), 4_000):
                        part = away[a : a + 4_000]
                        yield batch_of([APART], rows["key"][part[:1]], [rows[part].tobytes()], [joined(data[part])])
                yield from by_bucket(file[rest], rows[rest], data[rest] if with_bytes else None)

        for b in slices(batches):
            data, offsets = flat_bytes(b["text"])
            file, start, count, doc = runs(data, offsets)
            keep = files_wanted.has(file)
            if places_wanted:
                keep[keep] = places_wanted.has(place_of(b["key"].to_numpy()[doc[keep]], (start - offsets[doc])[keep]))
            file, start, count, doc = file[keep], start[keep], count[keep], doc[keep]
            if not len(file):
                continue
            rank = pc.fill_null(b["doc_id"], LATE).to_numpy()[doc]
            content = Prefix(data).ranges(start, start + count - 1 + LENGTH) + count.astype(np.uint64)
            files.append(file)
            held.append(run_rows(file, content, rank, b["key"].to_numpy()[doc], start - offsets[doc], count))
            size += len(file)
            if with_bytes:
                raw = data.tobytes()
                texts += [raw[a : a + n - 1 + LENGTH] for a, n in zip(start.tolist(), count.tolist(), strict=True)]
            if size > (SENT_WITH_BYTES if with_bytes else SENT):
                yield from flush()
        yield from flush()

    return arrow_map(docs.select("doc_id", "key", "text"), job, PARTS)


def strings_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the rows of runs sent apart: the runs, their bytes, and for each string its run, its first byte and its hash."""
    for batch in batches:
        for keys, data in zip(batch["keys"], batch["data"], strict=True):
            rows, raw = np.frombuffer(keys.as_py(), RUN), np.frombuffer(data.as_py(), np.uint8)
            count = rows["count"].astype(np.int64)
            run = np.repeat(np.arange(len(rows)), count)
            at = np.arange(len(run)) + run * (LENGTH - 1)  # a run of n strings has n + LENGTH - 1 bytes
            yield rows, raw, run, at, Prefix(raw).grams(LENGTH)[at]


def string_keys(apart: DataFrame) -> DataFrame:
    """Packed hashes of the strings of runs that were sent apart."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = KeyPacker(most_alike=2)
        for *_, name in strings_apart(batches):
            yield from packer.add(name)
        yield from packer.flush()

    return arrow_map(apart.select("keys", "data"), job, "bucket int, keys binary")


def sent_strings(apart: DataFrame, wanted: KeyBitmap) -> DataFrame:
    """Strings of runs that were sent apart whose hash is wanted, as packed runs of one string filed under that hash.

    Of equal strings that a task holds at once those of the smallest document go on; the others are settled.
    """
    shared = apart.sparkSession.sparkContext.broadcast(wanted)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, texts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal names, held, texts, size
            if held:
                name, rows, data = np.concatenate(names), np.concatenate(held), np.concatenate(texts)
                names, held, texts, size = [], [], [], 0
                gone = beaten(name, name, rows["rank"])
                yield from packed_spans(rows["key"][gone], rows["start"][gone], rows["start"][gone] + LENGTH)
                yield from by_bucket(name[~gone], rows[~gone], data[~gone])

        for runs_, raw, run, at, name in strings_apart(batches):
            keep = shared.value.has(name)
            run, at, name = run[keep], at[keep], name[keep]
            step = at - (np.cumsum(runs_["count"].astype(np.int64) + LENGTH - 1) - runs_["count"] - LENGTH + 1)[run]
            names.append(name)
            held.append(run_rows(name, name, runs_["rank"][run], runs_["key"][run], runs_["start"][run] + step, 1))
            texts.append(raw[at[:, None] + np.arange(LENGTH)])
            size += len(name)
            if size > 2 * SENT_WITH_BYTES:
                yield from flush()
        yield from flush()

    return arrow_map(apart.select("keys", "data"), job, PARTS)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray] | pa.RecordBatch]:
    """Rows of settled spans and of runs that are sent apart as they are; then the runs and bytes of each bucket."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        settled = pc.less(batch["bucket"], 0)
        if settled.true_count:
            yield batch.filter(settled)
        rest = batch.filter(pc.invert(settled))
        for b, keys, data in zip(rest["bucket"].to_pylist(), rest["keys"].to_pylist(), rest["data"].to_pylist(), strict=True):
            held.setdefault(b, []).append((keys, data or b""))
    for b in sorted(held):
        parts = held.pop(b)
        yield b, np.frombuffer(b"".join(x for x, _ in parts), RUN), np.frombuffer(b"".join(y for _, y in parts), np.uint8)


def dealt(parts: DataFrame) -> DataFrame:
    """Buckets to their tasks; the other rows anywhere."""
    where = F.when(F.col("bucket") < 0, F.pmod("key", F.lit(1 << BUCKET_BITS))).otherwise(F.col("bucket"))
    return parts.repartition(bucket_tasks(parts), where)


def settle_equal_runs(sent: DataFrame) -> DataFrame:
    """Spans of runs that equal a whole run of a smaller document, and packed places of runs that are left to compare.

    Those are the runs of the smallest document of each content, under file keys with
    several contents.  Under a key with one content nothing else is to be found.  File keys
    with more than ``HEAVY`` contents are named in rows of their own.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, asked = [], KeyPacker(most_alike=1)
        for got in gathered(batches):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            b, rows, _ = got
            rows = rows[np.lexsort((rows["rank"], rows["content"], rows["file"]))]
            file = np.append(True, rows["file"][1:] != rows["file"][:-1])
            fresh = file | np.append(True, rows["content"][1:] != rows["content"][:-1])
            sizes = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
            found.append(rows[np.repeat(rows["rank"][fresh], sizes) < rows["rank"]])
            lowest = rows["rank"] == np.repeat(rows["rank"][fresh], sizes)
            contents = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(file))
            several = np.repeat(contents > 1, np.diff(np.append(np.flatnonzero(file), len(rows))))
            heavy = rows["file"][file][contents > HEAVY].astype(np.int64)
            if len(heavy):
                yield batch_of(np.full(len(heavy), APART), (b << 32) | heavy, [b""] * len(heavy))
            for packed in asked.add(place_of(rows["key"], rows["start"])[lowest & several]):
                yield batch_of(packed["bucket"], None, packed["keys"])
        for packed in asked.flush():
            yield batch_of(packed["bucket"], None, packed["keys"])
        if found:
            rows = np.concatenate(found)
            yield from packed_spans(rows["key"], rows["start"], rows["start"] + rows["count"].astype(np.int64) - 1 + LENGTH)

    return arrow_map(dealt(sent), job, PARTS)


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of all strings of ``length`` bytes (16 or more): equal numbers, equal strings.

    The first buckets are those of the 8-byte grams.  Each round sorts an offset on the
    pair of its own bucket and the bucket of a later offset, so that what one round found
    doubles what the next compares; the last round overlaps.
    """
    padded = np.append(data, np.zeros(length + 8, np.uint8))
    gram = np.zeros(len(data) + length, np.uint64)
    for j in range(8):
        gram = (gram << np.uint64(8)) | padded[j : len(gram) + j]
    bucket = np.unique(gram, return_inverse=True)[1].astype(np.uint64)
    known = 8
    while known < length:
        later = min(known, length - known)
        bucket = (bucket[: len(bucket) - later] << np.uint64(32)) | bucket[later:]
        bucket = np.unique(bucket, return_inverse=True)[1].astype(np.uint64)
        known += later
    return bucket


def refined(rows: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs sorted by file key with first bytes and bucket numbers of the strings, in parts of whole keys of about ``REFINED`` bytes."""
    sizes = rows["count"].astype(np.int64) + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(rows["file"], kind="stable")
    rows, begins, sizes = rows[order], begins[order], sizes[order]
    head = np.flatnonzero(np.append(True, rows["file"][1:] != rows["file"][:-1]))
    part = (np.cumsum(sizes) - sizes)[head] // REFINED
    cut = head[np.append(True, part[1:] != part[:-1])]
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
        own = np.cumsum(sizes[a:b]) - sizes[a:b]
        at = np.repeat(begins[a:b] - own, sizes[a:b]) + np.arange(int(sizes[a:b].sum()))
        yield rows[a:b], own, refine(data[at], LENGTH)


def settle_by_refinement(sent: DataFrame) -> DataFrame:
    """Spans of single strings that start in a smaller document, by the bytes of the runs."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def spans() -> Iterator[pa.RecordBatch]:
            if found:
                every = np.concatenate(found)
                found.clear()
                yield from packed_spans(every["key"], every["start"], every["start"] + LENGTH)

        for got in gathered(batches):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            for rows, begins, bucket in refined(got[1], got[2]):
                count = rows["count"].astype(np.int64)
                run = np.repeat(np.arange(len(rows)), count)
                step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
                name, rank = bucket[begins[run] + step].astype(np.int64), rows["rank"][run]
                least = np.full(int(name.max()) + 1, LATE)
                np.minimum.at(least, name, rank)
                gone = least[name] < rank
                own = np.zeros(int(gone.sum()), np.dtype([("key", "<i8"), ("start", "<i8")]))
                own["key"], own["start"] = rows["key"][run[gone]], rows["start"][run[gone]] + step[gone]
                found.append(own)
                if sum(map(len, found)) > SENT:
                    yield from spans()
        yield from spans()

    return arrow_map(dealt(sent), job, PARTS)


def with_key(docs: DataFrame) -> DataFrame:
    """Rows with equal doc_id and text share a key, and their result."""
    return docs.withColumn("__key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): byte spans to remove, as packed arrays in a list, of the documents that have any."""
    plain = with_key(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("key"), "text")
    repeated = key_bitmap(file_keys(plain), 2)
    first = store(settle_equal_runs(sent_runs(plain, repeated)), "equal-runs")
    heavy = np.array([r.key for r in first.where(F.col("bucket") == APART).select("key").collect()], np.int64)  # one for each HEAVY runs at most
    places = key_bitmap(first.where("bucket >= 0").select("bucket", "keys"), 1)
    found = [first, store(settle_by_refinement(sent_runs(plain, repeated, places, heavy)), "refined")]
    if len(heavy):
        apart = found[1].where(F.col("bucket") == APART)
        found.append(store(settle_by_refinement(sent_strings(apart, key_bitmap(string_keys(apart), 2))), "strings"))
    spans = reduce(DataFrame.union, [x.where(F.col("bucket") == SETTLED).select("key", "keys") for x in found])
    return store(spans.groupBy("key").agg(F.collect_list("keys").alias("spans")), "spans")


def cut_out(text: bytes, spans: list[bytes]) -> tuple[bytes, int, int]:
    """What remains of a text, the bytes removed and the number of maximal runs removed."""
    rows = np.sort(np.frombuffer(b"".join(spans), SPAN), order="start")
    kept, at, gone, number = [], 0, 0, 0
    end = -1
    for start, stop in rows.tolist():
        if start > end:
            number += 1
            kept.append(text[at:start])
            gone += stop - start
            end = stop
        elif stop > end:
            gone += stop - end
            end = stop
        at = end
    kept.append(text[at:])
    return b"".join(kept), gone, number


def dedup(docs: DataFrame, columns: list[str] | None = None, with_kept: bool = True) -> DataFrame:
    """``columns`` of every row (default: all but text) with n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that remain.

    A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a
    row with a smaller doc_id.  Strings are judged on the input.  A null text is empty; a
    null doc_id is larger than any other; rows of the same doc_id remove nothing from
    each other.  A column of ``docs`` named like a result is replaced.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("text", *results)]
    kinds = dict(zip(results, ("long", "long", "long", "string", "binary"), strict=False))
    fields = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns], *[f"{c} {t}" for c, t in kinds.items()]])

    def finished(b: pa.RecordBatch, spans: list[list[bytes] | None]) -> pa.RecordBatch:
        texts = [(x or "").encode() for x in b["text"].to_pylist()]
        cut = [cut_out(t, s) if s else (t, 0, 0) for t, s in zip(texts, spans, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*[b[c] for c in columns], pa.array(list(map(len, texts)), pa.int64()), pa.array([x[1] for x in cut], pa.int64()),
             pa.array([x[2] for x in cut], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in cut], pa.string()),
             *[pa.array([x[0] for x in cut], pa.binary())] * with_kept], [*columns, *results])

    return apply_spans(docs, columns, finished, fields)


def cut_texts(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with what ``dedup`` leaves of each text; a row of which nothing is left goes.

    Characters that lost some of their bytes are left out.  An untouched text, null too, stays as it is.
    """
    names = docs.columns

    def finished(b: pa.RecordBatch, spans: list[list[bytes] | None]) -> pa.RecordBatch:
        texts = [cut_out(t.encode(), s)[0].decode("utf-8", "ignore") if s else t for t, s in zip(b["text"].to_pylist(), spans, strict=True)]
        out = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b[c] for c in names], names)
        return out.filter(pa.array([bool(t) or not s for t, s in zip(texts, spans, strict=True)]))

    return apply_spans(docs, docs.columns, finished, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def apply_spans(docs: DataFrame, columns: list[str], finished, fields: str) -> DataFrame:
    """``finished`` for all rows and their spans; only rows that may have spans are shuffled."""
    spans = removed_spans(docs)
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(spans))
    needed = with_key(docs).select(*dict.fromkeys([*columns, "text", "__key"]))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pa.array(~bitmap.value.has(b["__key"].to_numpy().view(np.uint64))))
            yield finished(b, [None] * b.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(bitmap.value.has(b["__key"].to_numpy().view(np.uint64))))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield finished(b, b["__spans"].to_pylist())

    some = arrow_map(needed, touched, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema))
    some = some.join(spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")
    return arrow_map(needed, untouched, fields).union(arrow_map(some, applied, fields))
