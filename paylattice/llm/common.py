"""Shared pieces: scratch tables, byte hashing in numpy, bounded key bitmaps, connected components."""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

ROOT = str(Path(__file__).resolve().parent.parent.parent)

#: Bytes of text handled at once in a task.
SLICE_BYTES = 500_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- text as bytes


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of text; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets; null counts as empty."""
    column = pa.concat_arrays([pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")]).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_RATIO = np.uint64(0x9E3779B97F4A7C17 | 3)
_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))
BYTE_VALUE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, ratio in (("up", _RATIO), ("down", _INVERSE)):
            steps = np.full(n, ratio, np.uint64)
            steps[:1] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Ranges above this length are hashed by their bytes: running sums modulo 2^64 give some long texts of two letters the same value.
SUMMED = 96


class Prefix:
    """64-bit hash of any byte range of one array, from running sums; of long ranges, from their bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = _powers(max(len(data) + 1, SLICE_BYTES))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sums[end] - self.sums[start]) * self.down[start])
        for i in np.flatnonzero(end - start > SUMMED).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def grams(self, q: int) -> np.ndarray:
        """Hash of the q bytes that start at each offset."""
        n = max(len(self.sums) - q, 0)
        return mix((self.sums[q:] - self.sums[:n]) * self.down[:n]) if n else np.zeros(0, np.uint64)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ``apart`` bytes, and each document's first word (n + 1 entries)."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


_WEIGHT = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one document; with fewer words, the whole sequence as one."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * _WEIGHT[j]
    return mix(total + np.uint64(width))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


# ------------------------------------------------- keys met more than once, in bounded memory

#: Bits of a key bitmap: 16 MB, whatever the input.
BITMAP_BITS = 27
#: Bits of a key that choose its bucket.
BUCKET_BITS = 12
#: Bits of a key that choose the slot in which its frequency class is kept: 16 MB of two-bit classes.
CLASS_BITS = 26
#: Least counts of the classes above the first.
CLASSES = (8, 64, 512)
PACKED = "bucket int, keys binary"


def pack_keys(keys: np.ndarray, rows: dict[int, list[bytes]]) -> None:
    """Add sorted distinct 64-bit keys to the buckets of their leading bits."""
    bounds = np.searchsorted(keys >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(bounds)):
        # the bits behind those of the bucket: 44 bits name a key, which is plenty for a filter
        own = (keys[bounds[b] : bounds[b + 1]] << np.uint64(BUCKET_BITS)) >> np.uint64(32)
        rows.setdefault(int(b), []).append(own.astype("<u4").tobytes())


def packed_batches(rows: dict[int, list[bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(list(rows), pa.int32()),
                                       "keys": pa.array([b"".join(x) for x in rows.values()], pa.binary())})


class KeyPacker:
    """Collects keys of many documents and gives packed rows once enough are there.

    More than ``most_alike`` equal keys are not worth sending, as nobody counts further.
    """

    def __init__(self, most_alike: int, most: int = 1_000_000):
        self.parts: list[np.ndarray] = []
        self.held, self.most, self.most_alike = 0, most, most_alike

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.held += len(keys)
        if self.held >= self.most:
            yield from self.flush()

    def pack(self, keys: np.ndarray, rows: dict[int, list[bytes]]) -> None:
        pack_keys(keys, rows)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows: dict[int, list[bytes]] = {}
            keys = np.sort(np.concatenate(self.parts))
            if len(keys) > self.most_alike:
                keys = keys[np.append(np.ones(self.most_alike, bool), keys[self.most_alike :] != keys[: -self.most_alike])]
            self.pack(keys, rows)
            yield packed_batches(rows)
        self.parts, self.held = [], 0


class KeyBitmap:
    """Which keys come often, by two bits for each; with the numbers of all and of distinct keys.

    The first bit is that of the leading ``BITMAP_BITS``, the second lies in the same
    bucket and is named by the bits behind them.
    """

    def __init__(self, bits: np.ndarray, second: np.ndarray | None = None, total: int = 0, different: int = 0,
                 classes: np.ndarray | None = None):
        self.bits, self.second, self.total, self.different, self.classes = bits, second, total, different, classes

    def __getstate__(self) -> dict:
        """Packed, as most bits are mostly unset and every executor keeps a copy on disk."""
        pack = zstandard.ZstdCompressor(level=1).compress
        return self.__dict__ | {k: None if getattr(self, k) is None else pack(getattr(self, k).tobytes()) for k in ("bits", "second", "classes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {k: None if state[k] is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(state[k]), np.uint8)
                                 for k in ("bits", "second", "classes")}

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Frequency class of each key, 0 to 3; that of a more frequent key of the same slot at times, and always the same."""
        at = (keys >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        return (self.classes[at >> 2] >> ((at & 3) * 2).astype(np.uint8)) & 3

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        found = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        if self.second is not None and found.any():
            keys, at, low = keys[found], at[found], BITMAP_BITS - BUCKET_BITS
            other = (keys >> np.uint64(64 - BITMAP_BITS - low)).astype(np.int64) & ((1 << low) - 1)
            at = (at >> low << low) | other
            found[found] = (self.second[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found


#: Bytes of a bucket in either half of a key bitmap.
PART = 1 << (BITMAP_BITS - BUCKET_BITS - 3)


def bits_of(keys: np.ndarray) -> bytes:
    """A bucket's part of both halves of a key bitmap, from its packed keys."""
    low = BITMAP_BITS - BUCKET_BITS
    bits = np.zeros((2, PART * 8), bool)
    bits[0, keys >> np.uint32(32 - low)] = True
    bits[1, (keys >> np.uint32(32 - 2 * low)) & np.uint32((1 << low) - 1)] = True
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def key_bitmap(packed: DataFrame, least: int = 2, classes: bool = False) -> KeyBitmap:
    """Bitmap of the keys that come ``least`` times or more; with ``classes``, also how often, by ``CLASSES``.

    ``packed`` has the rows of ``KeyPacker``.  The result has a fixed size (twice 16 MB, and
    16 MB for classes); bits may also be set for another key, so it serves as a filter or
    as a rank in an order, never as a decision.
    """
    slots = 1 << (CLASS_BITS - BUCKET_BITS)

    def class_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
        level = np.searchsorted(CLASSES, counts, "right").astype(np.uint8)
        held = np.zeros(slots, np.uint8)
        np.maximum.at(held, keys >> np.uint32(32 - (CLASS_BITS - BUCKET_BITS)), level)
        held = held.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
        return (held[:, 0] | held[:, 1] | held[:, 2] | held[:, 3]).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, keys in zip(batch["bucket"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                held.setdefault(b, []).append(np.frombuffer(keys, "<u4"))
        rows, squeeze = [], zstandard.ZstdCompressor(level=1).compress
        for b in sorted(held):
            keys = np.sort(np.concatenate(held.pop(b)))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.diff(np.append(first, len(keys)))
            often = keys[first[counts >= least]]
            rows.append((b, squeeze(bits_of(often)), len(keys), len(first),
                         squeeze(class_bytes(keys[first], counts)) if classes else None))
        if rows:
            b, bits, total, different, level = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(bits), pa.array(total), pa.array(different), pa.array(level, pa.binary())],
                                             ["bucket", "keys", "total", "different", "level"])

    counted = arrow_map(packed.repartition(bucket_tasks(packed), "bucket"), count, PACKED + ", total long, different long, level binary")
    bits, total, different = np.zeros((2, PART << BUCKET_BITS), np.uint8), 0, 0
    levels = np.zeros(1 << (CLASS_BITS - 2), np.uint8) if classes else None
    unpack = zstandard.ZstdDecompressor().decompress
    for row in counted.collect():  # at most 12 KB for each of 4,096 buckets, compressed
        if classes:
            levels[row.bucket * slots // 4 : (row.bucket + 1) * slots // 4] = np.frombuffer(unpack(row.level), np.uint8)
        bits[:, row.bucket * PART : (row.bucket + 1) * PART] = np.frombuffer(unpack(row["keys"]), np.uint8).reshape(2, PART)
        total, different = total + row.total, different + row.different
    return KeyBitmap(bits[0], bits[1], total, different, levels)


class MarkPacker(KeyPacker):
    """Packs keys with a byte for each that says whose key it is; four bytes of every key of a row come first, then these bytes.

    ``add`` takes the leading 56 bits of the keys above the mark.  Two equal ones are enough to count.
    """

    def __init__(self, most: int = 1_000_000):
        super().__init__(2, most)

    @staticmethod
    def marked(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Another mark for each key of an owner, so that two owners with several keys in common differ in some."""
        return (keys & ~np.uint64(255)) | (mix(keys + mix(owners)) >> np.uint64(56))

    def pack(self, keys: np.ndarray, rows: dict[int, list[bytes]]) -> None:
        bounds = np.searchsorted(keys >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
        own, marks = ((keys << np.uint64(BUCKET_BITS)) >> np.uint64(32)).astype("<u4"), keys.astype(np.uint8)
        for b in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[b], bounds[b + 1]
            rows.setdefault(int(b), []).append(own[lo:hi].tobytes() + marks[lo:hi].tobytes())


def mark_bitmaps(packed: DataFrame) -> tuple[KeyBitmap, KeyBitmap]:
    """From the rows of ``MarkPacker``: keys that come twice or more, and keys of more than one owner.  Filters, as in ``key_bitmap``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, keys in zip(batch["bucket"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                n = len(keys) // 5
                held.setdefault(b, []).append(np.frombuffer(keys, "<u4", n).astype(np.uint64) << np.uint64(8) | np.frombuffer(keys, np.uint8, n, 4 * n))
        rows, squeeze = [], zstandard.ZstdCompressor(level=1).compress
        for b in sorted(held):
            marked = np.sort(np.concatenate(held.pop(b)))
            keys = (marked >> np.uint64(8)).astype(np.uint32)
            same = keys[1:] == keys[:-1]
            rows.append((b, squeeze(bits_of(keys[1:][same])), squeeze(bits_of(keys[1:][same & (marked[1:] != marked[:-1])]))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                             ["bucket", "often", "shared"])

    counted = arrow_map(packed.repartition(bucket_tasks(packed), "bucket"), count, "bucket int, often binary, shared binary")
    bits, unpack = np.zeros((2, 2, PART << BUCKET_BITS), np.uint8), zstandard.ZstdDecompressor().decompress
    for row in counted.collect():  # at most 16 KB for each of 4,096 buckets, compressed
        for one, held in zip(bits, (row.often, row.shared), strict=True):
            one[:, row.bucket * PART : (row.bucket + 1) * PART] = np.frombuffer(unpack(held), np.uint8).reshape(2, PART)
    return KeyBitmap(*bits[0]), KeyBitmap(*bits[1])


def bucket_tasks(df: DataFrame) -> int:
    return min(1 << BUCKET_BITS, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32))


def id_bitmap(keys: DataFrame) -> KeyBitmap:
    """Bitmap of the 64-bit hashes in the column ``key``: a filter of fixed size for a scan."""
    place = F.shiftrightunsigned(F.col("key"), 64 - BITMAP_BITS)
    rows = (keys.select(F.shiftright(place, 15).alias("b"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")))
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in rows.collect():  # 4 KB for each of 4,096 parts
        bits[row.b * 4096 : (row.b + 1) * 4096] = np.frombuffer(row.m, np.uint8)
    return KeyBitmap(bits)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node reachable.

    Rounds of large-star and small-star; each round is written to the scratch folder.
    Both stars group with map-side minimum and equality joins, so a node with very many
    links never meets in one task.
    """
    pairs = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every neighbour above a node links to the smallest node near that node
        large = (both.where("b > a").join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = store(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                                 F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.*").where("a <> b").distinct())
        small = store(small, "small-star")
        same = small.count() == pairs.count() and small.join(pairs, ["a", "b"], "left_anti").isEmpty()
        discard(pairs, large)
        pairs = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def give_back() -> None:
    """Unused memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def arrow_map(df: DataFrame, job: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``; a worker gives back what it no longer uses when its task ends, as idle ones stay beside the next."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from job(batches)
        finally:
            give_back()

    prepare(df.sparkSession)
    return df.mapInArrow(tidy, schema)
