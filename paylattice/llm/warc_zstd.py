"""WARC archives compressed with Zstandard: one frame per record behind a dictionary frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import arrow_map, store

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

#: A dictionary is learned from the first records of an archive, within these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2_000_000, 16_384
READ_BYTES = 16_384

MANIFEST = "path string, records long"
RECORD = ("archive string, record_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, "
          "payload_length long, payload binary, error string")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [VERSION.decode(), *[f"{k}: {re.sub(r'[\r\n]', '%0A', v)}" for k, v in fields if v is not None]]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record with its payload, or a revisit of ``refers_to`` with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = _header([("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id),
                    ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Profile", REVISIT_PROFILE if refers_to else None), ("WARC-Refers-To", refers_to),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
    return head + block + b"\r\n\r\n"


def learn_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the last bytes of the samples when they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


class ArchiveWriter:
    """Writes one archive after another; the name of each is new for every attempt of a task."""

    def __init__(self, folder: str, roll_bytes: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.roll, self.waiting, self.waiting_bytes, self.out = roll_bytes, [], 0, None
        self.done: list[tuple[str, int]] = []

    def add(self, data: bytes) -> None:
        if self.out:
            self._put(data)
            return
        self.waiting.append(data)
        self.waiting_bytes += len(data)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._open()

    def _open(self) -> None:
        dictionary = learn_dictionary(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        self.files.create_dir(self.folder, recursive=True)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.records = self.files.open_output_stream(self.path, compression=None), 0  # the frames are compressed already
        self.out.write(dictionary_frame(dictionary))
        waiting, self.waiting, self.waiting_bytes = self.waiting, [], 0
        for data in waiting:
            if not self.out:  # rolled over meanwhile
                self.add(data)
            else:
                self._put(data)

    def _put(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.records += 1
        if self.out.tell() >= self.roll:
            self._shut()

    def _shut(self) -> None:
        self.out.close()
        self.out = None
        self.done.append((self.path, self.records))

    def close(self) -> list[tuple[str, int]]:
        while self.waiting:
            self._open()
        if self.out:
            self._shut()
        return self.done


def frames(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """Decoded frames of an archive: the dictionary comes from the leading skippable frame, if there is one."""
    head = stream.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE_MAGIC:
        want = struct.unpack("<I", head[4:])[0]
        raw = stream.read(want)
        if len(raw) < want:
            raise ValueError("dictionary frame is cut short")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, head = zstandard.ZstdCompressionDict(raw), b""
    reader = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    rest = head
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("last frame is cut short")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of one record; raises ValueError where a header, a length or a digest is wrong."""
    head, gap, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(fields["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError("block length differs from content-length")
    http, gap, payload = body[:length].partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", http)
    if not gap or not http.startswith(b"HTTP/") or not said:
        raise ValueError("no HTTP head")
    full, kind = int(said[1]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without a target")
    return {"record_type": kind, "record_id": fields["warc-record-id"], "refers_to_id": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"), "payload_digest": digest, "payload_length": full,
            "payload": payload if kind == "response" else None, "error": None}


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 64_000_000) -> DataFrame:
    """Write ``(record_id, uri, payload binary, digest, refers_to)`` rows; returns the stored table of archives.

    Files go straight to the shared folder (a local or mounted path, or a store that
    pyarrow opens).  The table names the files of the attempts that ended well; what a
    lost attempt left is never read.  A null uri has no header line.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, roll_bytes)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b[c][i].as_py() for c in ("record_id", "uri", "payload", "digest", "refers_to")}
                writer.add(record(row["record_id"], row["uri"], row["payload"], row["digest"], row["refers_to"]))
        if done := writer.close():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records"])

    return store(arrow_map(rows.select("record_id", "uri", "payload", "digest", "refers_to"), job, MANIFEST), "warc-manifest")


def read_archives(paths: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives in column ``path``, read as streams; one task reads whole archives.

    Every frame is one record.  A wrong record becomes a row with ``error`` and null
    fields; a broken frame gives one such row and ends its archive.  ``with_payload``
    off leaves the payload out after its digest was checked.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        files = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for b in batches:
            for path in b["path"].to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    try:
                        for data in frames(stream):
                            try:
                                row = parse(data)
                            except ValueError as e:
                                row = {"error": str(e)}
                            if not with_payload:
                                row["payload"] = None
                            rows.append(row | {"archive": path})
                            held += len(row.get("payload") or b"") + 500
                            if held >= 4_000_000:
                                yield batch(rows)
                                rows, held = [], 0
                    except (ValueError, zstandard.ZstdError) as e:
                        rows.append({"archive": path, "error": str(e)})
                if rows:
                    yield batch(rows)

    return arrow_map(paths.select("path"), job, RECORD)


def plan_records(pages: DataFrame) -> DataFrame:
    """``(record_id, uri, payload, digest, refers_to)`` of pages: of equal payloads the smallest page_id is the response.

    A null html is an empty payload.  A null page_id counts as larger than any other;
    where all ids of a payload are null, all its records are responses.  Rows that
    repeat the smallest id are responses, too.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "sha1").select(
        name(F.col("page_id")).alias("record_id"), "uri", "payload", F.col("sha1"),
        F.when(again, name(F.col("first_id"))).alias("refers_to"))


def page_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back and report each page's record."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    plan = plan_records(pages)
    written = write_archives(plan.withColumn("digest", base32(F.unhex("sha1"))), folder)
    # archives are dealt out one by one, as each is far larger than its row
    paths = written.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    found = read_archives(paths, folder, with_payload=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast(T.LongType())
    return found.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
                        "record_type", page("refers_to_id").alias("refers_to"), "error")


def base32(raw):
    """Base32 text of 20 bytes, from their bits in groups of five."""
    hexed = F.hex(raw)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for i in range(4):  # ten hex digits are 40 bits, eight letters
        bits = F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0")
        groups.append(bits)
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", letters)
