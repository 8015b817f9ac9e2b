"""Byte-level BPE by tiktoken with a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import arrow_map, slices

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 100_000
#: White-space runs from this length on are encoded without the pattern, which fails on very long ones.
LONG_RUN = 10_000
# --- fixed values: white space as the pattern means it, and some letters and marks of other scripts ---
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\u0410-\\u044f\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fff\\uac00-\\ud7a3"
_MARK = "!-&(-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f"
_SAFE = re.compile(f"[^{_SPACE}](?=[{_SPACE}])|[{_LETTER}](?=[{_MARK}])")
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def id_texts(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text before white space, or between a letter and a mark other than the apostrophe.

    The pattern lets no match run into white space or from a letter into a mark, and looks
    ahead from white space only, so the matches of the pieces are those of the text.  A
    text without such a place stays whole.
    """
    start = 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + most)
        if not found:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a whole text; null is empty."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        # the pattern matches all of a run but the last character before other text as one piece
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in pieces(text[at : run.start()]):
            ids += enc.encode_ordinary(piece)
        ids += encode_run(enc, text[run.start() : end])
        at = end
    for piece in pieces(text[at:] if at else text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_run(enc: tiktoken.Encoding, run: str) -> list[int]:
    """Ids of one match of the pattern."""
    return enc._encode_single_piece(run)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` for every row; ids is empty for null or empty text."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in slices(batches, text):
            ids = [encode_text(enc, t) for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return arrow_map(df.select(key, text), job, schema)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, raw)``: the raw bytes of the ids, never repaired to valid text; null ids give empty bytes."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, raw binary"

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            raw = [enc.decode_bytes(x or []) for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(raw, pa.binary())], [key, "raw"])

    return arrow_map(df.select(key, ids), job, schema)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded and decoded in one pass, without moving the ids.

    A null or empty text has no ids, and digests of nothing; a null doc_id stays null; rows
    that repeat come out as often.  Texts of any length are encoded whole.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        name = id_texts(enc.n_vocab).__getitem__
        for b in slices(batches):
            counts, encoded, decoded = [], [], []
            for t in b["text"].to_pylist():
                ids = encode_text(enc, t)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(df.select("doc_id", "text"), job, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
