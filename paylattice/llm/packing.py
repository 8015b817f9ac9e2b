"""Packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import LOWER, SPACE, Prefix, arrow_map, flat_bytes, mix, slices, words

#: Slots for remembered pieces of words, and token ids and bytes they may hold together.
SLOTS, POOL, RAW = 1 << 21, 8_000_000, 24_000_000
#: Documents, and tokens of documents, whose remainders are packed together at most.
WINDOW, WINDOW_TOKENS = 8192, 8_000_000

APART, LETTER_KIND, SYMBOL_KIND = 0, 1, 2
KIND = np.full(256, LETTER_KIND, np.uint8)
KIND[33:127] = SYMBOL_KIND
KIND[[*range(65, 91), *range(97, 123)]] = LETTER_KIND
KIND[SPACE] = APART
# Bytes after which nothing is assumed: apostrophes start contractions, others are rare.
GLUE = np.zeros(256, bool)
GLUE[[*range(9), *range(14, 32), 39, 127]] = True
_NEVER = "\x01"


def byte_letters() -> dict[int, int]:
    """How byte-level models write a byte: itself if printable, else the next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of words that the tokenizer never joins: folded bytes, starts, ends, and whether letters only.

    Words end at ASCII white space.  A word of ASCII and the letters U+00C0-U+00FF, without
    apostrophes, is also cut between letters and symbols, and lower-cased (the tokenizer
    does so, too).  In any other word composing characters or contractions may matter;
    it stays whole and as it is.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none.astype(bool)
    start, end, _ = words(data, offsets)
    before = np.append(np.uint8(32), data[:-1])
    follows = (before == 0xC3) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    leads = np.append(follows[1:], False)
    odd = GLUE[data] | ((data >= 0x80) & ~follows & ~leads)
    total = np.append(0, np.cumsum(odd))
    strange = total[end] > total[start]
    kind = KIND[data]
    low = LOWER[data]
    low[follows & (data < 0x9F)] += 0x20
    if strange.any():
        turn = np.zeros(len(data) + 1, np.int8)
        turn[start[strange]] = 1
        np.subtract.at(turn, end[strange], 1)
        inside = np.cumsum(turn[:-1], dtype=np.int8) > 0
        kind[inside] = LETTER_KIND
        low[inside] = data[inside]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turn = np.append(True, kind[1:] != kind[:-1]) | edge[:-1]
    begins = np.flatnonzero(turn)
    ends = np.append(begins[1:], len(data))
    full = kind[begins] != APART
    begins, ends = begins[full], ends[full]
    letters = (kind[begins] == LETTER_KIND) & (total[ends] == total[begins])
    return low, begins, ends, letters


def same_bytes(left: np.ndarray, at: np.ndarray, right: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes[i]`` (1 or more) bytes of ``left`` from ``at[i]`` equal those of ``right`` from ``other[i]``."""
    out = np.zeros(len(sizes), bool)
    ends = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < len(sizes):  # about a million bytes at once
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 1_000_000)))
        n = sizes[a:b].astype(np.int32)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum()), dtype=np.int32)
        same = left[np.repeat((at[a:b] - first).astype(np.int32), n) + step] == right[np.repeat((other[a:b] - first).astype(np.int32), n) + step]
        out[a:b] = np.logical_and.reduceat(same, first)
        a = b
    return out


class PieceIds:
    """Token ids of pieces, remembered in a table of fixed size; found by a 64-bit hash, accepted by their bytes.

    A new piece takes the slot of an older one; when the pool of ids or bytes is full, all are
    forgotten.  So memory is bounded and a forgotten piece is only encoded again.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.letters = tokenizer, byte_letters()
        (self.mark,) = tokenizer.encode(_NEVER, add_special_tokens=False).ids
        self.pool, self.raw = np.zeros(POOL, np.uint32), np.zeros(RAW, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.raw_at, self.raw_size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.used = self.raw_used = 0

    def encode(self, pieces: list[bytes], letters: list[bool]) -> list[list[int]]:
        """Letters go straight to the merges; other pieces through the whole tokenizer, many in one text."""
        merge = self.tokenizer.model.tokenize
        out: list = [None] * len(pieces)
        rest = []
        for k, (piece, plain) in enumerate(zip(pieces, letters, strict=True)):
            if plain:
                out[k] = [t.id for t in merge(piece.decode("latin-1").translate(self.letters))]
            elif b"\x01" in piece:
                out[k] = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
            else:
                rest.append(k)
        for j in range(0, len(rest), 2048):
            some = rest[j : j + 2048]
            line = "".join([f"{pieces[k].decode()} {_NEVER} " for k in some])
            ids = self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids
            row: list[int] = []
            ended = iter(some)
            for i in ids:
                if i == self.mark:
                    out[next(ended)] = row
                    row = []
                else:
                    row.append(i)
            if next(ended, None) is not None or row:
                raise ValueError("marks and pieces differ")
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[np.ndarray]:
        """Ids of whole texts, each followed by ``end_id``."""
        low, start, end, letters = piece_spans(data, offsets)
        if not len(start):
            return [np.array([end_id], np.uint32)] * (len(offsets) - 1)
        keys = mix(Prefix(low).ranges(start, end) + (end - start).astype(np.uint64) * np.uint64(2) + letters) | np.uint64(1)
        slot = (keys >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        length = end - start
        met = np.flatnonzero((self.keys[slot] == keys) & (self.raw_size[slot] == length))
        met = met[same_bytes(low, start[met], self.raw, self.raw_at[slot[met]], length[met])]
        unknown = np.ones(len(keys), bool)
        unknown[met] = False
        missing = np.flatnonzero(unknown)
        pool = self.pool
        if len(missing):
            new, first, same = np.unique(keys[missing], return_index=True, return_inverse=True)
            first = missing[first]
            raw = low.tobytes()
            stand = first[same]  # the piece that stands for each missing one; one of other bytes stands for itself
            alike = length[stand] == length[missing]
            alike[alike] = same_bytes(low, start[missing[alike]], low, start[stand[alike]], length[missing[alike]])
            if not alike.all():
                own = missing[~alike]
                same[~alike] = len(first) + np.arange(len(own))
                first = np.append(first, own)
                new = np.append(new, np.zeros(len(own), np.uint64))  # not remembered
            got = self.encode([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], letters[first].tolist())
            sizes = np.array([len(x) for x in got], np.int32)
            flat = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
            bytes_of = length[first]
            if self.used + len(flat) > POOL or self.raw_used + int(bytes_of.sum()) > RAW:  # what this slice found is in `pool`, what it learns fits anew or not at all
                pool = np.concatenate([self.pool[: self.used], flat])
                places = self.used + np.append(0, np.cumsum(sizes)[:-1])
                self.pool = np.zeros(POOL, np.uint32)
                self.raw = np.zeros(RAW, np.uint8)
                self.forget()
            else:
                places = self.used + np.append(0, np.cumsum(sizes)[:-1])
                pool[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
                held = self.raw_used + np.append(0, np.cumsum(bytes_of)[:-1])
                for a, b, p in zip(start[first].tolist(), end[first].tolist(), held.tolist(), strict=True):
                    self.raw[p : p + b - a] = low[a:b]
                self.raw_used += int(bytes_of.sum())
                keep = np.flatnonzero(new)
                where = (new[keep] >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)
                self.keys[where], self.at[where], self.size[where] = new[keep], places[keep], sizes[keep]
                self.raw_at[where], self.raw_size[where] = held[keep], bytes_of[keep]
            at[missing], size[missing] = places[same], sizes[same]
        stops = np.cumsum(size, dtype=np.int64)
        ids = pool[np.repeat(at - (stops - size), size) + np.arange(stops[-1])]
        bounds = np.append(0, stops)[np.searchsorted(start, offsets)]
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return PieceIds(tokenizer)


class Packer:
    """Bin packing of one task's examples in windows.

    An example is a vector (tokens, one segment, loss-bearing tokens).  Full sequences
    of a long example are cut off first.  For the rest, one sequence is filled at a
    time: of all examples that fit, the one whose vector has the largest dot product
    with what is left of the limits is placed next.  When none fits, the example that
    exceeds the room least is cut, if segments and loss allow.  Examples with equal
    vectors are one class, so a choice looks at classes only.
    """

    def __init__(self, tokens: int, segments: int, loss: int, first: int):
        self.tokens, self.segments, self.loss, self.next_id = tokens, segments, loss, first
        self.pieces: list[tuple[int, int, int, int, int]] = []  # example, start, length, sequence, offset

    def sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def pack(self, lengths: list[int], losses: list[int]) -> None:
        """``losses``: how many of an example's last tokens bear loss."""
        self.lengths, self.losses = lengths, losses
        self.where: dict[tuple[int, int], int] = {}
        self.members: list[list[tuple[int, int]]] = []
        self.n, self.bear, self.count = (np.zeros(64, np.int64) for _ in range(3))
        self.waiting = 0
        for i, n in enumerate(lengths):
            start = 0
            while n - start >= self.tokens and min(losses[i], n - start) - max(0, n - start - self.tokens) <= self.loss:
                self.pieces.append((i, start, self.tokens, self.sequence(), 0))
                start += self.tokens
            self._add(i, start)
        while self.waiting:
            self._fill()

    def _add(self, i: int, start: int) -> None:
        n = self.lengths[i] - start
        if n <= 0:
            return
        key = n, min(n, self.losses[i])
        k = self.where.get(key)
        if k is None:
            k = self.where[key] = len(self.members)
            self.members.append([])
            if k == len(self.n):
                self.n, self.bear, self.count = (np.append(x, np.zeros(k, np.int64)) for x in (self.n, self.bear, self.count))
            self.n[k], self.bear[k] = key
        self.members[k].append((i, start))
        self.count[k] += 1
        self.waiting += 1

    def _take(self, k: int) -> tuple[int, int]:
        self.count[k] -= 1
        self.waiting -= 1
        return self.members[k].pop()

    def _fill(self) -> None:
        room, segments, loss, at, placed = self.tokens, self.segments, self.loss, 0, []
        while room and segments and self.waiting:
            k = len(self.members)
            n, bear, there = self.n[:k], self.bear[:k], self.count[:k] > 0
            fits = there & (n <= room) & (bear <= loss)
            # the segment's share of the dot product is the same for all
            gain = np.where(fits, n * (room / self.tokens**2) + bear * (loss / max(self.loss, 1) ** 2), -1.0)
            best = int(gain.argmax())
            if fits[best]:
                take = int(n[best])
                bearing = int(bear[best])
                i, start = self._take(best)
            else:
                over = np.where(there & (n > room), n, np.iinfo(np.int64).max)
                best = int(over.argmin())
                silent = int(n[best] - bear[best])  # loss-bearing tokens lie at the end
                take = min(room, silent + loss)
                if over[best] == np.iinfo(np.int64).max or take <= 0:
                    break
                bearing = max(0, take - silent)
                i, start = self._take(best)
                self._add(i, start + take)
            placed.append((i, start, take, at))
            at, room, segments, loss = at + take, room - take, segments - 1, loss - bearing
        if not placed:  # every example left is beyond the limit on loss alone: a sequence for a part of one
            i, start = self._take(int(np.flatnonzero(self.count)[0]))
            rest = self.lengths[i] - start
            take = max(1, min(rest, self.tokens, rest - min(rest, self.losses[i]) + self.loss))
            self.pieces.append((i, start, take, self.sequence(), 0))
            self._add(i, start + take)
        elif at == self.tokens:
            number = self.sequence()
            self.pieces += [(i, start, n, number, offset) for i, start, n, offset in placed]
        else:
            self._powers_of_two(placed)

    def _powers_of_two(self, placed: list[tuple[int, int, int, int]]) -> None:
        """Cut a sequence that stays short into sequences whose lengths are powers of two: no padding."""
        total, queue = sum(x[2] for x in placed), list(placed)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            number, at = self.sequence(), 0
            while at < 1 << bit:
                i, start, n, _ = queue.pop(0)
                take = min(n, (1 << bit) - at)
                self.pieces.append((i, start, take, number, at))
                at += take
                if take < n:
                    queue.insert(0, (i, start + take, n - take, 0))


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, segments: int = 256, loss: int | None = None,
                   end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, placed in sequences; ``with_ids`` adds the ids of a piece.

    Every text, null or empty ones too, ends with ``end_id``.  Each task packs its own
    documents in windows, so nothing is shuffled; a task leaves at most a handful of
    sequences that are not full, and those have lengths that are powers of two.  All
    tokens of a document bear loss.  A sequence's id holds the task's number, so that a
    repeated task gives the same rows.
    """
    loss = tokens if loss is None else loss

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_ids(path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 36
        held, names, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, names
            packer = Packer(tokens, segments, loss, number)
            sizes = [len(x) for x in held]
            packer.pack(sizes, sizes)
            number = packer.next_id
            rows = [(names[i], s, n, zlib.crc32(held[i][s : s + n].tobytes()), sizes[i], q, o) for i, s, n, q, o in packer.pieces]
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            columns = [x.split()[0] for x in OUT.split(", ")]
            if with_ids:
                arrays.append(pa.array([held[i][s : s + n].astype(np.int32) for i, s, n, _, _ in packer.pieces], pa.list_(pa.int32())))
                columns.append("ids")
            held, names = [], []
            return pa.RecordBatch.from_arrays(arrays, columns)

        for b in slices(batches):
            held += known.texts(*flat_bytes(b["text"]), end_id)
            names += b["doc_id"].to_pylist()
            waiting += sum(len(x) for x in held[len(held) - b.num_rows :])
            if len(held) >= WINDOW or waiting >= WINDOW_TOKENS:
                yield flush()
                waiting = 0
        if held:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), job, OUT + (", ids array<int>" if with_ids else ""))
