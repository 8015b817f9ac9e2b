"""Vectors as product codes: exact k-means codebooks with norm-of-sum bounds that save rescans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, store

#: Integer components beyond this are cut to it, so that squared distances and their sums stay whole in 64 bits.
LARGEST = 1 << 26
#: Groups of codebook entries that share one bound.
GROUPS = 16
#: Vectors handled at once in a task.
ROWS = 2_000
#: Bounds are lowered by this share, far above the error of the floating-point roots.
SLACK = 1e-6
STATE = "id long, label string, v binary, code binary, bound binary, stamp binary"


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to entries, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 2**53:  # every sum is a whole number a double holds
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


@dataclass
class Codebooks:
    """All codebooks so far, by round, as (parts, entries, part width), and the groups of entries.

    ``moved(part, r)`` is how far each group has come since round r: the greatest true distance
    between an entry of the group then and now.  It is at most the sum of the
    entry's moves in between, so a bound kept from round r loses less by it.
    """

    history: list[np.ndarray]
    group: np.ndarray = field(init=False)  # (parts, entries)

    def __post_init__(self) -> None:
        self.group = np.stack([groups_of(part) for part in self.history[0]])

    @property
    def now(self) -> int:
        return len(self.history) - 1

    def moved(self, part: int) -> np.ndarray:
        """(round, group): greatest net displacement since that round."""
        out = np.zeros((len(self.history), GROUPS))
        for r, old in enumerate(self.history):
            step = np.sqrt(((self.history[-1][part] - old[part]).astype(float) ** 2).sum(axis=1))
            np.maximum.at(out[r], self.group[part], step)
        return out


def groups_of(entries: np.ndarray) -> np.ndarray:
    """Group number of each entry: a few rounds of k-means on the entries, from evenly spaced ones."""
    x = entries.astype(float)
    centres = x[np.linspace(0, len(x) - 1, GROUPS).astype(int)]
    for _ in range(5):
        near = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(GROUPS):
            if (near == g).any():
                centres[g] = x[near == g].mean(axis=0)
    return near


def rescan(x: np.ndarray, entries: np.ndarray, members: np.ndarray, code: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest entry of a group for some rows, against the best known one; and the nearest other than the one assigned.

    Returns (code, squared distance, bound); ties go to the lower entry.
    """
    d = squared(x, entries[members])
    first = d.argmin(axis=1)  # members ascend, so the first of equals is the lowest
    near, at = d[np.arange(len(x)), first], members[first]
    better = (near < best) | ((near == best) & (at < code))
    code, best = np.where(better, at, code), np.where(better, near, best)
    others = np.where(members[None, :] == code[:, None], np.iinfo(np.int64).max, d).min(axis=1, initial=np.iinfo(np.int64).max)
    return code, best, np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others.astype(float)) * (1 - SLACK))


def assign(x: np.ndarray, books: Codebooks, part: int, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest entry of the newest codebook for each row, exactly; updates ``code``, ``bound`` and ``stamp`` in place.

    ``bound`` holds for each row and group of entries a least distance to the group's
    entries other than the assigned one, as of round ``stamp``.  Only groups whose bound, less
    the group's net displacement since then, does not exceed the distance to the
    assigned entry are scanned again.  Returns squared distances and how many distances were computed.
    """
    entries, group, now = books.history[-1][part], books.group[part], books.now
    moved = books.moved(part)
    best = ((x - entries[code]) ** 2).sum(axis=1)
    valid = bound - moved[stamp, np.arange(GROUPS)] * (1 + SLACK)
    computed = len(x)
    begun, begun_at = code.copy(), best.copy()
    for g in range(GROUPS):
        members = np.flatnonzero(group == g)
        if not len(members):
            continue
        open_rows = np.flatnonzero(valid[:, g] <= np.sqrt(best.astype(float)) * (1 + SLACK))
        if not len(open_rows):
            continue
        computed += len(open_rows) * len(members)
        before = code[open_rows]
        new, near, other = rescan(x[open_rows], entries, members, before, best[open_rows])
        bound[open_rows, g], stamp[open_rows, g] = other, now
        code[open_rows], best[open_rows] = new, near
        # an entry that is no longer the assigned one belongs to its group's bound again
        left = np.flatnonzero((new != before) & (group[before] != g))
        if len(left):
            rows, old = open_rows[left], group[before[left]]
            at = np.sqrt(((x[rows] - entries[before[left]]) ** 2).sum(axis=1).astype(float)) * (1 - SLACK)
            carried = bound[rows, old] - moved[stamp[rows, old], old] * (1 + SLACK)
            bound[rows, old], stamp[rows, old] = np.minimum(carried, at), now
    return best, computed


def integers(rows: list[list[float]], width: int) -> np.ndarray:
    """floor(1024 * x), cut at ``LARGEST``; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return np.floor(np.clip(out, -LARGEST / 1024, LARGEST / 1024) * 1024).astype(np.int64)


@dataclass
class Codec:
    """Result of ``compress``: the coded rows, their codebooks, and the distances each round computed."""

    coded: DataFrame  # (id, label, code, error): code has a byte for each part
    codebooks: np.ndarray  # (parts, entries, part width)
    distances: list[int]

    def digest(self) -> str:
        """SHA-256 of all entries' components as decimals, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def decode(codes: list[bytes], codebooks: np.ndarray) -> np.ndarray:
    """Integer vectors that codes stand for."""
    n = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(codebooks))
    return np.concatenate([codebooks[p][n[:, p]] for p in range(len(codebooks))], axis=1)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
             rounds: int = 4) -> Codec | None:
    """Product codes of all usable vectors; None without any.

    Components become floor(1024 * x), cut at 2^26 in either direction.  Vectors that are
    null or hold null or non-finite components are left out; a shorter vector ends in
    zeros, and so does every vector whose length is no multiple of ``parts``.  The codebook of a part
    starts as that part of the ``entries`` (256 at most) smallest ids, of a repeated id its least vector, null
    ids last; with fewer ids it has fewer entries.  Each round assigns every part to its
    nearest entry (ties to the lower one) and moves entries to the floored mean of
    their parts; unused entries stay.  Repeated rows count as often as they come.

    Vectors are stored with their codes and bounds, and every round reads that table and
    writes the next.  Sums go through one row per entry, position and task; codebooks
    (entries x width numbers) are all that the driver holds.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return None
    part = max(1, -(-longest // parts))
    width = part * parts
    first = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("id")).limit(entries).collect()  # the first codebook
    start = integers([r.v for r in first], width)
    books = Codebooks([np.stack([start[:, p * part : (p + 1) * part] for p in range(parts)])])
    k = len(start)

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = integers(b["v"].to_pylist(), width).astype(np.int32)
                none = pa.nulls(len(x), pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([r.tobytes() for r in x]), none, none, none],
                                                 ["id", "label", "v", "code", "bound", "stamp"])

    state = store(arrow_map(rows, initial, STATE), "vectors")

    def assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, ...]:
        """(vectors, codes, squared distances, bounds, stamps, computed) of a batch, under the newest codebooks."""
        m = batch.num_rows
        x = np.frombuffer(b"".join(batch["v"].to_pylist()), np.int32).reshape(m, width).astype(np.int64)
        if batch["code"].null_count:  # before the first round nothing is known: any entry, and bounds that hold for all
            code = np.zeros((m, parts), np.uint8)
            bound, stamp = np.full((m, parts, GROUPS), -np.inf, np.float32), np.zeros((m, parts, GROUPS), np.uint8)
        else:
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(m, parts).copy()
            bound = np.frombuffer(b"".join(batch["bound"].to_pylist()), np.float32).reshape(m, parts, GROUPS).copy()
            stamp = np.frombuffer(b"".join(batch["stamp"].to_pylist()), np.uint8).reshape(m, parts, GROUPS).copy()
        far, computed = np.zeros((m, parts), np.int64), 0
        for p in range(parts):
            own, low, when = code[:, p].astype(np.int64), bound[:, p].astype(float), stamp[:, p].astype(np.int64)
            far[:, p], count = assign(x[:, p * part : (p + 1) * part], books, p, own, low, when)
            code[:, p], stamp[:, p] = own, when
            bound[:, p] = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
            computed += count
        return x, code, far, bound, stamp, computed

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                yield b.slice(at, ROWS)

    def assign_all(state: DataFrame, books: Codebooks) -> DataFrame:
        shared = spark.sparkContext.broadcast(books)  # rounds x entries x width numbers

        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                _, code, far, bound, stamp, computed = assigned(b, shared.value)
                counts = np.zeros(b.num_rows, np.int64)
                counts[:1] = computed
                yield pa.RecordBatch.from_arrays(
                    [b["id"], b["label"], b["v"], *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (code, bound, stamp)),
                     pa.array(far.sum(axis=1)), pa.array(counts)], ["id", "label", "v", "code", "bound", "stamp", "error", "computed"])

        return store(arrow_map(state.select("id", "label", "v", "code", "bound", "stamp"), job, STATE + ", error long, computed long"), "assigned")

    def sums(state: DataFrame) -> np.ndarray:
        """(parts, entries, part width + 1): sums of components and, last, counts."""

        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts * k, part + 1), np.int64)
            for b in small(batches):
                x = np.frombuffer(b"".join(b["v"].to_pylist()), np.int32).reshape(b.num_rows, parts, part).astype(np.int64)
                code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
                cell = (code + np.arange(parts) * k).ravel()
                np.add.at(total, cell, np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], axis=2).reshape(-1, part + 1))
            cell, place = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(total[cell, place])], ["cell", "place", "n"])

        out = np.zeros((parts * k, part + 1), np.int64)
        rows = arrow_map(state.select("v", "code"), job, "cell long, place long, n long").groupBy("cell", "place").agg(F.sum("n").alias("n"))
        for r in rows.collect():  # the size of the codebooks
            out[r.cell, r.place] = r.n
        return out.reshape(parts, k, part + 1)

    distances = []
    for turn in range(rounds + 1):
        done = assign_all(state, books)
        discard(state)
        state = done
        distances.append(state.agg(F.sum("computed")).first()[0])
        if turn < rounds:
            total = sums(state)
            mean = total[:, :, :-1] // np.maximum(total[:, :, -1:], 1)
            books.history.append(np.where(total[:, :, -1:] > 0, mean, books.history[-1]))
    return Codec(state.select("id", "label", "code", "error"), books.history[-1], distances)


def code_report(df: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; labels are compared as text, nulls together.

    ``code`` has two hex digits for each part.  The sum over a label is joined back in
    several copies, as one label may be that of a third of all rows.
    """
    codec = compress(df)
    if codec is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    salts = 16
    rows = codec.coded.select("id", "code", "error", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("text")).alias("named"))
    sums = store(rows.groupBy("named").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    return rows.join(sums, ["named", "salt"]).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                                                     F.lit(codec.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e, len(embedding) // {parts} AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, part, e[part * w + 1 : part * w + w] AS v FROM kept, range({parts}) AS t(part)
), c0 AS MATERIALIZED (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry, v AS c
  FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
)"""]
    for r in range(rounds + 1):
        steps.append(f""", a{r} AS MATERIALIZED (
  SELECT x.vec_id, x.part, min((CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS HUGEINT) * {entries} + entry)) AS best
  FROM x JOIN c{r} ON x.part = c{r}.part GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f""", m{r} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY place) AS c FROM (
    SELECT part, entry, place, floor(sum(component) / count(*)) AS mean FROM (
      SELECT x.part, CAST(best % {entries} AS BIGINT) AS entry, unnest(v) AS component, unnest(range(len(v))) AS place
      FROM x JOIN a{r} ON x.vec_id = a{r}.vec_id AND x.part = a{r}.part) GROUP BY ALL) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c{r}.part, c{r}.entry, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.part = m{r}.part AND c{r}.entry = m{r}.entry
)""")
    return "".join(steps) + f""", done AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(best % {entries} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
), said AS (
  SELECT sha256(string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS n, unnest(range(len(c))) AS place FROM c{rounds})
)
SELECT done.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM done JOIN kept USING (vec_id), said
"""


SQL = _sql()
