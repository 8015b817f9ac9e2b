"""Near-duplicate vectors: spherical-cap filters from structured random product codes, joined on filters and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, store

#: Filters whose cap holds a vector, on average; a vector in fewer caps also takes its nearest filters up to this number.
CAPS = 24
#: Caps never get narrower than this cosine, so that similar vectors share enough of them in any number of dimensions.
NARROWEST = 0.6
#: Directions per block of the product code at most, before one more block is used.
MOST_CODES = 2_048
#: Vectors drawn to place the caps' threshold.
CALIBRATION = 400
#: Vectors of a cell that meet at once; larger cells are cut into parts of about this size.
PART = 512
SEED = 20_170


def filters_for(n: int, width: int) -> int:
    """Number of directions for n nodes: a cap holds about one, or more where caps would get too narrow."""
    if width < 2:
        return 2
    angle = np.linspace(0, np.pi, 20_001)
    share = np.cumsum(np.sin(angle) ** (width - 2))
    cap = share[np.searchsorted(angle, np.arccos(NARROWEST))] / share[-1]
    return int(max(2, min(CAPS * n, CAPS / cap)))


class CapFilters:
    """Random filter directions: all sums of one code from each of ``blocks`` blocks of coordinates.

    Directions and rotation depend on width and number of filters alone.  ``threshold``
    is placed so that a random direction lies in ``CAPS`` caps on average.  Blocks have four
    coordinates at least, so very short vectors get fewer filters than asked for, and
    fuller cells.
    """

    def __init__(self, width: int, filters: int):
        rng = np.random.default_rng(SEED)
        most_blocks = max(1, width // 4)
        self.blocks = next(m for m in range(1, most_blocks + 1) if m == most_blocks or (m > 1 and filters <= MOST_CODES**m))
        per_block = min(MOST_CODES, max(2, int(np.ceil(filters ** (1 / self.blocks)))))
        cuts = np.linspace(0, width, self.blocks + 1).astype(int)
        self.ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        codes = [rng.normal(size=(per_block, b - a)) for a, b in self.ranges]
        codes = [np.unique(c / np.linalg.norm(c, axis=1)[:, None], axis=0) for c in codes]  # one coordinate has two directions only
        self.codes = [c / np.sqrt(self.blocks) for c in codes]
        self.count = int(np.prod([len(c) for c in codes], dtype=float))
        probe = rng.normal(size=(CALIBRATION, width))
        parts = self.products(probe / np.linalg.norm(probe, axis=1)[:, None])
        low, high = -1.0, 1.0
        want = min(CAPS, self.count / 2)
        for _ in range(20):
            self.threshold = (low + high) / 2
            # from above: high thresholds list few directions
            held = sum(self.above([p[i] for p in parts], self.threshold, 4 * CAPS * CALIBRATION)[0].size for i in range(CALIBRATION))
            low, high = (self.threshold, high) if held > want * CALIBRATION else (low, self.threshold)
        self.threshold = high

    def products(self, unit: np.ndarray) -> list[np.ndarray]:
        """Inner products of each rotated vector with the codes of each block."""
        turned = unit @ self.turn
        return [turned[:, a:b] @ c.T for (a, b), c in zip(self.ranges, self.codes, strict=True)]

    def above(self, parts: list[np.ndarray], threshold: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(filter, product) of all directions whose product with one vector reaches ``threshold``.

        Blocks are added one by one; a partial sum goes on only while the best codes of the
        remaining blocks can still lift it to the threshold.  ``most`` stops the listing
        early when only the size matters.
        """
        ahead = np.append(np.cumsum([p.max() for p in parts][::-1])[::-1][1:], 0.0)
        total, name = np.zeros(1), np.zeros(1, np.int64)
        for p, rest in zip(parts, ahead, strict=True):
            order = np.argsort(-p)
            best = p[order]
            fits = np.searchsorted(-best, total + rest - threshold, "right")
            if most is not None and fits.sum() > most:
                return np.zeros(most, np.int64), np.zeros(most)
            i = np.repeat(np.arange(len(total)), fits)
            j = np.arange(len(i)) - np.repeat(np.cumsum(fits) - fits, fits)
            total, name = total[i] + best[j], name[i] * len(p) + order[j]
        return name, total

    def of(self, unit: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted filters of each vector: those above the threshold, or its ``CAPS`` nearest if these are fewer."""
        least = min(CAPS, self.count)
        parts = self.products(unit)
        for i in range(len(unit)):
            own, threshold = [p[i] for p in parts], self.threshold
            names, values = self.above(own, threshold)
            while len(names) < least:
                threshold -= 0.04
                names, values = self.above(own, threshold)
                if len(names) >= least:
                    names = names[np.lexsort((names, -values))[:least]]
            yield np.sort(names)


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by a power of two, so that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of ``a`` with every row of ``b``, scaled like ``unit_rows``."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def joint_links(v: np.ndarray, filters: list[np.ndarray], cell: int, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs (left, right) of one cell reach the cosine and share no filter before this one.

    A pair is thus found once, in the first of the cells it shares.
    """
    linked = cosines(v[left], v[right]) >= least
    if left is right:
        np.fill_diagonal(linked, False)
    i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if len(i):
        # filters below this one, numbered anew: pairs that share any were found there
        before = {k: filters[k][: np.searchsorted(filters[k], cell)] for k in {*left[i].tolist(), *right[j].tolist()}}
        names = np.unique(np.concatenate(list(before.values())))
        if len(names):
            holds = np.zeros((len(v), len(names)), np.float32)
            for k, f in before.items():
                holds[k, np.searchsorted(names, f)] = 1
            linked[np.ix_(i, j)] &= holds[left[i]] @ holds[right[j]].T == 0
    return linked


def spanning(linked: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each row of a symmetric link matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def found_in_cells(postings: DataFrame, width: int, least: float) -> DataFrame:
    """(node, links, root) from postings (part keys, node, copies, v, filters, first): one row per linked node of a cell part.

    ``links`` counts vectors linked in this cell for the first time, ``root`` is a node of
    the cell that is reachable by its links.  Rows of a cell part come one after another,
    so a task holds one part at a time.
    """
    keys = ["label", "cell", "p", "q"]

    def solve(rows: dict[str, list]) -> tuple[list, list, list] | None:
        side, nodes = np.array(rows["side"]), np.array(rows["node"], np.int64)
        copies = np.array(rows["copies"], np.int64)
        v = np.stack([np.frombuffer(x) for x in rows["v"]])
        filters = [np.frombuffer(x, np.int64) for x in rows["filters"]]
        cell = rows["cell"][0]
        linked = np.zeros((len(v), len(v)), bool)
        if rows["p"][0] == rows["q"][0]:
            whole = np.arange(len(v))
            linked = joint_links(v, filters, cell, whole, whole, least)
        else:
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                linked[np.ix_(a, b)] = joint_links(v, filters, cell, a, b, least)
                linked |= linked.T
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return None
        return nodes[some].tolist(), (linked @ copies)[some].tolist(), nodes[spanning(linked)[some]].tolist()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        at = None
        out: list[list] = [[], [], []]

        def close() -> None:
            if at is not None and len(held["node"]) > 1 and (got := solve(held)):
                for column, values in zip(out, got, strict=True):
                    column.extend(values)

        for batch in batches:
            rows = batch.to_pydict()
            place = list(zip(*(rows[c] for c in keys), strict=True))
            cuts = [0] + [i for i in range(1, len(place)) if place[i] != place[i - 1]] + [len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if place[a] != at:
                    close()
                    held, at = {c: [] for c in rows}, place[a]
                for c in rows:
                    held[c].extend(rows[c][a:b])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])
                out = [[], [], []]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["node", "links", "root"])

    together = postings.repartition(*keys).sortWithinPartitions(*keys, "node")
    return arrow_map(together, job, "node long, links long, root long")


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are other rows of an equal label with cosine >= ``least``.

    A row with a null label or id, or a vector that is null, empty, zero or holds null or
    non-finite components, links with nothing: no links, its own component.  A shorter
    vector ends in zeros.  Rows that repeat label and vector are one node with several
    copies, which all link with each other; rows that repeat an id count one by one.
    ``component_id`` is the smallest id reachable by links, ``kept`` holds where that is
    the row's own.  Other columns are ignored.

    With n nodes there are ``CAPS * n`` directions, so a cap holds about one node (fewer
    directions where caps would get narrower than ``NARROWEST``).  Each
    vector takes all directions whose caps hold it, found by list decoding of the product
    code.  Nodes of equal label (compared as text) meet in the cells (filters) they share and are
    verified in double precision; a cell larger than ``PART`` is cut into parts that meet two by two.
    Pairs never leave a task: a cell gives counts and one link of each node to a root.  Of
    random pairs at cosine 0.98 all of 1,500 shared a filter at 51,282 and at 10,000,000 nodes.
    """
    spark = df.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    fine = F.coalesce(fine, F.lit(False))
    rows = store(rows.withColumn("fine", fine), "vectors")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                          F.lit(True).alias("kept"))
    nodes = rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    # numbers are fixed once the table is written
    nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return alone
    filters = CapFilters(width, filters_for(n, width))
    shared = spark.sparkContext.broadcast(filters)  # directions: MOST_CODES a block at most

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                b = whole.slice(start, 1_000)
                full = padded(b["v"].to_pylist(), width)
                lists = list(shared.value.of(unit_rows(full)))
                yield pa.RecordBatch.from_arrays(
                    [b["node"], b["label"], b["copies"], pa.array([x.tobytes() for x in full]), pa.array(lists, pa.list_(pa.int64())),
                     pa.array([x.tobytes() for x in lists])], ["node", "label", "copies", "v", "cells", "filters"])

    decoded = store(arrow_map(nodes.select("node", "label", "copies", "v"), decode,
                              "node long, label string, copies long, v binary, cells array<long>, filters binary"), "decoded")
    posted = decoded.select("node", "label", F.explode("cells").alias("cell"))
    several = store(posted.groupBy("label", "cell").agg(F.count("*").alias("size")).where("size > 1"), "cells")
    wanted = posted.join(several, ["label", "cell"]).withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = (wanted.withColumn("own", own).select("node", "label", "cell", "own", other.alias("other"))
           .select("node", "label", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                   (F.col("own") > F.col("other")).cast("int").alias("side")))
    packed = decoded.select("node", "copies", "v", "filters")
    postings = met.join(packed, "node").select("label", "cell", "p", "q", "side", "node", "copies", "v", "filters")
    found = store(found_in_cells(postings, width, least), "found")

    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = store(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    # only nodes with copies or links differ from what a row says by itself
    touched = (nodes.join(counted, "node", "left").join(linked, "node", "left").where("copies > 1 or links is not null")
               .select("label", "v", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                       F.coalesce("component", "node").alias("root")))
    touched = store(touched, "touched")
    smallest = store(touched.groupBy("root").agg(F.min("least_id").alias("component_id")), "smallest")
    salts = 8  # one vector may be that of a third of all rows
    result = (touched.join(smallest, "root").select("label", "v", "links", "component_id")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    dealt = rows.where("fine").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    joined = dealt.join(result, ["label", "v", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    done = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         (F.col("vec_id") == component).alias("kept"))
    return done.unionByName(alone)


def padded(rows: list[list[float]], width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         coalesce(label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(counted.n, 0) AS n_links, least(v.vec_id, coalesce(least.b, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(least.b, v.vec_id) AS kept
FROM v LEFT JOIN least ON least.a = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id
"""
