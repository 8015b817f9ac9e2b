"""Self join of documents on the Jaccard similarity of word n-grams: size-aware, heavy and light lists."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BUCKET_BITS, CLASSES, LOWER, KeyBitmap, KeyPacker, Prefix, arrow_map, bucket_tasks, components, distinct, flat_bytes, id_bitmap,
    key_bitmap, mix, shingles, slices, store, union_all, words,
)

#: Cost of fetching and comparing one candidate, in postings.
CANDIDATE_COST = 50
LARGEST_SMALL = 20
#: Tokens turned into rows at once.
ROW_TOKENS = 100_000
#: Bits of a set's sketch, in numbers of 64 bits.
SKETCH = 8
SKETCHES = [f"s{i}" for i in range(SKETCH)]
POSTING = np.dtype([("token", "<u8"), ("node", "<u8"), ("n", "<u4")])
#: Sets of an open list that all others meet in a turn, and turns before all pairs are left to meet; a turn with fewer links than one for FEW postings is the last.
LEADERS, TURNS, FEW = 4, 6, 200
LIGHT, HEAVY, LINK = 0, 1, 2
#: In place of a size, in postings of subsets: any two sets of the key link, or only one of SURE with one of LARGER.
SURE, LARGER = 1 << 31, (1 << 31) + 1


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def subset_keys(n: int, largest: int, percent: int) -> int:
    """How many subsets a set of size n enumerates for partners up to ``largest``."""
    total = 0
    for m in range(max(1, -(-percent * n // 100)), min(largest, 100 * n // percent) + 1):
        c = overlap_needed(n, m, percent)
        if c <= min(n, m) and not (c == n == m):
            total += comb(n, c)
    return total


def boundary(repeats: float, percent: int) -> int:
    """Largest size for which enumerating subsets costs less than scanning lists.

    ``repeats``: how many other sets a counted token meets on average.
    """
    best = 0
    for n in range(1, LARGEST_SMALL + 1):
        prefix = n - -(-percent * n // 100) + 1
        if subset_keys(n, n, percent) > prefix * (1 + CANDIDATE_COST * repeats):
            break
        best = n
    return best


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    data, offsets = flat_bytes(batch["text"])
    low = LOWER[data]
    start, end, first = words(low, offsets)
    hashes = Prefix(low).ranges(start, end)
    for i in range(batch.num_rows):
        yield distinct(shingles(hashes[first[i] : first[i + 1]], k))


def node_of(tokens: np.ndarray) -> int:
    """64-bit identity of a set; signed, as Spark has it."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch_of(tokens: np.ndarray) -> bytes:
    """For each of 64 * SKETCH slots whether an odd number of the tokens fall into it.

    Two sets differ in as many tokens as their sketches differ in bits, at least.
    """
    odd = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Seen(set):
    """Nodes a task has met lately."""

    def new(self, node: int) -> bool:
        if node in self:
            return False
        if len(self) > 300_000:
            self.clear()
        self.add(node)
        return True


def measured(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, key, n, node) of documents."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [(len(tokens), node_of(tokens) if len(tokens) else None) for tokens in sets_of(b, k)]
            sizes, nodes = zip(*sets, strict=True)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())],
                                             ["doc_id", "key", "n", "node"])

    return arrow_map(docs, job, "doc_id long, key long, n long, node long")


def packed_tokens(docs: DataFrame, k: int, most_alike: int) -> DataFrame:
    """Packed tokens of the sets, each set once in a task."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = KeyPacker(most_alike), Seen()
        for b in slices(batches):
            for tokens in sets_of(b, k):
                if len(tokens) and seen.new(node_of(tokens)):
                    yield from packer.add(tokens)
        yield from packer.flush()

    return arrow_map(docs.select("text"), job, "bucket int, keys binary")


def postings(docs: DataFrame, heavy: KeyBitmap, small: int, k: int, percent: int) -> DataFrame:
    """What distinct sets post: packed subsets, rows of heavy tokens by set, and links found on the way.

    The order of tokens is: light ones, then heavy ones by frequency class, rare before
    common, then by hash.  A set posts the prefix of which a partner must share a token,
    without its light tokens, which no other set has.  So lists are those of the rarest
    shared tokens, and a common passage is met only by sets that are little else.  Sets up to ``small`` instead post the
    subsets of the size that a partner of each size must share; a subset met before in
    the task links its sets at once.  What a smaller partner must share may be too little
    for two sets of the larger size; those are posted apart and never link each other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)
    names = ["kind", "bucket", "keys", "a", "b", "n", "sketch"]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, Seen()
        light, held, others = [], 0, []
        subsets: dict[int, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal light, held, others
            if light:
                rows = np.concatenate(light)
                bucket = (rows["token"] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                parts = [rows[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(rows)), strict=True)]
                others += [(LIGHT, int(b), p, None, None, None, None) for b, p in zip(bucket[cut], parts, strict=True)]
            if others:
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*others, strict=True), kinds, strict=True)], names)
            light, held, others = [], 0, []

        def post(tokens: np.ndarray, node: int, n: int) -> None:
            nonlocal held
            rows = np.zeros(len(tokens), POSTING)
            rows["token"], rows["node"], rows["n"] = tokens, np.int64(node).astype(np.uint64), n
            light.append(rows)
            held += len(rows)

        for b in slices(batches):
            for tokens in sets_of(b, k):
                n = len(tokens)
                if not n:
                    continue
                node = node_of(tokens)
                if not seen.new(node):
                    continue
                if n <= small:
                    for m in range(-(-percent * n // 100), min(small, 100 * n // percent) + 1):
                        c = overlap_needed(n, m, percent)
                        if c > min(n, m) or c == n == m:
                            continue
                        groups = np.array(list(combinations(tokens, c)), np.uint64)
                        pair = np.uint64(min(n, m) * 64 + max(n, m))
                        keys = mix(shingle_sum(groups) + pair)
                        sure = c >= overlap_needed(n, n, percent)
                        fresh = []
                        for key in keys.tolist():
                            if key in subsets:
                                others.append((LINK, None, None, node, subsets[key], None, None))
                            else:
                                if sure:
                                    subsets[key] = node
                                fresh.append(key)
                        if fresh:
                            post(np.array(fresh, np.uint64), node, SURE if sure else LARGER)
                    if len(subsets) > 300_000:
                        subsets.clear()
                if 100 * n >= percent * (small + 1):
                    often = bitmap.has(tokens)
                    prefix = n - -(-percent * n // 100) + 1
                    light_ones = n - int(often.sum())
                    if light_ones < prefix:
                        shared_ones = tokens[often]
                        shared_ones = shared_ones[np.argsort(bitmap.level(shared_ones), kind="stable")]
                        others.append((HEAVY, None, shared_ones[: prefix - light_ones].tobytes(), node, n - light_ones, n, sketch_of(tokens)))
                if held > 250_000 or len(others) > 20_000:
                    yield from flush()
        yield from flush()

    return arrow_map(docs.select("text"), job, "kind int, bucket int, keys binary, a long, b long, n long, sketch binary")


def shingle_sum(groups: np.ndarray) -> np.ndarray:
    """One hash for each row of sorted tokens."""
    total = np.zeros(len(groups), np.uint64)
    for j in range(groups.shape[1]):
        total = mix(total + groups[:, j])
    return total


def pairs_of_lists(rows: np.ndarray, small: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From one bucket's postings: (a, b, certain).  Sets of a subset key are linked to its first, if that is SURE; lists give pairs."""
    rows = rows[np.lexsort((rows["node"], rows["n"], rows["token"]))]
    same = (rows["token"][1:] == rows["token"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[np.append(True, ~same)]
    start = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
    length = np.diff(np.append(start, len(rows)))
    sub = rows["n"][start] >= SURE
    star = (rows["n"][start] == SURE) & (length > 1)
    stars, sizes = start[star], length[star]
    if len(stars):
        at = np.repeat(stars, sizes - 1)
        step = np.arange(len(at)) - np.repeat(np.append(0, np.cumsum(sizes - 1)[:-1]), sizes - 1) + 1
        yield rows["node"][at], rows["node"][at + step], np.ones(len(at), bool)
    start, length = start[~sub & (length > 1)], length[~sub & (length > 1)]
    node, n = rows["node"], rows["n"].astype(np.int64)
    far = 1
    while len(start):  # partners at distance 1, 2, ... in the list, which is sorted by size
        keep = length > far
        start, length = start[keep], length[keep]
        if not len(start):
            break
        spans = length - far
        i = np.repeat(start, spans) + np.arange(spans.sum()) - np.repeat(np.append(0, np.cumsum(spans)[:-1]), spans)
        ok = (percent * n[i + far] <= 100 * n[i]) & (n[i + far] > small)
        yield node[i[ok]], node[i[ok] + far], np.zeros(int(ok.sum()), bool)
        far += 1


def light_pairs(posted: DataFrame, small: int, percent: int) -> DataFrame:
    """Distinct (a, b, certain) from the light lists, one bucket after another."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, keys in zip(batch["bucket"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                held.setdefault(b, []).append(keys)
        found: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found, count
            if found:
                a, b, sure = (np.concatenate(x) for x in zip(*found, strict=True))
                table = np.zeros(len(a), np.dtype([("a", "<i8"), ("b", "<i8"), ("s", "?")]))
                table["a"], table["b"] = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
                table["s"] = sure
                table = table[np.lexsort((table["b"], table["a"], ~table["s"]))]
                table = table[np.append(True, (table["a"][1:] != table["a"][:-1]) | (table["b"][1:] != table["b"][:-1]))] if len(table) else table
                yield pa.RecordBatch.from_arrays([pa.array(table[c]) for c in ("a", "b", "s")], ["a", "b", "certain"])
            found, count = [], 0

        for b in sorted(held):
            for some in pairs_of_lists(np.frombuffer(b"".join(held.pop(b)), POSTING), small, percent):
                found.append(tuple(np.ascontiguousarray(x) for x in some))
                count += len(some[0])
                if count > 1_000_000:
                    yield from flush()
        yield from flush()

    rows = posted.where(F.col("kind") == LIGHT).select("bucket", "keys")
    found = arrow_map(rows.repartition(bucket_tasks(posted), "bucket"), job, "a long, b long, certain boolean")
    return found.groupBy("a", "b").agg(F.max("certain").alias("certain"))


def heavy_rows(rows: DataFrame, chosen: KeyBitmap | None = None, with_set: bool = True) -> DataFrame:
    """(token, component[, node, n, rest[, sketch]]) of heavy tokens, (token, component) once in a piece of ``ROW_TOKENS``.

    ``chosen`` takes the tokens of a bitmap only.  ``rest`` is how many tokens of the set
    come at this one or later in the common order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(chosen) if chosen else None
    sketched = with_set and "sketch" in rows.columns
    columns = ["token", "component"] + (["node", "n", "rest"] if with_set else []) + (SKETCHES if sketched else [])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value if shared else None
        for batch in batches:
            for b in slices(iter([batch]), "keys", ROW_TOKENS * 8):
                data, offsets = flat_bytes(b["keys"])
                tokens, counts = data.view(np.int64), np.diff(offsets) // 8
                owner = np.repeat(np.arange(b.num_rows), counts)
                at = np.arange(len(tokens)) - np.repeat(offsets[:-1] // 8, counts)
                if bitmap:
                    chosen_ones = np.flatnonzero(bitmap.has(tokens.view(np.uint64)))
                    tokens, owner, at = tokens[chosen_ones], owner[chosen_ones], at[chosen_ones]
                component, node, n, rest = (b[x].to_numpy()[owner] for x in ("component", "a", "n", "rest"))
                out = [tokens, component] + ([node, n, rest - at] if with_set else [])
                if sketched:
                    out += list(flat_bytes(b["sketch"])[0].view(np.int64).reshape(-1, SKETCH)[owner].T)
                if not with_set:
                    order = np.lexsort(out)
                    tokens, component = tokens[order], component[order]
                    first = np.append(True, (tokens[1:] != tokens[:-1]) | (component[1:] != component[:-1]))[: len(tokens)]
                    out = [tokens[first], component[first]]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out], columns)

    return arrow_map(rows.select("keys", "a", "n", "rest", "component", *(["sketch"] if sketched else [])), job, ", ".join(f"{c} long" for c in columns))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity, by exact intersection of token hashes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), job, "a long, b long")


def fetch_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the wanted nodes: one document of each, found by a filtered scan."""
    wanted = store(rows.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min("key").alias("key")), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            b = b.filter(pa.array(shared.value.has(b["key"].to_numpy().view(np.uint64))))
            if b.num_rows:
                tokens = [x.tobytes() for x in sets_of(b, k)]
                yield pa.RecordBatch.from_arrays([b["key"], pa.array(tokens, pa.binary())], ["key", "tokens"])

    found = arrow_map(docs.select("key", "text"), job, "key long, tokens binary")
    sets = found.join(wanted, "key").dropDuplicates(["node"]).select("node", "tokens")
    return store(sets, "sets")


def resolve(heavies: DataFrame, candidates: DataFrame | None, links: list[DataFrame], fetch, percent: int, small: int = 0,
            ordered: bool = True) -> DataFrame:
    """(node, component) from links known before, candidate pairs and lists too long for pairs.

    ``heavies`` has a set's list keys in the common order, node, size and how many tokens
    come from the first key on (keys, a, n, rest), and may have its sketch; ``fetch`` gives the sets of nodes.
    Round one compares every set with one leader of each of its lists, apart by size.
    Then only lists on which more than one component is left are opened.  As long as it
    merges some, for ``TURNS`` turns at most, their sets meet ``LEADERS`` others of the list that are drawn anew
    in each turn (a fixed one may be the only one that is like no other); at last the sets
    of different components meet.  ``ordered``: the keys are a set's first tokens in the
    common order.  Then two sets whose first common token comes so late that too few are
    left cannot be similar, and neither can two that share too few of those first tokens:
    what the set that ends first shares beyond them is at most the rest of it.  Nor can
    two whose sketches differ in more bits than similar sets of their sizes have different tokens.
    """
    needed = F.ceil((F.col("n") + F.col("n2")) * F.lit(percent) / F.lit(100 + percent))
    reach = (F.least("rest", "rest2") >= needed) & (F.greatest("n", "n2") > small)
    band = F.floor(F.log("n") / F.lit(-np.log(percent / 100)))
    sketches = SKETCHES if "sketch" in heavies.columns else []
    alike = F.lit(True)
    if sketches:
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in sketches[1:]), F.bit_count(F.col("s0").bitwiseXOR(F.col("s02"))))
        alike = bits <= F.col("n") + F.col("n2") - 2 * needed
    some = heavy_rows(heavies.drop("sketch").withColumn("component", F.col("a"))).withColumn("band", band)
    leader = (some.groupBy("token", "band").agg(F.min(F.struct("node", "n", "rest")).alias("l"))
              .select("token", "band", F.col("l.node").alias("node2"), F.col("l.n").alias("n2"), F.col("l.rest").alias("rest2")))
    near = (some.join(leader, ["token", "band"]).where((F.col("node") != F.col("node2")) & reach)
            .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
    near = store(near.unionByName(candidates).distinct() if candidates else near, "candidates")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    edges = lambda known: known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = store(union_all([*links, verified(near, fetch(ends(near)), percent)]), "found-links")
    known = store(components(links), "components")

    def opened(known: DataFrame) -> DataFrame | None:
        """Postings of the lists with several components."""
        placed = (heavies.join(known.withColumnRenamed("node", "a"), "a", "left")
                  .select("keys", "a", "n", "rest", F.coalesce("component", "a").alias("component"), *(["sketch"] if sketches else [])))
        placed = store(placed, "heavy-sets")
        several = (heavy_rows(placed, with_set=False).distinct().groupBy("token").agg(F.count("*").alias("c"))
                   .where("c > 1").select(F.col("token").alias("key")))
        several = store(several, "open-lists")
        return None if several.isEmpty() else store(heavy_rows(placed, chosen=id_bitmap(several)), "open-postings")

    tested, met, turn = near, opened(known), 0
    while met and turn < TURNS:
        by_chance = [F.min(F.struct(F.xxhash64("token", "node", F.lit(turn * LEADERS + i)), "component", "node", "n", "rest", *sketches))
                     for i in range(LEADERS)]
        head = met.groupBy("token").agg(F.array(*by_chance).alias("l")).select("token", F.explode("l").alias("l")).select(
            "token", F.col("l.component").alias("c2"), *[F.col(f"l.{c}").alias(c + "2") for c in ("node", "n", "rest", *sketches)])
        some = (met.join(head, "token").where((F.col("component") != F.col("c2")) & reach & alike)
                .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
                .join(tested, ["a", "b"], "left_anti"))
        some, turn = store(some, "candidates"), turn + 1
        if some.isEmpty():
            break
        tested = tested.unionByName(some)
        more = store(verified(some, fetch(ends(some)), percent), "more-links")
        if more.isEmpty():
            break
        few = more.count() * FEW < met.count()
        known = store(components(edges(known).unionByName(more)), "components")
        met = opened(known)
        if few:
            break
    if not met:
        return known
    other = met.select("token", F.col("component").alias("c2"), *[F.col(c).alias(c + "2") for c in ("node", "n", *sketches)])
    sized = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.greatest("n", "n2") > small)
    across = (met.join(other, "token").where((F.col("component") < F.col("c2")) & sized & alike)
              .groupBy("node", "n", "node2", "n2").agg(F.count("*").alias("shared")))
    if ordered:
        across = across.where(F.col("shared") + F.ceil(F.greatest("n", "n2") * F.lit(percent) / F.lit(100)) - 1 >= needed)
    across = (across.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
              .join(tested, ["a", "b"], "left_anti"))
    across = store(across, "candidates")
    if across.isEmpty():
        return known
    more = store(verified(across, fetch(ends(across)), percent), "more-links")
    return known if more.isEmpty() else store(components(edges(known).unionByName(more)), "components")


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Two documents link when 100 * intersection >= percent * union of their distinct
    ``k``-word shingles (words between ASCII white space, A-Z lower-cased; with fewer
    words the whole sequence is one shingle).  ``component_id`` is the smallest doc_id
    reachable by links.  A null or empty text has no shingles and links with nothing:
    its component is its own doc_id.  Rows with equal sets are one node, so copies and
    repeated rows cost nothing; a null doc_id is never the smallest unless all are null.
    Shingles and sets are known by 64-bit hashes.

    Size-aware: sets up to a boundary enumerate the fixed-size subsets that a partner
    must share, larger ones scan the lists of their prefix tokens; the boundary is where
    the first stops being cheaper.  Lists never give all their pairs: their
    sets are first compared with one leader of each list, and then only sets that are
    still in different components meet.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    rows = store(measured(docs, k), "set-sizes")
    heavy = key_bitmap(packed_tokens(docs, k, CLASSES[-1]), 2, classes=True)  # a token of one set alone is not even posted
    small = boundary((heavy.total - heavy.different) / max(heavy.different, 1), percent)

    posted = store(postings(docs, heavy, small, k, percent), "postings")
    del heavy  # 48 MB that the driver has no more use for
    light = store(light_pairs(posted, small, percent), "light-pairs")
    heavies = posted.where(F.col("kind") == HEAVY).select("keys", "a", "n", F.col("b").alias("rest"), "sketch")
    links = [posted.where(F.col("kind") == LINK).select("a", "b"), light.where("certain").select("a", "b")]

    known = resolve(heavies, light.where("not certain").select("a", "b"), links, lambda nodes: fetch_sets(docs, rows, nodes, k),
                    percent, small)
    whole = rows.join(known, "node", "left").withColumn("root", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    least = whole.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(order).alias("kept"))
    return (whole.join(least, "root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "key",
                    F.coalesce(F.col("key") == F.col("kept.key"), F.lit(True)).alias("stays")))


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that are the first of their group (smallest doc_id), with all columns.

    Rows without words stay.  Of rows that repeat id and text one stays.  Only rows that
    may have to go are shuffled.
    """
    groups = store(similar_groups(docs, k, percent), "groups")
    verdict = (groups.groupBy("key").agg(F.min("stays").alias("stays"), F.count("*").alias("times"))
               .where("not stays or times > 1").select(F.col("key").alias("__row"), F.col("stays").alias("__stays")))
    verdict = store(verdict, "verdicts")
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(verdict.select(F.col("__row").alias("key"))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def named(wanted: bool):
        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(shared.value.has(b["__row"].to_numpy().view(np.uint64)) == wanted))
        return job

    untouched = arrow_map(keyed, named(False), fields)
    touched = arrow_map(keyed, named(True), fields).join(verdict, "__row", "left")
    once = touched.where("__stays").dropDuplicates(["__row"]).select(keyed.columns)
    return untouched.union(touched.where("__stays is null").select(keyed.columns)).union(once).select(docs.columns)
