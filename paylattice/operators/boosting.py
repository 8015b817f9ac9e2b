"""Boosted trees with second-order splits: gradients, curvatures and an L2 penalty, as grouped aggregates.

A row is reduced once to its bin number per feature.  Every level of a tree is one job: rows
find their node, and the sums of gradient and curvature per (node, feature, bin) are combined on
the map side, so what is shuffled is bounded by nodes x features x bins and never by rows.  Only the chosen
split of each node comes to the driver.  Gradients and curvatures are summed as decimals, so a tree
does not depend on the order or partitioning of rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, share_package

GRADIENT, CURVATURE = "decimal(18,4)", "decimal(20,10)"
TREES = "array<struct<feature:array<int>,cut:array<double>,weight:array<double>>>"
SKETCH = 10_000  # accuracy of the bin edges of features with many values


@dataclass(frozen=True)
class Loss:
    """Squared error, or with ``delta`` the pseudo-Huber loss, which is linear far from the truth."""

    delta: float | None = None

    def gradient(self, y: Column, raw: Column) -> Column:
        r = raw - y
        return r if self.delta is None else r / F.sqrt(1 + F.pow(r / self.delta, F.lit(2)))

    def curvature(self, y: Column, raw: Column) -> Column:
        r = raw - y
        return F.lit(1.0) if self.delta is None else F.pow(1 + F.pow(r / self.delta, F.lit(2)), F.lit(-1.5))

    def value(self, y: Column, raw: Column) -> Column:
        r = raw - y
        return r * r / 2 if self.delta is None else self.delta ** 2 * (F.sqrt(1 + F.pow(r / self.delta, F.lit(2))) - 1)


def constant(value, schema: str) -> Column:
    """A nested list as one literal, however long it is."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def matrix(lists: pa.Array, missing) -> np.ndarray:
    """Rows of an array column as a table; ``missing`` where an array is null or too short, or an element is null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat, width = pc.fill_null(lists.flatten(), missing).to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out, row = np.full((len(sizes), width), missing, flat.dtype), np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def bin_edges(rows: DataFrame, values: str, bins: int) -> list[list[float]]:
    """Ascending thresholds per feature of an array column; a row's bin is the number of thresholds below its value.

    A feature with at most ``2 * bins`` values gets all of them but the greatest, so none of its splits is
    lost; tasks keep its values in numpy.  The others get their quantiles from a mergeable sketch.  Nulls and NaN count as missing.
    """
    most = 2 * bins

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            table = matrix(batch["values"], np.nan)
            for f in range(table.shape[1]):
                if len(held.get(f, ())) <= most:
                    found = np.unique(table[:, f])
                    held[f] = np.union1d(held.get(f, found[:0]), found[~np.isnan(found)])[: most + 1]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))],
                                             ["feature", "all"])

    share_package(rows.sparkSession)
    some = rows.select(F.col(values).cast("array<double>").alias("values")).mapInArrow(job, "feature int, all array<double>")
    seen = {r["feature"]: sorted(r["all"]) for r in  # one row a feature, of a few values from each task
            some.select("feature", F.explode("all").alias("v")).groupBy("feature").agg(F.collect_set("v").alias("all")).collect()}
    edges: list[list[float]] = [[] for _ in range(1 + max(seen, default=-1))]
    for f, found in seen.items():
        edges[f] = found[:-1]
    many = [f for f, found in seen.items() if len(found) > most]
    if many:
        shares = [k / bins for k in range(1, bins)]
        flat = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.get(values, F.lit(f)).alias("v")) for f in many])).alias("x")).select("x.*")
        for r in flat.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("feature").agg(
                F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", shares, SKETCH).alias("cuts")).collect():
            edges[r["feature"]] = sorted({r["least"], *r["cuts"]} - {r["most"]})
    return edges


def to_bins(values: Column, edges: list[list[float]]) -> Column:
    """Bin number per feature; missing values share the lowest bin."""
    cuts = constant(edges, "array<array<double>>")
    return F.transform(values, lambda v, i: F.when(F.isnan(v), 0).otherwise(
        F.size(F.filter(F.get(cuts, i), lambda c: c < v))).cast("smallint"))


def candidate_splits(sums: DataFrame, l2: float, min_weight: float = 1.0) -> DataFrame:
    """Every split of (node, feature, bin, g, h) sums: what lies at or below ``bin`` goes left.

    ``gain`` is the drop of the regularised second-order loss.  Sides lighter than ``min_weight`` (sum of
    curvatures) are no split.
    """
    group = Window.partitionBy("node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    split = sums.select(
        "node", "feature", "bin",
        F.sum("g").over(upto).cast("double").alias("left_g"), F.sum("h").over(upto).cast("double").alias("left_h"),
        F.sum("g").over(group).cast("double").alias("all_g"), F.sum("h").over(group).cast("double").alias("all_h"))

    def score(g, h):
        return g * g / (h + l2)

    right_g, right_h = F.col("all_g") - F.col("left_g"), F.col("all_h") - F.col("left_h")
    gain = (score(F.col("left_g"), F.col("left_h")) + score(right_g, right_h) - score(F.col("all_g"), F.col("all_h"))) / 2
    return split.where((F.col("left_h") >= min_weight) & (right_h >= min_weight)).withColumn("gain", gain)


def best_splits(splits: DataFrame, min_gain: float = 0.0) -> DataFrame:
    """The best split of each node; ties go to the smaller feature, then the smaller bin."""
    order = Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "bin")
    return splits.where(F.col("gain") > min_gain).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


#: Sums that a task holds before it adds equal ones up.
HELD = 500_000
#: Sums are kept as this many low bits and the rest, so that neither part is ever rounded.
LOW_BITS = 30


def exact_sums(at: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 64-bit integers per place as (high, low) parts; exact for up to 2^22 weights."""
    if len(weights) * max(abs(int(weights.max())), abs(int(weights.min()))) < 2 ** 53:  # no sum is rounded as a double
        total = np.bincount(at, weights, size).astype(np.int64)
        return total >> LOW_BITS, total & ((1 << LOW_BITS) - 1)
    high, low = weights >> LOW_BITS, weights & ((1 << LOW_BITS) - 1)
    return np.bincount(at, high, size).astype(np.int64), np.bincount(at, low, size).astype(np.int64)


def decimals(high: np.ndarray, low: np.ndarray, scale: int) -> pa.Array:
    raw = b"".join(((h << LOW_BITS) + n).to_bytes(16, "little", signed=True) for h, n in zip(high.tolist(), low.tolist(), strict=True))
    return pa.Array.from_buffers(pa.decimal128(38, scale), len(high), [None, pa.py_buffer(raw)])


def added_up(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (key, high and low part of g, high and low part of h) with one row a key."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    out = np.add.reduceat(rows, first, axis=1)
    out[0] = rows[0, first]
    for high, low in ((1, 2), (3, 4)):
        out[high] += out[low] >> LOW_BITS
        out[low] &= (1 << LOW_BITS) - 1
    return out


def batch_sums(batch: pa.RecordBatch, features: list[int]) -> Iterator[np.ndarray]:
    """Sums of the rows of a batch per (node, feature, bin), in the rows of ``added_up``; one feature at a time."""
    bins = matrix(batch["bins"], -1)  # a feature that a row doesn't have
    g, h = batch["g"].to_numpy(), batch["h"].to_numpy()
    nodes, at = np.unique(batch["node"].to_numpy(), return_inverse=True)
    for f in features:
        if f >= bins.shape[1]:
            continue
        own = bins[:, f].astype(np.int64)
        known = slice(None) if own.min() >= 0 else own >= 0
        own, size = own[known], int(own.max()) + 1
        if not size:
            continue
        place = at[known] * size + own
        found = np.flatnonzero(np.bincount(place))
        sums = [x[found] for w in (g, h) for x in exact_sums(place, w[known], found[-1] + 1)]
        yield np.array([nodes[found // size].astype(np.int64) << 40 | f << 16 | found % size, *sums])


def level_sums(rows: DataFrame, node: Column, g: Column, h: Column, features: list[int], bins: str = "bins") -> DataFrame:
    """Exact sums per (node, feature, bin); ``features`` are the ones a tree may use.

    Tasks add up in numpy, on the integers behind the decimals, so a row is never multiplied by its features.
    """
    shifted = rows.select(node.cast("int").alias("node"), (g.cast(GRADIENT) * F.lit(Decimal(10 ** 4))).cast("bigint").alias("g"),
                          (h.cast(CURVATURE) * F.lit(Decimal(10 ** 10))).cast("bigint").alias("h"), F.col(bins).alias("bins"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for a in range(0, batch.num_rows, 10_000):
                held += batch_sums(batch.slice(a, 10_000), features)
            if sum(x.shape[1] for x in held) > HELD:
                held = [added_up(held)]
        if held:
            key, *sums = added_up(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key >> 40, pa.int32()), pa.array(key >> 16 & 0xFFFFFF, pa.int32()), pa.array(key & 0xFFFF, pa.int32()),
                 decimals(*sums[:2], 4), decimals(*sums[2:], 10)], ["node", "feature", "bin", "g", "h"])

    share_package(rows.sparkSession)
    # both the sums and the running sums over the bins of a feature stay where this deals them to
    sums = shifted.mapInArrow(job, "node int, feature int, bin int, g decimal(38,4), h decimal(38,10)").repartition("node", "feature")
    return sums.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def walk(tree: Column, depth: int, values: Column) -> Column:
    """Node a row reaches after ``depth`` steps from node 1; missing values and unsplit nodes go left."""

    def step(node, _):
        f = F.get(tree["feature"], node)
        v = F.when(f >= 0, F.get(values, f))
        return 2 * node + F.when((v > F.get(tree["cut"], node)) & ~F.isnan(v.cast("double")), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def tree_sum(trees: list[dict], depth: int, values: Column) -> Column:
    """Sum of the trees' leaf weights; the expression does not grow with the number of trees."""
    if not trees:
        return F.lit(0.0)
    return F.aggregate(constant(trees, TREES), F.lit(0.0), lambda total, t: total + F.get(t["weight"], walk(t, depth, values)))


@dataclass
class SecondOrderModel:
    """Trees as arrays over heap positions (children of n: 2n and 2n + 1), thresholds in units of the features."""

    init: float
    depth: int
    trees: list[dict]
    gains: list[float]
    features_col: str = "features"
    losses: list[float] = field(default_factory=list)  # on validation rows, after each tree

    def transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array(self.features_col)
        return df.withColumn("prediction", F.lit(self.init) + tree_sum(self.trees, self.depth, values))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802, the name that MLlib's models use
        total = sum(self.gains)
        return Vectors.dense([g / total if total else 0.0 for g in self.gains])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SecondOrderModel":
        return cls(**json.loads(spark.read.parquet(path).first()["model"]))


@dataclass
class SecondOrderBoosting:
    """Estimator with the ``fit`` of MLlib's.

    sample, columns: shares of rows and features each tree sees; both follow from keys and the seed.
    validation, patience: rows where this boolean column holds are not learned from; boosting ends once
    their loss has not improved for ``patience`` trees, and the trees up to the best one are kept.
    store_every: trees between two written states; rows carry the trees since the last one as an expression.

    Rows without label or features are left out.  No rows at all, or a feature vector of no columns, is an error.
    """

    rounds: int = 100
    depth: int = 6
    step: float = 0.05
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    bins: int = 32
    sample: float = 0.8
    columns: float = 0.8
    delta: float | None = None
    validation: str | None = None
    patience: int = 10
    store_every: int = 10
    label: str = "salary_usd_numeric"
    features: str = "features"
    key: str = "id"
    seed: int = 42

    def fit(self, df: DataFrame) -> SecondOrderModel:
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        rows = df.where(F.col(self.label).isNotNull() & F.col(self.features).isNotNull()).select(
            F.col(self.key).cast("string").alias("key"), F.col(self.label).cast("double").alias("y"), held.alias("held"),
            vector_to_array(self.features).alias("values"))
        learn = rows.where("NOT held")
        init = learn.agg(F.avg(F.col("y").cast(GRADIENT)).cast("double")).first()[0]
        if init is None:
            raise ValueError("no rows to learn from")
        edges = bin_edges(learn, "values", self.bins)
        usable = [f for f, cuts in enumerate(edges) if cuts]
        width = learn.select(F.size("values")).first()[0]
        if not width:
            raise ValueError("feature vectors are empty")
        state = self._store(rows.select("key", "y", "held", to_bins(F.col("values"), edges).alias("bins"), F.lit(init).alias("raw")))

        loss, gains = Loss(self.delta), [0.0] * width
        trees, binned, losses, stored = [], [], [], 0
        for number in range(self.rounds):
            raw = F.col("raw") + tree_sum(binned[stored:], self.depth, F.col("bins"))
            tree = self._tree(state, raw, loss, number, usable, gains)
            binned.append(tree)
            trees.append({**tree, "cut": [edges[f][int(c)] if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["cut"])]})
            if self.validation:
                now = F.col("raw") + tree_sum(binned[stored:], self.depth, F.col("bins"))
                value = state.where("held").agg(F.avg(loss.value(F.col("y"), now).cast("decimal(28,6)")).cast("double")).first()[0]
                if value is None:
                    raise ValueError("no validation rows")
                losses.append(value)
                if number - int(np.argmin(losses)) >= self.patience:
                    break
            if len(binned) - stored >= self.store_every and number + 1 < self.rounds:
                now = F.col("raw") + tree_sum(binned[stored:], self.depth, F.col("bins"))
                state = self._store(state.withColumn("raw", now))
                stored = len(binned)
        kept = trees[: int(np.argmin(losses)) + 1] if losses else trees
        return SecondOrderModel(init, self.depth, kept, gains, self.features, losses)

    def _store(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(rows.sparkSession, "boosting")
        rows.write.parquet(path)
        return rows.sparkSession.read.parquet(path)

    def _tree(self, state: DataFrame, raw: Column, loss: Loss, number: int, usable: list[int], gains: list[float]) -> dict:
        """One tree over bin numbers; gains of its splits are added to ``gains``."""
        size = 2 ** (self.depth + 1)
        tree = {"feature": [-1] * size, "cut": [0.0] * size, "weight": [0.0] * size}
        chosen = sorted(random.Random(f"{self.seed}:{number}").sample(usable, max(1, round(self.columns * len(usable))))) if usable else []
        share = F.pmod(F.xxhash64("key", F.lit(number), F.lit(self.seed)), F.lit(1_000_000)) < round(self.sample * 1_000_000)
        rows = state.where(F.col("held") == F.lit(False)).where(share)
        weights: dict[int, float] = {}
        open_nodes = [1]
        for level in range(self.depth):
            if not open_nodes or not chosen:
                break
            node = walk(constant([tree], TREES)[0], level, F.col("bins"))
            part = rows.select("bins", node.alias("node"), loss.gradient(F.col("y"), raw).alias("g"), loss.curvature(F.col("y"), raw).alias("h"))
            sums = level_sums(part.where(F.col("node").isin(open_nodes)), F.col("node"), F.col("g"), F.col("h"), chosen)
            picked = best_splits(candidate_splits(sums, self.l2, self.min_weight), self.min_gain).collect()  # at most one row a node
            open_nodes = []
            for s in picked:
                n, f = s["node"], s["feature"]
                tree["feature"][n], tree["cut"][n] = f, float(s["bin"])
                gains[f] += s["gain"]
                weights.pop(n, None)
                weights[2 * n] = -self.step * s["left_g"] / (s["left_h"] + self.l2)
                weights[2 * n + 1] = -self.step * (s["all_g"] - s["left_g"]) / (s["all_h"] - s["left_h"] + self.l2)
                open_nodes += [2 * n, 2 * n + 1]
        for n, w in weights.items():  # rows of an unsplit node go left down to the last level
            while n < size // 2:
                n *= 2
            tree["weight"][n] = w
        return tree
