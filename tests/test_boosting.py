"""Second-order boosting against an exhaustive search, permutation importance against its definition."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paylattice.operators import boosting as BO
from paylattice.operators import models as MD
from paylattice.session import scratch_path

PAY = MD.PAY
SCHEMA = f"id int, {PAY} double, a array<double>"


def table(spark, x, y):
    rows = [(i, None if y[i] is None else float(y[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", array_to_vector("a"))


def sample_rows(n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 2, n), rng.integers(0, 12, n), rng.integers(0, 6, n)]).astype(float)
    return x, np.round(900 * x[:, 0] + 40 * x[:, 1] ** 2 - 300 * (x[:, 2] > 3) + rng.normal(size=n) * 30, 2)


def exhaustive(x, y, rounds, depth, step, l2, delta):
    """Predictions of trees whose splits are searched over every value of every feature."""
    raw = np.full(len(y), y.mean())
    for _ in range(rounds):
        r = raw - y
        g = np.round(r / np.sqrt(1 + (r / delta) ** 2) if delta else r, 4)
        h = np.round((1 + (r / delta) ** 2) ** -1.5 if delta else np.ones(len(y)), 10)
        leaves = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in leaves:
                best = (0.0, None)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left = rows[x[rows, f] <= cut]
                        right = rows[x[rows, f] > cut]
                        if h[left].sum() < 1 or h[right].sum() < 1:
                            continue
                        gain = (g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - whole) / 2
                        if gain > best[0] + 1e-9 * abs(whole):
                            best = (gain, (left, right))
                after += best[1] if best[1] else [rows]
            leaves = after
        for rows in leaves:
            raw[rows] -= step * g[rows].sum() / (h[rows].sum() + l2)
    return raw


@pytest.mark.parametrize("delta", [None, 250.0])
def test_trees_equal_an_exhaustive_search(spark, delta):
    x, y = sample_rows()
    df = table(spark, x, y)
    model = BO.SecondOrderBoosting(rounds=3, depth=3, step=0.5, l2=2.0, sample=1.0, columns=1.0, delta=delta, store_every=2).fit(df)
    mine = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    expected = exhaustive(x, y, 3, 3, 0.5, 2.0, delta)
    assert max(abs(mine[i] - expected[i]) for i in range(len(y))) < 0.01


def test_partitioning_does_not_change_a_model(spark):
    x, y = sample_rows()
    df = table(spark, x, y)
    fit = BO.SecondOrderBoosting(rounds=2, depth=3, sample=0.7, columns=0.7).fit
    one, many = fit(df.coalesce(1)), fit(df.repartition(9))
    assert one.trees == many.trees and one.init == many.init


def test_missing_values_labels_and_single_values(spark):
    x, y = sample_rows(120)
    x[::7, 1] = math.nan
    x = np.column_stack([x, np.full(len(x), 4.0), np.full(len(x), math.nan)])  # two columns that cannot split
    y = [None if i % 11 == 0 else v for i, v in enumerate(y)]
    df = table(spark, x, y)
    model = BO.SecondOrderBoosting(rounds=2, depth=3, sample=1.0, columns=1.0).fit(df)
    out = model.transform(df).collect()
    assert len(out) == len(y) and all(math.isfinite(r["prediction"]) for r in out)
    assert model.featureImportances.toArray()[3:].tolist() == [0.0, 0.0]
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    least = model.transform(table(spark, [[1, 0, 2, 4, 4], [1, math.nan, 2, 4, 4]], [1, 1])).collect()
    assert least[0]["prediction"] == least[1]["prediction"]  # missing counts as the least value


def test_level_sums_are_exact_and_rows_are_not_multiplied_by_their_features(spark):
    from decimal import Decimal

    rows = [(i, 2 + i % 3, (-1) ** i * (9.9e13 + i) if i % 2 else i / 7, 1 / (1 + i), [i % 4, 300, 2][: 3 - (i == 5)]) for i in range(900)]
    df = spark.createDataFrame(rows + [(900, 2, 1.0, 1.0, None)], "id int, node int, g double, h double, bins array<smallint>").repartition(5)
    sums = BO.level_sums(df, F.col("node"), F.col("g"), F.col("h"), [0, 2])
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    cut = {r["id"]: (r["g"], r["h"]) for r in df.select("id", F.col("g").cast(BO.GRADIENT), F.col("h").cast(BO.CURVATURE)).collect()}
    want = {}
    for i, node, _, _, bins in rows:
        for f in (0, 2):
            if f < len(bins):
                g, h = want.get((node, f, bins[f]), (Decimal(0), Decimal(0)))
                want[node, f, bins[f]] = g + cut[i][0], h + cut[i][1]
    assert {(r["node"], r["feature"], r["bin"]): (r["g"], r["h"]) for r in sums.collect()} == want


def test_edges_of_missing_values_and_short_rows(spark):
    rows = [([1.0, math.nan, 5.0],), ([2.0, None, 4.0],), ([3.0],), (None,), ([3.0, math.nan, 5.0],)]
    assert BO.bin_edges(spark.createDataFrame(rows, "v array<double>").repartition(3), "v", 8) == [[1.0, 2.0], [], [4.0]]
    assert BO.bin_edges(spark.createDataFrame([], "v array<double>"), "v", 8) == []


def test_no_rows_is_an_error_and_equal_rows_give_their_mean(spark):
    empty = spark.createDataFrame([], SCHEMA).withColumn("features", array_to_vector("a"))
    with pytest.raises(ValueError):
        BO.SecondOrderBoosting(rounds=1).fit(empty)
    same = table(spark, [[1.0, 2.0]] * 30, [50000.0] * 30)
    assert {r["prediction"] for r in BO.SecondOrderBoosting(rounds=2, depth=2).fit(same).transform(same).collect()} == {50000.0}


def test_boosting_ends_when_held_out_rows_stop_improving(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, (160, 3)).astype(float)
    y = rng.normal(size=160) * 100 + 1000  # nothing to learn
    df = table(spark, x, y).withColumn("held", F.col("id") % 2 == 0)
    model = BO.SecondOrderBoosting(rounds=30, depth=3, step=0.8, validation="held", patience=2).fit(df)
    assert len(model.losses) < 30 and len(model.trees) == int(np.argmin(model.losses)) + 1


def test_edges_keep_every_value_of_small_features_and_quantiles_of_large_ones(spark):
    rows = spark.range(4000).select(F.array((F.col("id") % 5).cast("double"), F.col("id").cast("double")).alias("v"))
    small, large = BO.bin_edges(rows, "v", 16)
    assert small == [0.0, 1.0, 2.0, 3.0]
    assert large == sorted(large) and 14 <= len(large) <= 16 and large[0] == 0.0


def test_stored_model_is_read_back(spark):
    x, y = sample_rows(100)
    df = table(spark, x, y)
    model = BO.SecondOrderBoosting(rounds=2, depth=2).fit(df)
    path = scratch_path(spark, "second_order")
    model.save(spark, path)
    assert BO.SecondOrderModel.load(spark, path) == model


def test_permutation_importance_follows_its_definition(spark):
    x, y = sample_rows(90)
    df = table(spark, x, y)
    model = BO.SecondOrderBoosting(rounds=4, depth=2, step=0.5, sample=1.0, columns=1.0).fit(df)
    out = {r["feature"]: r for r in MD.permutation_importance(df, model, ["p", "q", "r"], group=40).collect()}
    digest = [hashlib.md5(f"{i}:pair:{MD.SEED}".encode()).hexdigest() for i in range(90)]
    donor = {}
    for g in range(3):
        members = sorted((d, i) for i, d in enumerate(digest) if int(d[:8], 16) % 3 == g)
        for k, (_, i) in enumerate(members):
            donor[i] = members[(k + 1) % len(members)][1]
    assert sorted(donor.values()) == list(range(90))

    def mse(values):
        scored = model.transform(table(spark, values, y)).collect()
        return np.mean([(max(0.0, r["prediction"]) - r[PAY]) ** 2 for r in scored])

    for j, name in enumerate("pqr"):
        moved = x.copy()
        moved[:, j] = [x[donor[i], j] for i in range(90)]
        assert abs(out[name]["permuted_mse"] - mse(moved)) < 0.01 and abs(out[name]["base_mse"] - mse(x)) < 0.01
    assert out["q"]["importance"] > out["r"]["importance"]


def test_permuted_rows_are_scored_where_a_used_feature_changes(spark):
    x, y = sample_rows(90)
    x = np.column_stack([x, np.full(len(x), 4.0), np.arange(len(x))])  # never changes; changes, but is not used
    df = table(spark, x, y)
    model = BO.SecondOrderBoosting(rounds=2, depth=2, step=0.5, sample=1.0, columns=1.0).fit(table(spark, np.column_stack([x[:, :4], np.zeros(len(x))]), y))
    scored = []

    class Counted:
        featureImportances = model.featureImportances  # noqa: N815

        def transform(self, rows):
            scored.append(rows.count())
            return model.transform(rows)

    out = {r["feature"]: r for r in MD.permutation_importance(df, Counted(), list("pqrst")).collect()}
    assert out["s"]["importance"] == out["t"]["importance"] == 0 and out["q"]["importance"] > 0
    used = sum(v > 0 for v in model.featureImportances.toArray())
    assert scored[0] == 90 and 90 < scored[1] <= 90 * (1 + used) and len(out) == 5


def test_equal_fits_of_a_rung_are_made_once(spark, monkeypatch):
    x, y = sample_rows(150)
    path = scratch_path(spark, "grid")
    table(spark, x, y).write.parquet(path)
    made, maker = [], MD.boosted_trees
    monkeypatch.setattr(MD, "boosted_trees", lambda *p: made.append(p) or maker(*p))
    points = MD.grid_points(rounds=(3, 4), depths=(1, 2), steps=(0.1, 0.6), samples=(1.0,))
    found = MD.halving_search(spark.read.parquet(path), points, folds=2, factor=4)
    assert [s[:3] for s in found.scores if s[0] == 1] == [(1, p, 1) for p in points]
    first = {p: s[3] for s in found.scores if s[0] == 1 for p in [s[1]]}
    rows = spark.read.parquet(path).withColumns({"_fold": MD.key_share("id", "fold", 2), "_stop": MD.key_share("id", "stop", 10) == 0})
    for p in points[:2]:  # the step has no say in a single tree
        errors = [maker(1, p.depth, p.step, p.sample).setValidationIndicatorCol("_stop").fit(rows.where(F.col("_fold") != f)).transform(rows.where(F.col("_fold") == f))
                  .agg(F.avg(F.pow(F.col(PAY) - F.col("prediction"), 2))).first()[0] for f in range(2)]
        assert abs(first[p] - np.mean(errors)) < 1e-6 * first[p]
    assert len([p for p in made if p[0] == 1]) == 2 * 2  # two depths, two folds, where 16 fits were made


def test_halving_gives_the_best_points_more_rounds(spark):
    x, y = sample_rows(150)
    path = scratch_path(spark, "grid")
    table(spark, x, y).write.parquet(path)
    rows = spark.read.parquet(path)
    points = MD.grid_points(rounds=(4,), depths=(1, 3), steps=(0.05, 0.6), samples=(1.0,))
    found = MD.halving_search(rows, points, folds=2, factor=2)
    by_rung = {r: [s for s in found.scores if s[0] == r] for r in {s[0] for s in found.scores}}
    assert [len(by_rung[r]) for r in sorted(by_rung)] == [4, 2, 1]
    assert [{s[2] for s in by_rung[r]} for r in sorted(by_rung)] == [{1}, {2}, {4}]
    for rung in (1, 2):
        kept = [s[3] for s in by_rung[rung] if s[4]]
        assert max(kept) <= min([s[3] for s in by_rung[rung] if not s[4]])
        assert {s[1] for s in by_rung[rung] if s[4]} == {s[1] for s in by_rung[rung + 1]}
    assert found.best == points[3] and found.model.getNumTrees <= 4
    with_one = MD.halving_search(rows, points[:1], folds=2)
    assert with_one.best == points[0] and len(with_one.scores) == 1
    assert found.table(spark).count() == 7
