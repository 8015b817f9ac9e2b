"""Salary models on MLlib: split, train, compare, promote, store, predict."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product
from math import ceil

import uuid
from datetime import datetime, timezone

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..sources.published import Conflict, Pointer, Published
from . import features as FT
from .boosting import SecondOrderBoosting, SecondOrderModel
from .bulk import load_bulk
from .cleaning import clean_jobs
from .dedup import keep_first
from .quality import min_rows_gate, training_readiness
from .ranks import linear_percentiles, percentile_of

PAY = "salary_usd_numeric"
SEED = 42
MODEL_VERSION = "1.0.0"


def split_column(key: str = "id", seed: int = SEED) -> Column:
    """True for the 80 % training part; depends on the row's key only, not on partitioning."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(10)) < 8


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(PAY).between(*vocab.TRAINING_PAY_RANGE))


def assemble(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Feature columns to one vector; names may contain dots, so no name-based assembler."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.select(*keep, array_to_vector(values).alias("features"))


def random_forest(trees: int = 300, depth: int = 10, leaf: int = 5) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=PAY, featuresCol="features", numTrees=trees, maxDepth=depth,
                                 minInstancesPerNode=leaf, seed=SEED)


def boosted_trees(rounds: int = 100, depth: int = 6, step: float = 0.05, sample: float = 0.8) -> GBTRegressor:
    return GBTRegressor(labelCol=PAY, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=step,
                        subsamplingRate=sample, seed=SEED)


def grid_search(train: DataFrame, rounds=(500, 800), depths=(10, 12), steps=(0.03, 0.05), samples=(0.8, 0.9),
                folds: int = 3, parallelism: int = 4, key: str = "id"):
    """Cross-validated grid over boosted trees, scored by mean squared error.

    A row's fold follows from its key, so scores do not depend on the order or partitioning of rows.
    """
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":fold:{SEED}"))), 1, 8)
    train = train.withColumn("_fold", F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int"))
    model = boosted_trees()
    grid = (ParamGridBuilder().addGrid(model.maxIter, list(rounds)).addGrid(model.maxDepth, list(depths))
            .addGrid(model.stepSize, list(steps)).addGrid(model.subsamplingRate, list(samples)).build())
    search = CrossValidator(estimator=model, estimatorParamMaps=grid, numFolds=folds, foldCol="_fold", parallelism=parallelism, seed=SEED,
                            evaluator=RegressionEvaluator(labelCol=PAY, metricName="mse"))
    return search.fit(train)


def grid_scores(fitted: "CrossValidatorModel") -> list[tuple]:  # noqa: F821
    """(parameters, mean score) per grid point."""
    return [(", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), float(score))
            for params, score in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)]


@dataclass(frozen=True)
class GridPoint:
    rounds: int
    depth: int
    step: float
    sample: float


def grid_points(rounds=(500, 800), depths=(10, 12), steps=(0.03, 0.05), samples=(0.8, 0.9)) -> list[GridPoint]:
    return [GridPoint(*p) for p in product(rounds, depths, steps, samples)]


@dataclass
class HalvingResult:
    best: GridPoint
    model: GBTRegressionModel
    scores: list[tuple]  # (rung, GridPoint, rounds given, mean squared error over the folds, kept)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(rung, p.rounds, p.depth, p.step, p.sample, given, mse, kept) for rung, p, given, mse, kept in self.scores]
        return spark.createDataFrame(rows, "rung int, rounds int, depth int, step double, sample double, rounds_given int, mse double, kept boolean")


def key_share(key: str, name: str, parts: int) -> Column:
    """A part 0 to parts - 1 that follows from the row's key only."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{name}:{SEED}"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def halving_search(train: DataFrame, points: list[GridPoint] | None = None, folds: int = 3, factor: int = 4, parallelism: int = 4,
                   key: str = "id") -> HalvingResult:
    """Successive halving over the grid: all points with few rounds, the best 1/factor of them with factor times as many, and so on.

    The last rung gives a point all its rounds.  A point is scored by the mean squared error over key-made folds.
    Boosting ends early by the error of a tenth of the fitted rows, which is set apart by key as well, so neither the
    scored rows nor the partitioning have a say in it.  Ties go to the point that comes first.  The winner is fitted on
    all rows.  Points whose fits are the same are scored once.  ``train`` is read by every fit and should be a stored table.
    """
    points = points or grid_points()
    if not points:
        raise ValueError("no grid points")
    rows = train.withColumns({"_fold": key_share(key, "fold", folds), "_stop": key_share(key, "stop", 10) == 0})
    rungs = 1
    while factor ** rungs < len(points):
        rungs += 1
    rungs += 1 if len(points) > 1 else 0

    def fit(p: GridPoint, given: int, part: DataFrame) -> GBTRegressionModel:
        return boosted_trees(given, p.depth, p.step, p.sample).setValidationIndicatorCol("_stop").fit(part)

    def score(p: GridPoint, given: int) -> float:
        scored = None
        for f in range(folds):
            part = fit(p, given, rows.where(F.col("_fold") != f)).transform(rows.where(F.col("_fold") == f)).select(
                F.lit(f).alias("fold"), F.pow(F.col(PAY) - F.col("prediction"), 2).alias("e"))
            scored = part if scored is None else scored.unionByName(part)
        found = scored.groupBy("fold").agg(F.avg("e").alias("mse")).agg(F.avg("mse")).first()[0]
        return float("inf") if found is None else found

    left, scores, known = list(points), [], {}
    with ThreadPoolExecutor(parallelism) as pool:
        for rung in range(1, rungs + 1):
            given = [max(1, ceil(p.rounds / factor ** (rungs - rung))) for p in left]
            # the first tree has weight one, so the step counts from the second on
            same = [(g, p.depth, p.step if g > 1 else None, p.sample) for p, g in zip(left, given, strict=True)]
            fresh = {k: (p, g) for k, p, g in zip(same, left, given, strict=True) if k not in known}
            known |= dict(zip(fresh, pool.map(lambda x: score(*x), fresh.values()), strict=True))
            mse = [known[k] for k in same]
            order = sorted(range(len(left)), key=lambda i: (mse[i], i))
            kept = set(order[: max(1, len(left) // factor)] if rung < rungs else order[:1])
            scores += [(rung, p, g, m, i in kept) for i, (p, g, m) in enumerate(zip(left, given, mse, strict=True))]
            left = [left[i] for i in sorted(kept)]
    return HalvingResult(left[0], fit(left[0], left[0].rounds, rows), scores)


# --- evaluation ---------------------------------------------------------------

def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """RMSE, MAE and R2 per group from one pass of plain sums."""
    err = F.col(y) - F.col(pred)
    sums = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(err * err).alias("_sse"), F.avg(F.abs(err)).alias("mae"),
        F.var_pop(F.col(y)).alias("_var"))
    return sums.select(
        *keys, "rows", F.sqrt(F.col("_sse") / F.col("rows")).alias("rmse"), "mae",
        F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("rows"))).alias("r2"))


def select_best(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.orderBy(F.desc_nulls_last("r2"), name).limit(1)


def residual_std(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys).agg(F.stddev_pop(F.col(y) - F.col(pred)).alias("residual_std"))


def salary_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.min(PAY).alias("salary_min"), F.max(PAY).alias("salary_max"), F.avg(PAY).alias("salary_mean"))


def promotion_gate(candidates: DataFrame, max_drop: float = vocab.MAX_R2_DROP, force: bool = False) -> DataFrame:
    """Columns ``new_r2`` and ``old_r2`` -> may the candidate replace the stored model?"""
    floor = F.col("old_r2") - max_drop
    blocked = F.coalesce(F.col("new_r2") < floor, F.lit(False)) & F.lit(not force)
    return candidates.withColumns({
        "allowed_floor": floor, "promoted": ~blocked,
        "reason": F.when(blocked, "r2 below the allowed floor").when(F.lit(force), "forced")
        .when(F.col("old_r2").isNull() | F.col("new_r2").isNull(), "nothing to compare").otherwise("ok"),
    })


def feature_importance(spark: SparkSession, model, columns: list[str], n: int = 20) -> DataFrame:
    """The model's importances are one short vector on the driver by construction."""
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(n)


def with_donor(df: DataFrame, key: str, value: str, group: int = 1000, seed: int = SEED) -> DataFrame:
    """Column ``donor``: ``value`` of another row, so that the donors are a permutation of the values.

    Rows fall into groups of about ``group`` by the hash of their key and take the value of the next one in hash order, the
    last one that of the first.  Pairs depend on keys only, which have to be unique.  A row alone in its group keeps its value.
    """
    groups = df.count() // group + 1
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":pair:{seed}")))
    df = df.withColumn("_digest", digest).withColumn(
        "_group", F.pmod(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint"), F.lit(groups)))
    order = Window.partitionBy("_group").orderBy("_digest")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("donor", F.coalesce(F.lead(value).over(order), F.first(value).over(whole))).drop("_digest", "_group")


def permutation_importance(rows: DataFrame, model, columns: list[str], key: str = "id", label: str = PAY, features: str = "features",
                           group: int = 1000, seed: int = SEED) -> DataFrame:
    """How much the mean squared error rises when one column is shuffled: one row per feature.

    One shuffle pairs every row with a donor for all columns; a row is then scored unchanged and once per feature that the
    model uses and the donor has another value of, inside the task, and only sums of errors leave it.  With any other
    feature the error stays as it is.  Rows without label or features are left out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        key, F.col(label).alias("_y"), vector_to_array(features).alias("_own"))
    pairs = with_donor(known, key, "_own", group, seed)
    used = [i for i, v in enumerate(model.featureImportances.toArray()) if v] if hasattr(model, "featureImportances") else range(len(columns))
    changed = F.filter(F.array(*map(F.lit, used)).cast("array<int>"), lambda i: ~F.get("_own", i).eqNullSafe(F.get("donor", i)))
    error = F.greatest(F.lit(0.0), F.col("prediction")) - F.col("_y")
    squared = (error * error).cast("decimal(30,4)")
    plain = model.transform(pairs.withColumn(features, array_to_vector("_own"))).select("_y", "_own", "donor", squared.alias("_plain"))
    trials = plain.withColumn("_at", F.explode(F.concat(F.array(F.lit(-1)), changed)))
    trials = trials.withColumn(features, array_to_vector(F.transform(
        "_own", lambda v, i: F.when(i == F.col("_at"), F.get("donor", i)).otherwise(v))))
    sums = model.transform(trials.select("_y", "_at", "_plain", features)).groupBy("_at").agg(
        F.avg(squared).cast("double").alias("mse"), F.sum(squared).alias("_sum"), F.sum("_plain").alias("_was"), F.count(F.lit(1)).alias("_n"))
    base = sums.where("_at = -1").select(F.col("mse").alias("base_mse"), F.col("_sum").alias("_all"), F.col("_n").alias("_rows"))
    names = rows.sparkSession.createDataFrame(list(enumerate(columns)), "_at int, feature string")
    rise = F.col("_sum") - F.col("_was")
    moved = F.when(rise != 0, (F.col("_all") + rise).cast("double") / F.col("_rows")).otherwise(F.col("base_mse"))
    return names.join(base).join(sums.where("_at >= 0").select("_at", "_sum", "_was"), "_at", "left").select(
        "feature", "base_mse", moved.alias("permuted_mse"), (moved - F.col("base_mse")).alias("importance"))


# --- training run -------------------------------------------------------------

@dataclass
class SalaryModel:
    """Chosen model with the state needed to score and to explain its quality."""

    model: object
    encoders: FT.Encoders
    columns: list[str]
    name: str
    residual_std: float
    metrics: dict = field(default_factory=dict)
    train_pay: DataFrame | None = None
    facts: dict = field(default_factory=dict)  # rows, pay statistics and percentiles, date, source, readiness

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Batch prediction; negative output counts as zero."""
        vectors = assemble(FT.transform(df, self.encoders, keep), self.columns, keep)
        scored = self.model.transform(vectors)
        return scored.select(*keep, F.greatest(F.lit(0.0), F.col("prediction")).alias("prediction"))

    def predict_band(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Prediction, band of one residual standard deviation, percentile among training pay."""
        p = self.predict(df, keep)
        if self.train_pay is not None:
            p = percentile_of(self.train_pay, PAY, p, "prediction")
        else:
            p = p.withColumn("percentile", F.lit(50))
        value = F.col("prediction")
        return p.select(
            *keep, F.bround(value, 0).cast("bigint").alias("predicted_salary_usd"),
            F.bround(F.greatest(F.lit(0.0), value - self.residual_std), 0).cast("bigint").alias("confidence_low"),
            F.bround(value + self.residual_std, 0).cast("bigint").alias("confidence_high"), "percentile",
            F.lit(self.name).alias("model_name"), F.lit(MODEL_VERSION).alias("model_version"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Store a new version; readers see it once all of it is there, and the one before until then."""
        pointer, version = Pointer(spark, path), f"version={uuid.uuid4().hex}"
        number, out = pointer.number(), f"{path}/{version}"
        if isinstance(self.model, SecondOrderModel):
            self.model.save(spark, f"{out}/model")
        else:
            self.model.write().overwrite().save(f"{out}/model")
        self.encoders.save(spark, f"{out}/encoders")
        row = [(self.name, MODEL_VERSION, float(self.residual_std), self.columns, len(self.columns),
                {k: float(v) for k, v in self.metrics.items() if v is not None}, *(self.facts.get(k) for k in FACTS))]
        spark.createDataFrame(row, "name string, version string, residual_std double, columns array<string>, features int, "
                              "metrics map<string,double>, " + ", ".join(f"{k} {v}" for k, v in FACTS.items())
                              ).coalesce(1).write.mode("overwrite").parquet(f"{out}/metadata")
        if self.train_pay is not None:
            self.train_pay.select(PAY).write.mode("overwrite").parquet(f"{out}/train_pay")
        while True:
            try:
                pointer.swap([version], number)
                break
            except Conflict:  # another training run published; the later one is current
                number = pointer.number()
        pointer.remove_unlisted("version=")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SalaryModel":
        found = Pointer(spark, path).read()
        if not found:
            raise ValueError(f"no model is published below {path}")
        path = f"{path}/{found[0]}"
        meta = spark.read.parquet(f"{path}/metadata").first()
        if meta["name"].startswith("second_order"):
            model = SecondOrderModel.load(spark, f"{path}/model")
        else:
            kind = RandomForestRegressionModel if meta["name"].startswith("random_forest") else GBTRegressionModel
            model = kind.load(f"{path}/model")
        return cls(model, FT.Encoders.load(spark, f"{path}/encoders"), list(meta["columns"]),
                   meta["name"], meta["residual_std"], dict(meta["metrics"]), spark.read.parquet(f"{path}/train_pay"),
                   {k: meta[k] for k in FACTS})


#: What is stored with a model besides its quality.
FACTS = {"trained_at": "string", "training_rows": "bigint", "salary_min": "double", "salary_max": "double", "salary_mean": "double",
         "percentiles": "map<string,double>", "source": "string", "readiness": "string"}


def training_facts(fit_rows: DataFrame) -> dict:
    """Rows, pay statistics and percentiles of what a model is fitted on."""
    stats = salary_stats(fit_rows).join(fit_rows.agg(F.count(F.lit(1)).alias("training_rows"))).first()
    points = linear_percentiles(fit_rows, [], PAY, FT.PERCENTS).first().asDict()
    return {"trained_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **stats.asDict(),
            "percentiles": {k: float(v) for k, v in points.items() if v is not None}}


DEFAULT_CANDIDATES = {
    "random_forest": lambda: random_forest(),
    "boosted_trees": lambda: boosted_trees(),
    "boosted_trees_deep": lambda: boosted_trees(depth=10, step=0.03),
    "second_order": lambda: SecondOrderBoosting(),
}


def train(spark: SparkSession, jobs: DataFrame, work_dir: str, candidates: dict | None = None, key: str = "id",
          leaky: bool = False) -> SalaryModel:
    """Fit encoders and candidates, keep the best by R2.

    Encoders are fitted on the training part unless ``leaky`` asks for all rows.
    The assembled vectors are written to ``work_dir`` once: tree training reads
    its input many times, and a written table survives lost executors.
    """
    is_train = split_column(key)
    encoders, table = FT.fit_transform(jobs, keep=[key, PAY], split=None if leaky else is_train)
    columns = encoders.feature_columns
    vectors = assemble(training_rows(table), columns, [key, PAY]).withColumn("_train", is_train)
    vectors.write.mode("overwrite").parquet(f"{work_dir}/vectors")
    stored = spark.read.parquet(f"{work_dir}/vectors")
    fit_rows, test_rows = stored.where("_train"), stored.where("NOT _train")
    if stored.count() < vocab.ROWS_STOP:
        raise ValueError(f"needs at least {vocab.ROWS_STOP} rows with pay")

    fitted, scored = {}, None
    for name, make in (candidates or DEFAULT_CANDIDATES).items():
        estimator = make()
        if isinstance(estimator, SecondOrderBoosting):
            estimator.key = key
        fitted[name] = estimator.fit(fit_rows)
        part = fitted[name].transform(test_rows).select(F.lit(name).alias("model"), F.col(PAY).alias("y"),
                                                        F.col("prediction").alias("pred"))
        scored = part if scored is None else scored.unionByName(part)
    metrics = regression_metrics(scored, ["model"])
    best = select_best(metrics.join(residual_std(scored, ["model"]), "model"), "model").first()
    return SalaryModel(
        fitted[best["model"]], encoders, columns, best["model"], best["residual_std"],
        {"rmse": best["rmse"], "mae": best["mae"], "r2": best["r2"], "rows": best["rows"]},
        fit_rows.select(PAY), training_facts(fit_rows))


def log_run(spark: SparkSession, path: str, model: SalaryModel, rows: int) -> DataFrame:
    """Append one record to the run table; ids count up, also when several runs end at once."""
    table, m = Published(spark, path, key=None, label="run"), model.metrics
    run = len(table.names())
    while True:
        run += 1
        record = [(run, model.name, round(m["rmse"], 2), round(m["mae"], 2), round(m["r2"], 4), rows, len(model.columns))]
        frame = spark.createDataFrame(
            record, "run_id int, model_name string, rmse double, mae double, r2 double, rows bigint, features int").coalesce(1)
        if table.add_next(frame, str(run)):
            return read_runs(spark, path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return Published(spark, path, key=None, label="run").read().drop("run")


def load_training_rows(bulk: DataFrame | None, collected: DataFrame | None) -> DataFrame:
    """Bulk rows before collected ones, the first of each posting kept, in the columns of collected listings."""
    frames = [] if bulk is None else [load_bulk(bulk).withColumn("id", F.col("job_id").try_cast("bigint"))]
    frames += [] if collected is None else [collected]
    if not frames:
        raise ValueError("nothing to train on")
    return keep_first(frames, [F.asc_nulls_last("id"), "identity"])


def train_from_sources(spark: SparkSession, bulk: DataFrame | None, collected: DataFrame | None, out_dir: str, **options) -> DataFrame:
    """The whole run: load and merge, clean, gates, training, promotion, storing; one-row report."""
    source = "+".join(n for n, f in (("bulk", bulk), ("collected", collected)) if f is not None)
    return training_job(spark, clean_jobs(load_training_rows(bulk, collected)), out_dir, source=source, **options)


def training_job(spark: SparkSession, cleaned: DataFrame, out_dir: str, candidates: dict | None = None,
                 previous_r2: float | None = None, force: bool = False, leaky: bool = False, source: str = "cleaned") -> DataFrame:
    """Gates, training, promotion, storing, run log.  Returns a one-row report.

    The cleaned table is stored first: gates, encoders and features all read it.  With a promoted
    model its feature table, readiness report, pay statistics and run record are stored.
    """
    cleaned.write.mode("overwrite").parquet(f"{out_dir}/cleaned")
    cleaned = spark.read.schema(cleaned.schema).parquet(f"{out_dir}/cleaned")
    gate = min_rows_gate(cleaned).first()
    if gate["status"] == "stop":
        raise ValueError(f"needs at least {vocab.ROWS_STOP} rows with pay")
    ready = training_readiness(cleaned)
    said = ready.select("ready", F.to_json(F.struct("*")).alias("text")).first()
    model = train(spark, cleaned, f"{out_dir}/work", candidates, leaky=leaky)
    model.facts |= {"source": source, "readiness": said["text"]}
    report = promotion_gate(spark.createDataFrame(
        [(model.name, model.metrics["r2"], previous_r2, said["ready"], gate["status"], gate["salary_rows"])],
        "model_name string, new_r2 double, old_r2 double, ready boolean, rows_status string, salary_rows bigint"),
        force=force)
    if report.first()["promoted"]:
        model.save(spark, f"{out_dir}/model")
        FT.transform(cleaned, model.encoders, ["id"]).write.mode("overwrite").parquet(f"{out_dir}/features")
        log_run(spark, f"{out_dir}/runs", model, gate["salary_rows"])
    return report


def score_requests(requests: DataFrame, model: SalaryModel) -> DataFrame:
    """Model output with and without skills for every request, from one scoring pass."""
    rows = FT.request_rows(requests)
    both = rows.withColumn("_skills", F.lit(1)).unionByName(
        rows.withColumn("skills_required", F.lit(None).cast("string")).withColumn("_skills", F.lit(0)))
    out = model.predict(both, ["request_id", "_skills"])
    whole = F.bround("prediction", 0)
    return out.groupBy("request_id").agg(
        F.max(F.when(F.col("_skills") == 1, whole)).alias("model_usd"),
        F.max(F.when(F.col("_skills") == 0, whole)).alias("model_no_skills_usd"))


def prediction_report(requests: DataFrame, model: SalaryModel, jobs: DataFrame) -> DataFrame:
    """Full answer per request: prediction, adjustments, comparable postings, model error."""
    from .scoring import final_prediction
    from .similar import COMPACT, similar_jobs

    scores = score_requests(requests, model)
    plain = requests.drop("model_usd", "model_no_skills_usd")
    final = final_prediction(plain.join(scores, "request_id"))
    shown = similar_jobs(requests, jobs, 5).groupBy("request_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", *COMPACT))), lambda j: j.dropFields("position"))
        .alias("similar_jobs"))
    return final.join(shown, "request_id", "left").withColumns({
        "similar_jobs_count": F.coalesce(F.size("similar_jobs"), F.lit(0)),
        "model_name": F.lit(model.name), "model_version": F.lit(MODEL_VERSION),
        "model_rmse": F.lit(model.metrics.get("rmse")),
    })
