"""Source, sink, history, page, streaming and model queries."""

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import schemas, vocab as V
from ..operators import boosting as BO
from ..operators import cleaning as C
from ..operators import dedup as K
from ..operators import features as FT
from ..operators import history as H
from ..operators import models as MD
from ..operators import pages as P

from ..session import scratch_path
from ..sources import io
from ..streaming import jobs as ST
from . import duck as D
from .cleanup import BEST, CLEANED, HALVES, IDENTITY, INSERTED, LOADED, PARTS, halves
from .market import HEALTH
from .registry import query
from .scoring import requests

# --- sources and sinks --------------------------------------------------------

STORED = [f for f in schemas.JOBS.fieldNames()]


def stored_jobs(t):
    """The jobs view in the shape of the stored table."""
    keyed = K.with_key(t.jobs)
    return keyed.select(*[c for c in STORED if c in keyed.columns])


STORED_SHOWN = ["id", "job_title", "company_name", "salary", "salary_usd_numeric", "job_description", "job_link", "scraped_at"]
STORED_SQL = f"SELECT {', '.join(STORED_SHOWN)} FROM jobs"


# an empty CSV field is a missing value
@query("scan_csv", "jobs", STORED_SQL.replace("job_link", "nullif(job_link, '') AS job_link"))
def _(t):
    path = scratch_path(t.spark, "scan_csv")
    rows = stored_jobs(t)
    io.write_csv(rows, path)
    return io.scan_csv(t.spark, path, rows.schema).select(*STORED_SHOWN)


@query("scan_jobs", "jobs", STORED_SQL)
def _(t):
    path = scratch_path(t.spark, "scan_jobs")
    stored_jobs(t).write.parquet(path)
    return io.scan_jobs(t.spark, path).select(*STORED_SHOWN)


@query("conform_listings", "raw", "SELECT id, job_title, salary, CAST(has_equity AS DOUBLE) AS has_equity, "
       "CAST(NULL AS STRING) AS currency, company_rating FROM raw WHERE coalesce(job_title, '') <> ''")
def _(t):
    return io.conform(t.raw).select("id", "job_title", "salary", "has_equity", "currency", "company_rating")


@query("snapshot_export", "raw", f"""{BEST % ""}, n AS (SELECT count(*) c, CAST(sum(id) AS BIGINT) s FROM best)
    SELECT 'csv' AS kind, c AS "rows", s AS id_sum FROM n UNION ALL SELECT 'json', c, s FROM n""")
def _(t):
    rows = C.deduplicate(t.raw)
    paths = io.snapshot_export(rows, scratch_path(t.spark, "snapshot"), "20240101_000000")
    schema = io.ordered_columns(rows).schema
    back = io.scan_csv(t.spark, paths["csv"], schema).select(F.lit("csv").alias("kind"), "id").unionByName(
        t.spark.read.schema(schema).json(paths["json"]).select(F.lit("json").alias("kind"), "id"))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("id_sum"))


@query("append_master", "raw", f"{HALVES} SELECT dedup_key, id FROM master UNION ALL SELECT dedup_key, id FROM batch")
def _(t):
    path = scratch_path(t.spark, "master")
    for run, part in enumerate(halves(t)):
        for _ in range(2):  # a repeated run is stored once
            io.append_master(part, path, f"run-{run}")
    return io.read_master(t.spark, path).select("dedup_key", "id")


@query("bulk_load", "raw", INSERTED)
def _(t):
    master, batch = halves(t)
    path = scratch_path(t.spark, "bulk_csv")
    io.write_csv(batch, path)
    return K.insert_if_absent(master, io.scan_csv(t.spark, path, batch.schema), batch.columns).select("dedup_key", "id")


@query("export_features", "raw", f"{BEST % 'WHERE length(job_title) >= 3'} SELECT id, dedup_key FROM best")
def _(t):
    path = scratch_path(t.spark, "export")
    io.export_features(C.clean_jobs(t.raw), lambda jobs: FT.fit_transform(jobs, keep=["id"])[1], path)
    features = t.spark.read.parquet(f"{path}/features").select("id")
    return features.join(t.spark.read.parquet(f"{path}/cleaned").select("id", "dedup_key"), "id")


@query("encoder_roundtrip", "jobs", " UNION ALL ".join(
    f"SELECT '{c}' AS encoder, CAST({c} AS STRING) AS \"value\", {D.money('avg(salary_usd_numeric)')} AS target_mean FROM jobs GROUP BY {c}"
    for c in FT.ENCODED))
def _(t):
    path = scratch_path(t.spark, "encoders")
    FT.fit(t.jobs).save(t.spark, path)
    back = FT.Encoders.load(t.spark, path)
    out = None
    for column, table in back.means.items():
        part = table.select(F.lit(column).alias("encoder"), F.col(column).alias("value"),
                            F.round(F.col("target_mean").cast("decimal(28,8)"), 2).cast("double").alias("target_mean"))
        out = part if out is None else out.unionByName(part)
    return out


# --- saved items --------------------------------------------------------------

NEWEST = "row_number() OVER (PARTITION BY {keys} ORDER BY created_at DESC, id DESC)"
FAVORITES = f"WITH fav AS (SELECT * FROM history WHERE kind <> 'error' QUALIFY {NEWEST.format(keys='user_id, job_id')} = 1)"


def favorites(t):
    return H.favorites_upsert(t.history.where("kind <> 'error'"))


@query("favorites_upsert", "history", FAVORITES + " SELECT user_id, job_id, id, payload FROM fav")
def _(t):
    return favorites(t).select("user_id", "job_id", "id", "payload")


@query("favorites_delete", "history", FAVORITES + """ SELECT user_id, job_id, id FROM fav
    WHERE (user_id, job_id) NOT IN (SELECT user_id, job_id FROM history WHERE kind = 'error')""")
def _(t):
    return H.favorites_delete(favorites(t), t.history.where("kind = 'error'")).select("user_id", "job_id", "id")


@query("favorite_semi", "history", """SELECT id, (user_id, job_id) IN (SELECT user_id, job_id FROM history WHERE kind = 'purchase') AS is_favorite
    FROM history WHERE kind = 'view'""")
def _(t):
    return H.favorite_flag(t.history.where("kind = 'view'"), t.history.where("kind = 'purchase'")).select("id", "is_favorite")


@query("latest_per_user", "history", f"SELECT user_id, id, kind, {NEWEST.format(keys='user_id')} AS position FROM history QUALIFY position <= 20")
def _(t):
    return H.latest_per_user(t.history).select("user_id", "id", "kind", "position")


@query("latest_favorites", "history", f"{FAVORITES} SELECT user_id, id, {NEWEST.format(keys='user_id')} AS position FROM fav QUALIFY position <= 50")
def _(t):
    return H.latest_per_user(favorites(t), H.LIMITS["favorites"]).select("user_id", "id", "position")


@query("history_append", "history", "SELECT id, user_id, TRY_CAST(payload->>'k' AS BIGINT) AS k FROM history")
def _(t):
    path = scratch_path(t.spark, "history")
    items = t.history.select("id", "user_id", F.from_json("payload", "k bigint").alias("payload"), "created_at")
    H.append_history(items, ["payload"], path)
    back = H.read_history(t.spark, path, "id bigint, user_id bigint, payload string, created_at timestamp", {"payload": "k bigint"})
    return back.select("id", "user_id", F.col("payload.k").alias("k"))


# --- crawled pages ------------------------------------------------------------
# The expected rows follow from how the page text was built, not from reading it.

ARRANGED = "CASE page_id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'On-site' END"
PLACE_COST = D.case("place", V.CITY_COST, V.CITY_COST_DEFAULT)


PAGE_JSON = f"""WITH j AS (
    SELECT page_id, 'Senior Engineer ' || (page_id % 7) AS job_title, 'Austin' AS location, 120000 + page_id AS pay, {V.SENIORITY_TITLE_WORDS[2][0]!r} AS seniority_level,
      {ARRANGED} AS remote_type, 'j' || page_id || '-1' AS job_id, location AS place FROM crawl WHERE page_id % 5 <> 4
    UNION ALL SELECT page_id, 'Data Analyst', location, 85000 + page_id, {V.MID!r}, 'On-site', 'j' || page_id || '-2', location
      FROM crawl WHERE page_id % 5 <> 4 AND page_id % 9 <> 0)
    SELECT page_id, job_title, 'Company ' || (page_id % 50) AS company_name, location, {D.salary_label('pay')} AS salary, seniority_level,
      remote_type, job_id, {D.key_of("'levelsfyi'", "'Company ' || (page_id % 50)", 'job_title', 'job_id')} AS dedup_key,
      {PLACE_COST} AS cost_of_living_index FROM j"""


@query("page_json_jobs", "crawl", PAGE_JSON)
def _(t):
    out = P.embedded_jobs(t.pages).withColumn("_place", F.col("location"))
    return out.select("page_id", "job_title", "company_name", "location", "salary", "seniority_level", "remote_type", "job_id",
                      "dedup_key", "cost_of_living_index")


PAGE_ANCHOR = f"""WITH a AS (
    SELECT page_id, keyword, location, 'Acme ' || (page_id % 20) || ' Inc' AS company_name, (90000 + page_id * 10)::DOUBLE AS pay FROM crawl WHERE page_id % 4 <> 3
    UNION ALL SELECT page_id, keyword, location, 'Acme ' || (page_id % 20 + 100) || ' Inc', 101000 + page_id FROM crawl WHERE page_id % 4 <> 3
    UNION ALL SELECT page_id, keyword, location, NULL, round_even((80000 + page_id) * usd_rate, 0) FROM crawl WHERE page_id % 4 = 3)
    SELECT page_id, {D.title_case('keyword')} AS job_title, company_name, location, {D.salary_label('pay')} AS salary,
      {D.infer_seniority('keyword')} AS seniority_level,
      {D.key_of("'payscale'", 'company_name', 'keyword', 'location')} AS dedup_key FROM a"""


@query("page_anchor_jobs", "crawl", PAGE_ANCHOR)
def _(t):
    return P.anchor_jobs(t.pages).select("page_id", "job_title", "company_name", "location", "salary", "seniority_level", "dedup_key")


@query("page_salary_range", "crawl", """SELECT page_id, (60 + page_id % 40) * 1000 AS range_min, (110 + page_id % 40) * 1000 AS range_max FROM crawl""")
def _(t):
    return P.page_salary_range(t.pages)


PAGE_CARD = f"""SELECT page_id, 'Senior Data Engineer ' || (page_id % 6) AS job_title, 'Acme ' || (page_id % 30) AS company_name,
    'Town ' || (page_id % 8) AS location, {D.salary_label("(85 + page_id % 50) * 1000 * usd_rate")} AS salary,
    (page_id % 6 + 2) || '+ years' AS experience_required, CASE WHEN page_id % 2 = 0 THEN 'Remote' ELSE 'On-site' END AS remote_type,
    CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS has_bonus, 'Python, Spark' AS skills_required,
    {D.key_of("'Acme ' || (page_id % 30)", "'Senior Data Engineer ' || (page_id % 6)", 'location')} AS dedup_key FROM crawl"""


@query("page_card_jobs", "crawl", f"""SELECT *, dedup_key AS job_id, 'ZipRecruiter' AS source_website, 'USD' AS salary_currency,
    CASE WHEN page_id % 2 = 0 THEN 'http://example.org' ELSE 'https://www.ziprecruiter.com' END || '/view/' || page_id AS job_link FROM ({PAGE_CARD})""")
def _(t):
    return P.card_jobs(t.pages).select("page_id", "job_title", "company_name", "location", "salary", "experience_required",
                                       "remote_type", "has_bonus", "skills_required", "dedup_key", "job_id", "source_website",
                                       "salary_currency", "job_link")


# identities from the fields themselves; a card is searched for by the page's place
COLLECTED = f"""WITH u AS (
    SELECT page_id, job_title, company_name, salary, 'Levels.fyi' AS source_website, ('levelsfyi', company_name, job_title, job_id) AS ident FROM ({PAGE_JSON})
    UNION ALL SELECT page_id, job_title, company_name, salary, 'PayScale', ('payscale', coalesce(company_name, ''), job_title, location) FROM ({PAGE_ANCHOR})
    UNION ALL SELECT page_id, job_title, company_name, salary, 'ZipRecruiter', ('', company_name, job_title, place)
      FROM ({PAGE_CARD}) JOIN (SELECT page_id, location AS place FROM crawl) USING (page_id))
    SELECT page_id, job_title, company_name, salary, source_website FROM u
    QUALIFY row_number() OVER (PARTITION BY lower(ident::VARCHAR) ORDER BY CASE WHEN salary IS NULL THEN 1 ELSE 0 END, page_id, job_title) = 1"""


@query("page_store", "crawl", COLLECTED)
def _(t):
    """Pages to conformed, deduplicated, stored listings; the second and the repeated run add nothing."""
    path = scratch_path(t.spark, "listings")
    for run in ("first", "first", "second"):
        P.store_listings(t.pages, path, run)
    return io.read_master(t.spark, path).select("page_id", "job_title", "company_name", "salary", "source_website")


@query("page_salary_scan", "crawl", """SELECT page_id, round_even(CASE WHEN page_id % 6 = 1 THEN (30 + page_id % 20) * 2080
    ELSE 80000 + page_id END * usd_rate, 0) AS salary_usd FROM crawl""")
def _(t):
    return P.page_salary_scan(t.pages).select("page_id", "salary_usd")


def symbol(c: str) -> str:
    return f"CASE WHEN {D.contains_any(c, V.PAY_SYMBOLS)} THEN {c} END"


DETAIL_PAY = ", ".join(D.salary_from_text(x, "usd_rate") for x in ("cs", "ds", "body"))
LEVEL = D.infer_seniority("job_title")


@query("detail_enrich", "details", f"""WITH d AS (SELECT *, {symbol('card_salary')} AS cs, {symbol('detail_salary')} AS ds,
      CASE WHEN length({D.clean_text('description')}) > 50 THEN {D.clean_text('description')} END AS body FROM details)
    SELECT id, {D.salary_label(f'coalesce({DETAIL_PAY})')} AS salary,
      coalesce({D.ordered_type('card_snippet', V.DETAIL_EMPLOYMENT)}, {D.ordered_type('detail_snippet', V.DETAIL_EMPLOYMENT)},
        {D.ordered_type('body', V.SIMPLE_EMPLOYMENT)}) AS employment_type,
      {D.remote('body')} AS remote_type, {D.education('body')} AS education_required,
      {D.flag(D.has('body', V.META_EQUITY))} AS has_equity, {D.extract_skills('body')} AS skills_required,
      coalesce({D.experience('body')}, {D.case(LEVEL, V.SENIORITY_EXPERIENCE)}) AS experience_required,
      nullif(regexp_extract(job_link, 'jk=([a-f0-9]+)', 1), '') AS job_id,
      CASE WHEN {D.contains_any('lower(date_text)', V.DATE_WORDS)} THEN date_text END AS date_posted_raw FROM d""")
def _(t):
    return P.detail_enrich(t.details).select("id", "salary", "employment_type", "remote_type", "education_required", "has_equity",
                                             "skills_required", "experience_required", "job_id", "date_posted_raw")


# --- streams ------------------------------------------------------------------

@query("incremental_merge", "jobs", f"""SELECT {D.key_of('company_name', 'job_title', 'city')} AS dedup_key, id, salary FROM jobs
    QUALIFY row_number() OVER (PARTITION BY {PARTS}
      ORDER BY CASE WHEN salary IS NULL THEN 1 ELSE 0 END, id) = 1""")
def _(t):
    path = scratch_path(t.spark, "accumulate")
    ST.accumulate(t.jobs_stream(), f"{path}/table", f"{path}/checkpoint", ["id"])
    return ST.current_master(t.spark, f"{path}/table").select("dedup_key", "id", "salary")


@query("stream_insert", "jobs", f"""SELECT {D.key_of('company_name', 'job_title', 'city')} AS dedup_key, id FROM jobs
    QUALIFY row_number() OVER (PARTITION BY {PARTS} ORDER BY id) = 1""")
def _(t):
    path = scratch_path(t.spark, "insert")
    ST.insert_new(t.jobs_stream(), f"{path}/table", f"{path}/checkpoint", ["id"])
    return ST.read_table(t.spark, f"{path}/table").select("dedup_key", "id")


@query("stream_dedup", "", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    path = scratch_path(t.spark, "first_seen")
    ST.store_first_seen(t.stream("events"), ["user_id", "event_type"], f"{path}/table", f"{path}/checkpoint", ["event_id"])
    return ST.read_table(t.spark, f"{path}/table", "_key").select("user_id", "event_type")


@query("stream_dedup_state", "", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    path = scratch_path(t.spark, "first_seen_state")
    ST.first_seen_by_state(t.stream("events"), ["user_id", "event_type"], f"{path}/table", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/table").select("user_id", "event_type")


@query("stream_health", "health", f"SELECT source, {HEALTH} FROM health GROUP BY source")
def _(t):
    from ..sources.views import HEALTH as COLUMNS, project

    path = scratch_path(t.spark, "health")
    ST.running_health(project(t.stream("events"), COLUMNS), f"{path}/table", f"{path}/checkpoint")
    return ST.latest_batch(t.spark, f"{path}/table")


# --- models -------------------------------------------------------------------
# The shapes are small so that the check stays short; the library defaults are larger.

SMALL = {
    "random_forest": lambda: MD.random_forest(trees=20, depth=6),
    "boosted_trees": lambda: MD.boosted_trees(rounds=8, depth=4, step=0.1),
}


@lru_cache(maxsize=4)
def trained(spark, sf_dir):
    from ..sources.views import Tables

    t = Tables(spark, sf_dir)
    return MD.train(spark, t.jobs, scratch_path(spark, "train"), SMALL)


def model(t):
    return trained(t.spark, t.sf_dir)


def vectors(t):
    encoders, table = FT.fit_transform(t.jobs, keep=["id", MD.PAY])
    path = scratch_path(t.spark, "vectors")
    MD.assemble(MD.training_rows(table), encoders.feature_columns, ["id", MD.PAY]).write.parquet(path)
    return t.spark.read.parquet(path), encoders.feature_columns


def fit_and_score(t, estimator, name):
    rows, _ = vectors(t)
    fitted = estimator.fit(rows.where(MD.split_column()))
    scored = fitted.transform(rows.where(~MD.split_column())).select(
        F.lit(name).alias("model"), F.col(MD.PAY).alias("y"), F.col("prediction").alias("pred"))
    return MD.regression_metrics(scored, ["model"])


TRAINING = f"salary_usd_numeric BETWEEN {V.TRAINING_PAY_RANGE[0]} AND {V.TRAINING_PAY_RANGE[1]}"
IS_TRAIN = f"CAST('0x' || substr(md5(id || ':{MD.SEED}'), 1, 8) AS BIGINT) % 10 < 8"


@query("train_test_split", "jobs", f"SELECT id, {IS_TRAIN} AS is_train FROM jobs WHERE {TRAINING}")
def _(t):
    return MD.training_rows(t.jobs).select("id", MD.split_column().alias("is_train"))


TEST_ROWS = f"SELECT 'NAME' AS model, count(*) AS \"rows\", TRUE AS mae_within_rmse FROM jobs WHERE {TRAINING} AND NOT ({IS_TRAIN})"


def checked_fit(t, name):
    scores = fit_and_score(t, SMALL[name](), name)
    return scores.select("model", "rows", (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"))


@query("train_rf", "jobs", TEST_ROWS.replace("NAME", "random_forest"))
def _(t):
    return checked_fit(t, "random_forest")


@query("train_gbt", "jobs", TEST_ROWS.replace("NAME", "boosted_trees"))
def _(t):
    return checked_fit(t, "boosted_trees")


PLAIN_FEATURES = ["company_rating", "has_equity", "has_bonus", "title_length"]
BOOST_L2 = 1.0


def plain_vectors(t, missing: float = float("nan")):
    """Four features that need no encoder."""
    rows = MD.training_rows(t.jobs).withColumn("title_length", F.length("job_title"))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c) for c in PLAIN_FEATURES]
    return MD.assemble(rows.select("id", MD.PAY, *values), PLAIN_FEATURES, ["id", MD.PAY])


#: Every split of the root by plain SQL: sums per value, running sums, gain.
ROOT_SPLITS = f"""rows_ AS (SELECT id, salary_usd_numeric AS y, {IS_TRAIN} AS is_train, CAST(company_rating AS DOUBLE) AS company_rating,
      CAST(has_equity AS DOUBLE) AS has_equity, CAST(has_bonus AS DOUBLE) AS has_bonus, CAST(length(job_title) AS DOUBLE) AS title_length
    FROM jobs WHERE {TRAINING}),
  start AS (SELECT CAST(avg(CAST(y AS DECIMAL(18,4))) AS DOUBLE) AS init FROM rows_ WHERE is_train),
  long AS ({' UNION ALL '.join(f"SELECT id, '{c}' AS feature, {i} AS place, {c} AS v, CAST(init - y AS DECIMAL(18,4)) AS g FROM rows_, start WHERE is_train"
                               for i, c in enumerate(PLAIN_FEATURES))}),
  known AS (SELECT feature, place, coalesce(v, min(v) OVER (PARTITION BY feature)) AS v, g FROM long),
  sums AS (SELECT feature, place, v, sum(g) AS g, count(*) AS h FROM known GROUP BY feature, place, v),
  upto AS (SELECT feature, place, v AS cut, CAST(sum(g) OVER w AS DOUBLE) AS lg, CAST(sum(h) OVER w AS DOUBLE) AS lh,
      CAST(sum(g) OVER p AS DOUBLE) AS ag, CAST(sum(h) OVER p AS DOUBLE) AS ah FROM sums
    WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
  splits AS (SELECT *, (lg * lg / (lh + {BOOST_L2}) + (ag - lg) * (ag - lg) / (ah - lh + {BOOST_L2}) - ag * ag / (ah + {BOOST_L2})) / 2 AS gain
    FROM upto WHERE lh >= 1 AND ah - lh >= 1),
  best AS (SELECT * FROM splits ORDER BY gain DESC, place, cut LIMIT 1)"""


@query("boost_root_splits", "jobs", f"""WITH {ROOT_SPLITS} SELECT feature, cut, CAST(lh AS BIGINT) AS left_rows,
    round(gain / (SELECT gain FROM best), 6) AS gain_share, gain = (SELECT gain FROM best) AS is_best FROM splits""")
def _(t):
    """Every split of the first node with its share of the best gain."""
    rows = plain_vectors(t).where(MD.split_column()).withColumn("values", vector_to_array("features"))
    start = rows.agg(F.avg(F.col(MD.PAY).cast(BO.GRADIENT)).cast("double").alias("init"))
    edges = BO.bin_edges(rows, "values", 32)
    binned = rows.select(MD.PAY, BO.to_bins(F.col("values"), edges).alias("bins")).join(start)
    loss = BO.Loss()
    sums = BO.level_sums(binned, F.lit(1), loss.gradient(F.col(MD.PAY), F.col("init")), loss.curvature(F.col(MD.PAY), F.col("init")),
                         list(range(len(edges))))
    splits = BO.candidate_splits(sums, BOOST_L2)
    best = BO.best_splits(splits).select(F.col("gain").alias("best"))
    return splits.join(best).select(
        F.get(F.array(*map(F.lit, PLAIN_FEATURES)), "feature").alias("feature"),
        F.get(F.get(BO.constant(edges, "array<array<double>>"), F.col("feature")), F.col("bin").cast("int")).alias("cut"),
        F.col("left_h").cast("bigint").alias("left_rows"), F.round(F.col("gain") / F.col("best"), 6).alias("gain_share"),
        (F.col("gain") == F.col("best")).alias("is_best"))


STUMP = f"""WITH {ROOT_SPLITS},
  leaf AS (SELECT feature, cut, -lg / (lh + {BOOST_L2}) AS low, -(ag - lg) / (ah - lh + {BOOST_L2}) AS high FROM best),
  test AS (SELECT id, y, CASE (SELECT feature FROM leaf) {' '.join(f"WHEN '{c}' THEN {c}" for c in PLAIN_FEATURES)} END AS v FROM rows_ WHERE NOT is_train),
  scored AS (SELECT id, y, init + CASE WHEN v > cut THEN high ELSE low END AS pred, md5(id || ':pair:{MD.SEED}') AS digest FROM test, leaf, start),
  grouped AS (SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % ((SELECT count(*) FROM scored) // 1000 + 1) AS grp FROM scored),
  paired AS (SELECT *, coalesce(lead(pred) OVER (PARTITION BY grp ORDER BY digest), first_value(pred) OVER (PARTITION BY grp ORDER BY digest)) AS donor
    FROM grouped),
  errors AS (SELECT avg((pred - y) * (pred - y)) AS base, avg((donor - y) * (donor - y)) AS moved FROM paired)"""


@query("permutation_importance", "jobs", f"""{STUMP} SELECT f.feature, round(sqrt(base), 2) AS base_rmse,
    round(CASE WHEN f.feature = leaf.feature THEN moved / base ELSE 1 END, 6) AS error_ratio
    FROM errors, leaf, (SELECT unnest({PLAIN_FEATURES}) AS feature) f""")
def _(t):
    """Error with one column shuffled against the error as it is, for a model of one split on the held-out rows."""
    rows = plain_vectors(t)
    stump = BO.SecondOrderBoosting(rounds=1, depth=1, step=1.0, l2=BOOST_L2, sample=1.0, columns=1.0).fit(rows.where(MD.split_column()))
    out = MD.permutation_importance(rows.where(~MD.split_column()), stump, PLAIN_FEATURES)
    return out.select("feature", F.round(F.sqrt("base_mse"), 2).alias("base_rmse"), F.round(F.col("permuted_mse") / F.col("base_mse"), 6).alias("error_ratio"))


@query("permutation_report")
def _(t):
    """Permutation importances of the trained model over all its features, on the held-out rows."""
    m = model(t)
    rows = MD.assemble(FT.transform(MD.training_rows(t.jobs).where(~MD.split_column()), m.encoders, ["id", MD.PAY]), m.columns, ["id", MD.PAY])
    return MD.permutation_importance(rows, m.model, m.columns)


@query("train_second_order", "jobs", TEST_ROWS.replace("NAME", "second_order"))
def _(t):
    scores = fit_and_score(t, BO.SecondOrderBoosting(rounds=6, depth=4, step=0.3), "second_order")
    return scores.select("model", "rows", (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"))


@query("compare_candidates", "jobs", " UNION ALL ".join(TEST_ROWS.replace("NAME", n) for n in ("random_forest", "boosted_trees", "second_order")))
def _(t):
    """Both families of boosted trees and the forest on the same stored vectors."""
    rows, _ = vectors(t)
    fit_rows, test_rows = rows.where(MD.split_column()), rows.where(~MD.split_column())
    makers = SMALL | {"second_order": lambda: BO.SecondOrderBoosting(rounds=6, depth=4, step=0.3)}
    parts = [make().fit(fit_rows).transform(test_rows).select(F.lit(n).alias("model"), F.col(MD.PAY).alias("y"), F.col("prediction").alias("pred"))
             for n, make in makers.items()]
    scores = MD.regression_metrics(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["model"])
    return scores.select("model", "rows", (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"))


@query("grid_search")
def _(t):
    rows, _ = vectors(t)
    fitted = MD.grid_search(rows.where(MD.split_column()), rounds=(2,), depths=(2, 3), steps=(0.1,), samples=(0.8,), folds=3)
    return t.spark.createDataFrame(MD.grid_scores(fitted), "params string, mse double")


@query("grid_search_halving")
def _(t):
    """All sixteen points with few rounds, the best four with more, the best one with all."""
    path = scratch_path(t.spark, "grid")
    plain_vectors(t, 0.0).where(MD.split_column()).write.parquet(path)
    points = MD.grid_points(rounds=(6, 8), depths=(2, 3), steps=(0.1, 0.3))
    return MD.halving_search(t.spark.read.parquet(path), points).table(t.spark)


@query("feature_importance")
def _(t):
    m = model(t)
    return MD.feature_importance(t.spark, m.model, m.columns)


@query("batch_predict", "jobs", "SELECT id, TRUE AS is_amount FROM jobs")
def _(t):
    return model(t).predict(t.jobs, ["id"]).select("id", F.coalesce(F.col("prediction") >= 0, F.lit(False)).alias("is_amount"))


@query("predict_band", "jobs", "SELECT id, TRUE AS in_order, TRUE AS is_percentile FROM jobs")
def _(t):
    band = model(t).predict_band(t.jobs, ["id"])
    value = F.col("predicted_salary_usd")
    return band.select("id", ((F.col("confidence_low") <= value) & (value <= F.col("confidence_high"))).alias("in_order"),
                       F.col("percentile").between(1, 99).alias("is_percentile"))


@query("model_roundtrip", "jobs", "SELECT id, TRUE AS same FROM jobs")
def _(t):
    path = scratch_path(t.spark, "model")
    model(t).save(t.spark, path)
    fresh = model(t).predict(t.jobs, ["id"]).withColumnRenamed("prediction", "fresh")
    stored = MD.SalaryModel.load(t.spark, path).predict(t.jobs, ["id"])
    return fresh.join(stored, "id").select("id", (F.abs(F.col("fresh") - F.col("prediction")) < 0.01).alias("same"))


@query("run_log", "jobs", f"""SELECT CAST(run_id AS INTEGER) AS run_id, n AS "rows" FROM
    (SELECT count(*) AS n FROM jobs WHERE {TRAINING}), (SELECT unnest([1, 2]) AS run_id)""")
def _(t):
    path = scratch_path(t.spark, "runs")
    m = model(t)
    rows = MD.training_rows(t.jobs).count()
    MD.log_run(t.spark, path, m, rows)
    return MD.log_run(t.spark, path, m, rows).select("run_id", "rows")


def run_training(t, previous_r2):
    """Report of the whole job, with how many models and runs it stored."""
    path = scratch_path(t.spark, "training")
    report = MD.training_job(t.spark, C.clean_jobs(t.raw), path, SMALL, previous_r2=previous_r2)
    stored = report.first()["promoted"]
    runs = MD.read_runs(t.spark, f"{path}/runs").count() if stored else 0
    if stored:
        MD.SalaryModel.load(t.spark, f"{path}/model")
    return report.select("promoted", "salary_rows").withColumn("runs", F.lit(runs).cast("bigint"))


def outcome(promoted, runs):
    return f"{CLEANED} SELECT {promoted} AS promoted, count(salary_usd_numeric) AS salary_rows, CAST({runs} AS BIGINT) AS runs FROM clean"



@query("train_job", "raw", outcome("TRUE", 1))
def _(t):
    """Nothing to compare with: the new model is promoted, stored and logged."""
    return run_training(t, None)


@query("train_job_sources", "bulk raw", f"""{LOADED}, u AS (SELECT 0 AS src, {IDENTITY} AS identity FROM loaded
    UNION ALL SELECT 1, {IDENTITY} FROM raw)
    SELECT 'bulk+collected' AS source, TRUE AS promoted, TRUE AS features_stored, count(DISTINCT identity) AS merged_rows FROM u""")
def _(t):
    """From bulk and collected rows to a stored model, feature table, statistics and run record."""
    path = scratch_path(t.spark, "training")
    report = MD.train_from_sources(t.spark, t.bulk, t.raw, path, candidates=SMALL)
    stored = MD.SalaryModel.load(t.spark, f"{path}/model")
    features = t.spark.read.parquet(f"{path}/features").count() == t.spark.read.parquet(f"{path}/cleaned").count()
    merged = MD.load_training_rows(t.bulk, t.raw).agg(F.count(F.lit(1)).alias("merged_rows"))
    return merged.select(F.lit(stored.facts["source"]).alias("source"), F.lit(report.first()["promoted"]).alias("promoted"),
                         F.lit(features).alias("features_stored"), "merged_rows")


@query("model_facts", "jobs", f"""SELECT count(*) AS training_rows, min(salary_usd_numeric) AS salary_min, max(salary_usd_numeric) AS salary_max,
    {D.money('avg(salary_usd_numeric)')} AS salary_mean, round(quantile_cont(salary_usd_numeric, 0.1), 4) AS p10,
    round(quantile_cont(salary_usd_numeric, 0.9), 4) AS p90 FROM jobs WHERE {TRAINING} AND {IS_TRAIN}""")
def _(t):
    """Statistics of the training pay as they are stored with the model."""
    path = scratch_path(t.spark, "model")
    model(t).save(t.spark, path)
    back = t.spark.read.parquet(f"{path}/version=*/metadata")
    return back.select("training_rows", "salary_min", "salary_max", F.round(F.col("salary_mean").cast("decimal(28,8)"), 2).cast("double").alias("salary_mean"),
                       *[F.round(F.element_at("percentiles", p), 4).alias(p) for p in ("p10", "p90")])


@query("train_job_blocked", "raw", outcome("FALSE", 0))
def _(t):
    """A stored model that is better blocks the new one."""
    return run_training(t, 0.999)


@query("boosted_salary")
def _(t):
    from ..operators.lookups import skill_bonuses, total_premium
    from ..operators.scoring import boosted

    scores = MD.score_requests(requests(t), model(t))
    premium = requests(t).select("request_id", total_premium(skill_bonuses(F.col("skills"))).alias("total_skill_premium"))
    return scores.join(premium, "request_id").withColumn("boosted_salary_usd", boosted(
        F.col("model_usd"), F.col("model_no_skills_usd"), F.col("total_skill_premium")))


@query("prediction_report")
def _(t):
    out = MD.prediction_report(requests(t), model(t), t.jobs)
    return out.select("request_id", "predicted_salary_usd", "confidence_low", "confidence_high", "similar_jobs_count",
                      F.to_json("similar_jobs").alias("similar_jobs"), "model_name", "model_rmse")
