"""Lookup, feature, scoring and similarity queries."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import features as FT
from ..operators import lookups as L
from ..operators import models as MD
from ..operators import ranks as RK
from ..operators import scoring as SC
from ..operators import similar as SM
from . import duck as D
from .registry import query


def skill_array(c="skills"):
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda s: s != "")


def requests(t):
    return t.offers.withColumn("skills", skill_array())


def resumes(t):
    return t.resumes.withColumn("skills", skill_array())


# --- lookups ------------------------------------------------------------------

NAMES = [c[0] for c in V.CITIES]


def placed(t):
    """Jobs moved to the search cities by nation number, so that the lookups hit."""
    number = F.element_at(F.split("city", "_"), -1).cast("int")
    names = F.array(*[F.lit(c) for c in NAMES])
    return t.jobs.withColumn("city", F.coalesce(F.get(names, number), F.col("city")))


PLACED = "WITH placed AS (SELECT * REPLACE (CASE " + " ".join(
    f"WHEN city = 'NATION_{i}' THEN {D.q(c)}" for i, c in enumerate(NAMES)) + " ELSE city END AS city) FROM jobs)"


@query("stamp_city", "jobs", PLACED + " SELECT id, city, " + ", ".join(
    f"{D.case('city', {c[0]: c[i] for c in V.CITIES})} AS {n}" for i, n in ((1, "city_display"), (2, "city_currency"))) +
       f", {D.case('city', {c[0]: c[3] for c in V.CITIES})}::DOUBLE AS usd_rate FROM placed")
def _(t):
    return L.stamp_city(placed(t)).select("id", "city", "city_display", "city_currency", "usd_rate")


@query("col_index_city", "jobs", f"{PLACED} SELECT id, {D.case('city', V.CITY_COST, V.CITY_COST_DEFAULT)} AS col_index FROM placed")
def _(t):
    return L.col_index_city(placed(t)).select("id", "col_index")


@query("seniority_score", "jobs", f"SELECT id, {D.seniority_score('seniority_level')} AS seniority_score FROM jobs")
def _(t):
    return L.seniority_score(t.jobs).select("id", "seniority_score")


@query("skill_premium_join", "offers", f"SELECT request_id, {D.total_premium('skills')} AS total_skill_premium FROM offers")
def _(t):
    return L.skill_premium_join(requests(t)).select("request_id", F.col("total_skill_premium").cast("bigint").alias("total_skill_premium"))


@query("company_tier", "offers", f"SELECT request_id, {D.company_tier('company_name')} AS tier FROM offers")
def _(t):
    return t.offers.select("request_id", L.company_tier(F.col("company_name")).alias("tier"))


PREMIUMS = ", ".join(f"({i}, {D.q(s)}, {v})" for i, (s, v) in enumerate(V.SKILL_PREMIUMS.items()))
MISSING = f"""WITH premium(rank, skill, lift) AS (VALUES {PREMIUMS}),
    open AS (SELECT resume_id, skill, lift, row_number() OVER (PARTITION BY resume_id ORDER BY lift DESC, rank) AS position
      FROM resumes, premium WHERE NOT list_contains([lower(s) for s in string_split(coalesce(skills, ''), ',')], lower(skill))
      QUALIFY position <= 5)"""


@query("skill_gap", "resumes", MISSING + """ SELECT resume_id, string_agg(skill, '|' ORDER BY position) AS missing_skills,
    CAST(sum(CASE WHEN position <= 3 THEN lift ELSE 0 END) AS BIGINT) AS estimated_top3_lift_usd FROM open GROUP BY resume_id""")
def _(t):
    return L.skill_gap(resumes(t)).select(
        "resume_id", F.array_join(F.transform("missing_skills", lambda m: m["skill"]), "|").alias("missing_skills"),
        F.col("estimated_top3_lift_usd").cast("bigint").alias("estimated_top3_lift_usd"))


@query("missing_skills_topk", "resumes", MISSING + " SELECT resume_id, position, skill, lift AS estimated_lift_usd FROM open")
def _(t):
    return L.missing_skills(resumes(t), "resume_id")


PRESETS = D.case("lower(s)", {s.lower(): s for s in V.PRESET_SKILLS})


@query("match_preset_skills", "offers", f"""SELECT request_id, array_to_string([p for p in
    [{PRESETS} for s in string_split(coalesce(skills, ''), ',')] if p IS NOT NULL], '|') AS matched FROM offers""")
def _(t):
    return requests(t).select("request_id", F.array_join(L.match_presets(F.col("skills")), "|").alias("matched"))


YEARS = D.coerce_years("experience_years")


@query("infer_title", "resumes", f"SELECT resume_id, {D.infer_title('text', 'skills')} AS title FROM resumes")
def _(t):
    return resumes(t).select("resume_id", L.infer_title(F.col("text"), F.col("skills")).alias("title"))


@query("resume_defaults", "resumes", f"""SELECT resume_id, {YEARS} AS experience_years, {D.years_to_seniority(YEARS)} AS seniority_level,
    CASE WHEN trim(coalesce(job_title, '')) = '' THEN {D.infer_title('text', 'skills')} ELSE job_title END AS job_title,
    'Full-time' AS employment_type, 'On-site' AS remote_type, FALSE AS has_equity, FALSE AS has_bonus FROM resumes""")
def _(t):
    return L.resume_defaults(resumes(t)).drop("text", "skills")


# --- features -----------------------------------------------------------------

NUMBERS = {
    "experience_midpoint": f"coalesce({D.experience_midpoint('experience_required', 'job_description')}, 0.0)",
    "seniority_score": D.seniority_score("seniority_level"),
    "description_word_count": D.word_count("job_description"),
    "skill_count": "CASE WHEN coalesce(skills_required, '') = '' THEN 0 ELSE len(string_split(skills_required, ',')) END",
    "title_word_count": D.word_count("job_title"),
    "col_index": D.case("city", V.CITY_COST, V.CITY_COST_DEFAULT),
    "city_tier": D.city_tier("city", "country"),
    "exp_seniority_interaction":
        f"coalesce({D.experience_midpoint('experience_required', 'job_description')} * {D.seniority_score('seniority_level')}, 0.0)::DOUBLE",
    "company_rating": "coalesce(company_rating, {rating})::DOUBLE",
}
BOOLS = {
    **{c: (f"CAST(coalesce({c}, 0) AS INT)" if c != "is_faang" else "0") for c in V.STORED_FLAGS},
    **{name: f"(CASE WHEN regexp_matches(lower({c}), {D.q(p)}) THEN 1 ELSE 0 END)" for name, (c, p) in V.FLAG_PATTERNS.items()},
    **{name: D.flag(D.contains_any("lower(skills_required)", ws)) for name, ws in V.SKILL_CLUSTERS.items()},
}
SKILL_FLAGS = {FT.skill_column(s): D.flag(f"contains(lower(skills_required), {D.q(s.lower())})") for s in V.SKILLS}
SOURCE_FLAGS = {f"source_{s}": D.flag(f"contains(lower(source_website), '{s}')") for s in V.SOURCE_FLAGS}
CITY_FLAGS = {f"city_nation_{i}": D.flag(f"lower(city) = 'nation_{i}'") for i in range(25)}


def columns(table: dict) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in table.items())


def with_id(t, exprs):
    return t.select("id", *[e.alias(n) for n, e in exprs.items()])


@query("features_numeric", "jobs", f"SELECT id, {columns(NUMBERS).replace("{rating}", str(V.RATING_DEFAULT))} FROM jobs")
def _(t):
    jobs = FT.with_years(t.jobs)
    return with_id(jobs, FT.numeric_columns(jobs))


@query("city_tier", "jobs", f"""{PLACED} SELECT id, {D.city_tier('city', "CASE WHEN id % 2 = 0 THEN 'Canada' ELSE country END")} AS tier FROM placed""")
def _(t):
    country = F.when(F.col("id") % 2 == 0, "Canada").otherwise(F.col("country"))
    return placed(t).select("id", FT.city_tier(F.col("city"), country).alias("tier"))


@query("features_binary", "jobs", f"SELECT id, {columns(BOOLS)} FROM jobs")
def _(t):
    return with_id(t.jobs, FT.binary_columns(t.jobs))


@query("features_skills", "jobs", f"SELECT id, {columns(SKILL_FLAGS)} FROM jobs")
def _(t):
    return with_id(t.jobs, FT.skill_columns(t.jobs))


@query("features_city", "jobs", f"SELECT id, {columns(CITY_FLAGS)} FROM jobs")
def _(t):
    cities = [r["city"] for r in FT.top_cities(t.jobs).collect()]
    return with_id(t.jobs, FT.city_columns(t.jobs, cities))


@query("features_source", "raw", f"SELECT id, {columns(SOURCE_FLAGS)} FROM raw")
def _(t):
    return with_id(t.raw, FT.source_columns(t.raw))


MEANS = """WITH c AS (SELECT city, avg(salary_usd_numeric) m FROM jobs GROUP BY city), ti AS (SELECT job_title, avg(salary_usd_numeric) m FROM jobs GROUP BY job_title),
    ro AS (SELECT "role", avg(salary_usd_numeric) m FROM jobs GROUP BY "role"), g AS (SELECT avg(salary_usd_numeric) m, coalesce(avg(company_rating), 3.5) r FROM jobs)"""
ENCODED = {"city_target_encoded": "c.m", "title_target_encoded": "ti.m", "role_target_encoded": "ro.m"}
JOINED = "jobs LEFT JOIN c USING (city) LEFT JOIN ti USING (job_title) LEFT JOIN ro USING (\"role\"), g"


def cents(df, names):
    return df.withColumns({n: F.round(F.col(n).cast("decimal(28,8)"), 2).cast("double") for n in names})


@query("target_encode", "jobs", f"{MEANS} SELECT id, " + ", ".join(
    f"{D.money(f'coalesce({e}, g.m)')} AS {n}" for n, e in ENCODED.items()) + f" FROM {JOINED}")
def _(t):
    return cents(FT.target_encode(t.jobs, FT.fit(t.jobs), fitting=True).select("id", *ENCODED), ENCODED)


def rounded_numbers(rating: str) -> dict:
    return {n: (D.money(e.replace("{rating}", rating)) if n == "company_rating" else e) for n, e in NUMBERS.items()}


ALL = {**rounded_numbers("g.r"), **BOOLS, **SKILL_FLAGS, **{n: D.money(f"coalesce({e}, g.m)") for n, e in ENCODED.items()},
       **CITY_FLAGS, **SOURCE_FLAGS}


@query("features_fit", "jobs", f"{MEANS} SELECT id, {columns(ALL)} FROM {JOINED}")
def _(t):
    _, table = FT.fit_transform(t.jobs, keep=["id"])
    return cents(table, [*ENCODED, "company_rating"])


# encoders learned on the older postings, applied to all of them
OLD = "scraped_at < TIMESTAMP '1996-01-01 00:00:00'"
OLD_MEANS = f"""WITH old AS (SELECT * FROM jobs WHERE {OLD}),
    c AS (SELECT city, avg(salary_usd_numeric) m FROM old GROUP BY city), ti AS (SELECT job_title, avg(salary_usd_numeric) m FROM old GROUP BY job_title),
    ro AS (SELECT "role", avg(salary_usd_numeric) m FROM old GROUP BY "role"),
    g AS (SELECT (SELECT avg(m) FROM c) mc, (SELECT avg(m) FROM ti) mt, (SELECT avg(m) FROM ro) mr, coalesce(avg(company_rating), 3.5) r FROM old),
    seen AS (SELECT * REPLACE (CASE WHEN id % 20 = 0 THEN 'Elsewhere' ELSE city END AS city) FROM jobs)"""
SEEN = {"city_target_encoded": "coalesce(c.m, g.mc)", "title_target_encoded": "coalesce(ti.m, g.mt)",
        "role_target_encoded": "coalesce(ro.m, g.mr)"}
ALL_SEEN = {**rounded_numbers("g.r"), **BOOLS, **SKILL_FLAGS, **{n: D.money(e) for n, e in SEEN.items()}, **CITY_FLAGS, **SOURCE_FLAGS}


@query("features_transform", "jobs", f"{OLD_MEANS} SELECT id, {columns(ALL_SEEN)} FROM {JOINED.replace('jobs', 'seen', 1)}")
def _(t):
    encoders = FT.fit(t.jobs.where(F.expr(OLD)))
    fresh = t.jobs.withColumn("city", F.when(F.col("id") % 20 == 0, "Elsewhere").otherwise(F.col("city")))
    return cents(FT.transform(fresh, encoders, keep=["id"]), [*ENCODED, "company_rating"])


@query("request_rows", "offers", f"""SELECT request_id, job_title, job_title AS "role", city, seniority_level,
    CAST(experience_years AS STRING) || '+ years' AS experience_required, coalesce(education_required, '') AS education_required,
    CASE WHEN remote_type IN ('Remote', 'Hybrid') THEN 1 ELSE 0 END AS has_remote_benefits, replace(skills, ',', ', ') AS skills_required,
    {D.flag(f"lower(trim(company_name)) IN ({', '.join(D.q(n) for n in V.FAANG_NAMES)})")} AS is_faang, 80 AS cost_of_living_index FROM offers""")
def _(t):
    return FT.request_rows(requests(t)).select(
        "request_id", "job_title", "role", "city", "seniority_level", "experience_required", "education_required",
        "has_remote_benefits", "skills_required", "is_faang", "cost_of_living_index")


@query("top_cities", "jobs", """SELECT city, count(*) AS "count" FROM jobs GROUP BY city ORDER BY count(*) DESC, city LIMIT 100""")
def _(t):
    return FT.top_cities(t.jobs)


@query("salary_percentiles", "jobs", "SELECT count(salary_usd_numeric) AS n, " + ", ".join(
    f"{D.money(f'quantile_cont(salary_usd_numeric, {p / 100})')} AS p{p}" for p in FT.PERCENTS) + " FROM jobs")
def _(t):
    return cents(FT.salary_percentiles(t.jobs), [f"p{p}" for p in FT.PERCENTS])


@query("rating_mean", "jobs", "SELECT round(coalesce(avg(company_rating), 3.5), 6) AS rating_mean FROM jobs")
def _(t):
    return FT.rating_mean(t.jobs).select(F.round("rating_mean", 6).alias("rating_mean"))


@query("training_rows", "jobs", "SELECT id, salary_usd_numeric FROM jobs WHERE salary_usd_numeric BETWEEN 20000 AND 500000")
def _(t):
    return MD.training_rows(t.jobs).select("id", "salary_usd_numeric")


@query("training_salary_stats", "jobs", f"""SELECT min(salary_usd_numeric) AS salary_min, max(salary_usd_numeric) AS salary_max,
    {D.money('avg(salary_usd_numeric)')} AS salary_mean FROM jobs WHERE salary_usd_numeric BETWEEN 20000 AND 500000""")
def _(t):
    return cents(MD.salary_stats(MD.training_rows(t.jobs)), ["salary_mean"])


@query("salary_percentile_rank", "jobs predictions", """WITH tr AS (SELECT salary_usd_numeric v FROM jobs WHERE salary_usd_numeric IS NOT NULL),
    cum AS (SELECT v, count(*) c, sum(count(*)) OVER (ORDER BY v) AS upto FROM tr GROUP BY v),
    d AS (SELECT DISTINCT pred FROM predictions),
    r AS (SELECT pred, coalesce(max(upto), 0) AS below FROM d LEFT JOIN cum ON v < pred GROUP BY pred)
    SELECT id, n, pred, greatest(1, least(99, CAST(trunc(below::DOUBLE / (SELECT count(*) FROM tr) * 100) AS INT))) AS percentile
    FROM predictions JOIN r USING (pred)""")
def _(t):
    p = t.predictions.select("id", "n", "pred")
    return RK.percentile_of(t.jobs, "salary_usd_numeric", p, "pred")


# --- metrics and gates --------------------------------------------------------

METRICS = """count(*) AS "rows", round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae,
    round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2"""


def rounded_metrics(df):
    return df.withColumns({"rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "r2": F.round("r2", 6)})


@query("regression_metrics", "predictions", f"SELECT model, {METRICS} FROM predictions GROUP BY model")
def _(t):
    return rounded_metrics(MD.regression_metrics(t.predictions, ["model"]))


@query("select_best", "predictions", f"SELECT model, {METRICS} FROM predictions GROUP BY model ORDER BY r2 DESC, model LIMIT 1")
def _(t):
    return rounded_metrics(MD.select_best(MD.regression_metrics(t.predictions, ["model"]), "model"))


@query("residual_std", "predictions", "SELECT model, round(stddev_pop(y - pred), 4) AS residual_std FROM predictions GROUP BY model")
def _(t):
    return MD.residual_std(t.predictions, ["model"]).withColumn("residual_std", F.round("residual_std", 4))


@query("promotion_gate", "predictions", f"""WITH m AS (SELECT model, {METRICS} FROM predictions GROUP BY model),
    b AS (SELECT max(r2) AS top FROM m)
    SELECT model, r2 AS new_r2, top AS old_r2, round(top - 0.02, 6) AS allowed_floor, r2 >= top - 0.02 AS promoted,
    CASE WHEN r2 >= top - 0.02 THEN 'ok' ELSE 'r2 below the allowed floor' END AS reason FROM m, b""")
def _(t):
    m = rounded_metrics(MD.regression_metrics(t.predictions, ["model"]))
    pairs = m.select("model", F.col("r2").alias("new_r2"), m.select(F.max("r2").alias("r")).scalar().alias("old_r2"))
    return MD.promotion_gate(pairs).withColumn("allowed_floor", F.round("allowed_floor", 6))


# --- request scoring ----------------------------------------------------------

def single(name, column, ours, sql):
    query(name, "offers", f"SELECT request_id, {sql} AS \"value\" FROM offers")(
        lambda t: t.offers.select("request_id", ours(F.col(column)).alias("value")))


single("employment_multiplier", "employment_type", SC.employment_multiplier, D.MULTIPLIER)
single("seniority_adjustment", "seniority_level", SC.seniority_adjustment, D.ADJUSTMENTS["seniority_adjustment"])
single("experience_adjustment", "experience_years", SC.experience_adjustment, D.ADJUSTMENTS["experience_adjustment"])
single("role_adjustment", "job_title", SC.role_adjustment, D.ADJUSTMENTS["role_adjustment"])
single("tier_bonus", "company_name", SC.tier_bonus, D.ADJUSTMENTS["company_tier_bonus"])


@query("city_adjustment", "jobs", f"{PLACED} SELECT id, {D.ADJUSTMENTS['city_adjustment']} AS adjustment FROM placed")
def _(t):
    return placed(t).select("id", SC.city_adjustment(F.col("city")).alias("adjustment"))


@query("education_remote_adjustment", "offers", f"""SELECT request_id, {D.ADJUSTMENTS['academic_bonus']} AS academic_bonus,
    {D.ADJUSTMENTS['remote_adjustment']} AS remote_adjustment FROM offers""")
def _(t):
    return t.offers.select("request_id", SC.education_adjustment(F.col("education_required")).alias("academic_bonus"),
                           SC.remote_adjustment(F.col("remote_type")).alias("remote_adjustment"))


ADDED = " + ".join(D.ADJUSTMENTS.values())
FINAL = f"""a AS (SELECT *, {ADDED} AS added, {D.MULTIPLIER} AS mult, {D.total_premium('skills')} AS premium FROM offers),
    f AS (SELECT *, greatest(25000, CAST(trunc(((CASE WHEN model_usd <> 0 THEN greatest(model_usd, model_no_skills_usd + premium * 0.5::DOUBLE)
      ELSE model_no_skills_usd END) + added) * mult) AS BIGINT)) AS predicted_salary_usd FROM a)"""


@query("final_prediction", "offers", f"""WITH {FINAL} SELECT request_id, predicted_salary_usd, premium AS total_skill_premium, mult AS employment_multiplier,
    CAST(trunc(predicted_salary_usd * (CASE WHEN model_usd <> 0 THEN 0.85 ELSE 0.8 END)::DOUBLE) AS BIGINT) AS confidence_low,
    CAST(trunc(predicted_salary_usd * (CASE WHEN model_usd <> 0 THEN 1.15 ELSE 1.2 END)::DOUBLE) AS BIGINT) AS confidence_high,
    CASE WHEN model_usd <> 0 THEN 'model_plus_market_heuristics' ELSE 'fallback_percentage_band' END AS confidence_method FROM f""")
def _(t):
    return SC.final_prediction(requests(t)).select(
        "request_id", "predicted_salary_usd", F.col("total_skill_premium").cast("bigint").alias("total_skill_premium"),
        "employment_multiplier", "confidence_low", "confidence_high", "confidence_method")


# --- comparable postings ------------------------------------------------------

KEYED = r"""keyed AS (SELECT request_id,
      coalesce([w for w in regexp_split_to_array(lower(job_title), '\W+') if length(w) >= 4][1], lower(job_title)) AS kw,
      trim(lower(split_part(city, ',', 1))) AS ci, trim(lower(split_part(seniority_level, '(', 1))) AS se FROM offers),
    combo AS (SELECT DISTINCT kw, ci, se FROM keyed),
    paid AS (SELECT id, salary_usd_numeric AS pay, lower(job_title) AS jt, lower(city) AS jc, lower(seniority_level) AS js
      FROM jobs WHERE salary_usd_numeric IS NOT NULL),
    strict AS (SELECT kw, ci, se, id, pay FROM combo JOIN paid ON contains(jt, kw) AND contains(jc, ci) AND contains(js, se)),
    loose AS (SELECT kw, ci, se, id, pay FROM (SELECT * FROM combo ANTI JOIN strict USING (kw, ci, se)) JOIN paid ON contains(jt, kw)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY kw, ci, se ORDER BY pay DESC, id) AS position
      FROM (SELECT * FROM strict UNION ALL SELECT * FROM loose))"""


def similar_sql(k: int) -> str:
    return f"""WITH {KEYED} SELECT request_id, position, id, pay AS salary_usd_numeric FROM keyed JOIN hits USING (kw, ci, se)
        WHERE position <= {k}"""


@query("similar_jobs", "offers jobs", similar_sql(5))
def _(t):
    return SM.similar_jobs(t.offers, t.jobs, 5).select("request_id", "position", "id", "salary_usd_numeric")


@query("similar_topk", "offers jobs", similar_sql(20))
def _(t):
    return SM.similar_jobs(t.offers, t.jobs, 20).select("request_id", "position", "id", "salary_usd_numeric")


MARKET = f"""{KEYED}, ref AS (SELECT kw, ci, se, CAST(trunc(percentile_disc(0.5) WITHIN GROUP (ORDER BY pay DESC)) AS BIGINT) AS market_salary_usd,
    CAST(count(*) AS INT) AS evidence_count FROM hits WHERE position <= 50 GROUP BY kw, ci, se),
    market AS (SELECT request_id, market_salary_usd, coalesce(evidence_count, 0) AS evidence_count FROM keyed LEFT JOIN ref USING (kw, ci, se))"""


@query("market_reference", "offers jobs", f"WITH {MARKET} SELECT * FROM market")
def _(t):
    return SM.market_reference(t.offers, t.jobs)


@query("offer_analysis", "offers jobs", f"""WITH {MARKET}, {FINAL},
    o AS (SELECT request_id, base_salary_usd + annual_bonus_usd + annual_equity_usd AS total_comp_usd,
      coalesce(nullif(market_salary_usd, 0), predicted_salary_usd) AS market_reference_usd, evidence_count, predicted_salary_usd
      FROM f JOIN market USING (request_id)),
    d AS (SELECT *, total_comp_usd - market_reference_usd AS difference_usd,
      round((total_comp_usd - market_reference_usd)::DOUBLE / market_reference_usd * 100, 1) AS difference_pct FROM o)
    SELECT *, CASE WHEN difference_pct >= 10 THEN 'strong' WHEN difference_pct >= -5 THEN 'fair' ELSE 'low' END AS verdict FROM d""")
def _(t):
    final = SC.final_prediction(requests(t)).select(
        "request_id", "predicted_salary_usd", "base_salary_usd", "annual_bonus_usd", "annual_equity_usd")
    out = SC.analyze_offers(final, SM.market_reference(t.offers, t.jobs))
    return out.select("request_id", "total_comp_usd", "market_reference_usd", "evidence_count", "predicted_salary_usd",
                      "difference_usd", "difference_pct", "verdict")
