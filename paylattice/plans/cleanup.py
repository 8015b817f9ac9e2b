"""Normalisation, cleaning, bulk load, deduplication and ingest queries."""

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import experience as E
from ..functions import metadata as M
from ..functions import salary as S
from ..functions import text as X
from ..operators import bulk as B
from ..operators import cleaning as C
from ..operators import dedup as K
from . import duck as D
from .registry import query

# --- one column rule per query ------------------------------------------------


def rule(name, view, column, ours, sql, key="id"):
    """Register ``key, value`` for a column rule over one view."""
    attr = {"crawl": "pages"}.get(view, view)
    query(name, view, f'SELECT {key} AS k, {sql} AS "value" FROM {view}')(
        lambda t: getattr(t, attr).select(F.col(key).alias("k"), ours(F.col(column)).alias("value")))


rule("clean_text", "raw", "job_title", X.clean_text, D.clean_text("job_title"))
rule("salary_normalize", "jobs", "salary", S.salary_usd, D.salary_usd("salary"))
rule("salary_number", "jobs", "salary", S.salary_number,
     D.number(f"nullif({D.rx('salary', f'({V.PAY_NUMBER})', 1)}, '')"))
rule("salary_format", "jobs", "salary_usd_numeric", S.salary_label, D.salary_label("salary_usd_numeric"))
rule("strip_salary", "details", "description", S.strip_pay, D.strip_pay("description"))
rule("experience_extract", "jobs", "job_description", E.experience, D.experience("job_description"))
rule("seniority_infer", "jobs", "job_title", E.infer_seniority, D.infer_seniority("job_title"))
rule("seniority_experience", "jobs", "seniority_level", E.seniority_experience,
     D.case("seniority_level", V.SENIORITY_EXPERIENCE))
rule("skills_extract", "jobs", "job_description", X.extract_skills, D.extract_skills("job_description"))
rule("clean_title", "raw", "job_title", X.clean_title, D.clean_title("job_title"))
rule("clean_company", "raw", "company_name", X.clean_company, D.clean_company("company_name"))
rule("normalize_source", "raw", "source_website", X.normalize_source, D.title_case(D.strip("source_website")))
rule("faang_flag", "offers", "company_name", M.faang_flag,
     D.flag(f"lower(trim(company_name)) IN ({', '.join(D.q(n) for n in V.FAANG_NAMES)})"), key="request_id")
rule("coerce_years", "resumes", "experience_years", E.coerce_years, D.coerce_years("experience_years"), key="resume_id")
rule("row_skill_set", "jobs", "skills_required", lambda c: F.array_join(F.array_sort(X.distinct_skills(c)), "|"),
     f"array_to_string(list_sort(list_distinct({D.split_skills('skills_required')})), '|')")


@query("salary_from_text", "details", f"SELECT id AS k, {D.salary_from_text('description', 'usd_rate')} AS \"value\" FROM details")
def _(t):
    return t.details.select(F.col("id").alias("k"), S.salary_from_text(F.col("description"), F.col("usd_rate")).alias("value"))


@query("clean_salary", "raw", f"SELECT id, {D.keep_or_parse('salary_usd_numeric', 'salary')} AS salary_usd_numeric FROM raw")
def _(t):
    return C.clean_salary(t.raw).select("id", "salary_usd_numeric")


@query("experience_midpoint", "jobs",
       f"SELECT id, {D.experience_midpoint('experience_required', 'job_description')} AS years FROM jobs")
def _(t):
    return t.jobs.select("id", E.experience_midpoint(F.col("experience_required"), F.col("job_description")).alias("years"))


@query("years_to_seniority", "offers", f"SELECT request_id, {D.years_to_seniority('coalesce(experience_years, 0)')} AS label FROM offers")
def _(t):
    return t.offers.select("request_id", E.years_to_seniority(F.coalesce("experience_years", F.lit(0))).alias("label"))


FOOTER = D.footer("job_description")


@query("footer_metadata", "jobs", "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in FOOTER.items()) + " FROM jobs")
def _(t):
    out = t.jobs.select("id", M.footer(F.col("job_description")).alias("f")).select("id", "f.*")
    return out.withColumn("applicant_count", F.col("applicant_count").cast("double"))


@query("simple_metadata", "details", f"""SELECT id, {D.remote('description')} AS remote_type,
    {D.ordered_type('description', V.SIMPLE_EMPLOYMENT)} AS employment_type, {D.education('description')} AS education_required,
    {D.flag(D.has('description', V.META_EQUITY))} AS has_equity, {D.flag(D.has('description', V.META_BONUS))} AS has_bonus FROM details""")
def _(t):
    return t.details.select("id", M.simple_metadata(F.col("description")).alias("m")).select("id", "m.*")


FIXED_LEVEL = (f"coalesce(nullif(seniority_level, ''), {D.case(f'lower({FOOTER['seniority_raw']})', V.SENIORITY_BY_PLATFORM_LABEL)}, "
               f"{D.infer_seniority('job_title')})")
FIXED_META = {
    "employment_type": f"coalesce(nullif(employment_type, ''), {FOOTER['employment_type']}, 'Full-time')",
    "remote_type": f"coalesce(nullif(remote_type, ''), {FOOTER['remote_type']}, 'On-site')",
    "industry": f"coalesce(nullif(industry, ''), {FOOTER['industry']}, industry)",
    "education_required": f"coalesce(nullif(education_required, ''), {FOOTER['education_required']}, education_required)",
}
FIXED_FLAGS = {
    c: f"CAST(CASE WHEN coalesce({c}, 0) = 0 AND {D.has('coalesce(job_description, \'\')', p)} THEN 1 ELSE {c} END AS DOUBLE)"
    for c, p in (("has_equity", V.RESCAN_EQUITY), ("has_bonus", V.RESCAN_BONUS))
}


@query("fix_seniority", "raw", f"SELECT id, {FIXED_LEVEL} AS seniority_level FROM raw")
def _(t):
    return t.raw.transform(C.with_footer).transform(C.fix_seniority).select("id", "seniority_level")


@query("fix_metadata", "raw", "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in FIXED_META.items()) + " FROM raw")
def _(t):
    return t.raw.transform(C.with_footer).transform(C.fix_metadata).select("id", *FIXED_META)


@query("fix_equity_bonus", "raw", "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in FIXED_FLAGS.items()) + " FROM raw")
def _(t):
    return C.fix_equity_bonus(t.raw).select("id", *[F.col(c).cast("double").alias(c) for c in FIXED_FLAGS])


@query("drop_invalid", "raw", "SELECT id, job_title FROM raw WHERE length(job_title) >= 3")
def _(t):
    return C.drop_invalid(t.raw).select("id", "job_title")


KEY = f"coalesce(nullif(dedup_key, ''), {D.key_of('company_name', 'job_title', 'city')})"


PARTS = "concat_ws(chr(31), lower(coalesce(company_name, '')), lower(coalesce(job_title, '')), lower(coalesce(city, '')))"
IDENTITY = f"""CASE WHEN nullif(dedup_key, '') IS NULL OR dedup_key = {D.key_of('company_name', 'job_title', 'city')}
    THEN {PARTS} ELSE 'key:' || dedup_key END"""


@query("dedup_key", "raw", f"SELECT id, {KEY} AS dedup_key FROM raw")
def _(t):
    return K.with_key(t.raw).select("id", "dedup_key")


@query("dedup_key_source", "details", f"""SELECT id, {D.key_of("'levelsfyi'", 'trim(company_name)', 'trim(job_title)', 'CAST(id AS STRING)')} AS by_id,
    {D.key_of("'payscale'", 'trim(company_name)', 'trim(job_title)', 'trim(location)')} AS by_location,
    {D.key_of("''", 'trim(company_name)', 'trim(job_title)', 'trim(location)')} AS bare FROM details""")
def _(t):
    company, title = F.col("company_name"), F.col("job_title")
    return t.details.select(
        "id", X.source_key("levelsfyi", company, title, F.col("id").cast("string")).alias("by_id"),
        X.source_key("payscale", company, title, X.strip(F.col("location"))).alias("by_location"),
        X.source_key("", company, title, X.strip(F.col("location"))).alias("bare"))


BEST = f"""WITH k AS (SELECT * REPLACE ({KEY} AS dedup_key), {IDENTITY} AS identity FROM raw %s),
    best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY identity ORDER BY CASE WHEN salary IS NULL THEN 1 ELSE 0 END, id) = 1)"""


@query("dedup_keep_salary", "raw", BEST % "" + " SELECT dedup_key, id, salary FROM best")
def _(t):
    return C.deduplicate(t.raw).select("dedup_key", "id", "salary")


CLEANED = f"""{BEST % "WHERE length(job_title) >= 3"},
    named AS (SELECT * REPLACE ({D.clean_title('job_title')} AS job_title) FROM best),
    clean AS (SELECT id, dedup_key, job_title, company_name AS company_name_raw, {D.clean_company('company_name')} AS company_name,
      {D.keep_or_parse('salary_usd_numeric', 'salary')} AS salary_usd_numeric, {FIXED_LEVEL} AS seniority_level,
      {', '.join(f'{e} AS {n}' for n, e in {**FIXED_META, **FIXED_FLAGS}.items())},
      {D.title_case(D.strip('source_website'))} AS source_website, city, country, role, skills_required, experience_required,
      job_description, company_rating FROM named)"""
CLEAN_SHOWN = ["id", "dedup_key", "job_title", "company_name_raw", "company_name", "salary_usd_numeric", "seniority_level",
               *FIXED_META, *FIXED_FLAGS, "source_website"]


@query("clean_jobs", "raw", f"{CLEANED} SELECT {', '.join(CLEAN_SHOWN)} FROM clean")
def _(t):
    out = C.clean_jobs(t.raw).select(*CLEAN_SHOWN)
    return out.withColumns({c: F.col(c).cast("double") for c in FIXED_FLAGS})


ISSUES = {
    "job_title": "trim(coalesce(job_title, '')) = ''",
    "job_link": "NOT coalesce(starts_with(trim(job_link), 'http'), FALSE)",
    "source_website": f"NOT coalesce(source_website IN ({', '.join(D.q(s) for s in V.VALID_SOURCES)}), FALSE)",
    "salary_usd_numeric": f"salary_usd_numeric < {V.PAY_MIN} OR salary_usd_numeric > {V.PAY_MAX}",
}


@query("validate_records", "raw", "SELECT id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {cond} THEN '{name}' END" for name, cond in ISSUES.items()) + ") AS issues, NOT (" + " OR ".join(
    f"coalesce({cond}, FALSE)" for cond in ISSUES.values()) + ") AS is_valid FROM raw")
def _(t):
    return C.validate_records(t.raw).select("id", F.array_join("issues", ",").alias("issues"), "is_valid")


# --- bulk load ----------------------------------------------------------------

IN_COUNTRIES = f"country IN ({', '.join(D.q(c) for c in V.BULK_COUNTRIES)})"
MAPPED = """WITH m AS (SELECT "Job Id" AS job_id, "Job Title" AS job_title, "Role" AS "role", "Company" AS company_name, location,
    location AS city, "Country" AS country, "Salary Range" AS rng, "Experience" AS exp, "Qualifications" AS ql, "Work Type" AS wt,
    TRY_CAST("Company Size" AS DOUBLE) AS company_size, "Job Portal" AS portal, skills AS skills_raw, "Job Posting Date" AS date_posted_raw,
    coalesce("Benefits", '') || ' ' || coalesce("Job Description", '') AS perks FROM bulk)"""
MIDPOINT = (f"(TRY_CAST({D.rx('rng', V.PAY_RANGE_K, 1)} AS DOUBLE) + TRY_CAST({D.rx('rng', V.PAY_RANGE_K, 2)} AS DOUBLE)) / 2 * 1000")
COST = D.case("trim(country)", V.COUNTRY_COST, V.COUNTRY_COST_DEFAULT)
ADJUSTED = f"{MIDPOINT} * ({COST}::DOUBLE / {V.COUNTRY_COST_BASE})"


@query("range_midpoint", "bulk", f"{MAPPED} SELECT job_id, {MIDPOINT} AS midpoint FROM m")
def _(t):
    return B.map_columns(t.bulk).select("job_id", S.range_midpoint(F.col("_range")).alias("midpoint"))


@query("bulk_map", "bulk", f"{MAPPED} SELECT job_id, job_title, \"role\", company_name, city, country, company_size, "
       "date_posted_raw, 'USD' AS salary_currency FROM m")
def _(t):
    return B.map_columns(t.bulk).select("job_id", "job_title", "role", "company_name", "city", "country", "company_size",
                                        "date_posted_raw", "salary_currency")


@query("keep_countries", "bulk", f"{MAPPED} SELECT job_id, country FROM m WHERE {IN_COUNTRIES}")
def _(t):
    return B.keep_countries(B.map_columns(t.bulk)).select("job_id", "country")


@query("col_adjust_country", "bulk", f"""{MAPPED} SELECT job_id, {COST} AS cost_of_living_index, {D.money(ADJUSTED)} AS salary_usd_numeric,
    {D.salary_label(ADJUSTED)} AS salary FROM m""")
def _(t):
    out = t.bulk.transform(B.map_columns).transform(B.country_cost).transform(B.adjust_salary)
    return out.select("job_id", "cost_of_living_index", F.round(F.col("salary_usd_numeric").cast("decimal(28,8)"), 2)
                      .cast("double").alias("salary_usd_numeric"), "salary")


@query("salary_outliers", "bulk", f"""{MAPPED} SELECT job_id FROM m WHERE {ADJUSTED} IS NULL OR {ADJUSTED} BETWEEN 25000 AND 400000""")
def _(t):
    return t.bulk.transform(B.map_columns).transform(B.country_cost).transform(B.adjust_salary).transform(
        B.drop_outliers).select("job_id")


@query("map_education", "bulk", f"{MAPPED} SELECT job_id, {D.case('ql', V.EDUCATION_BY_QUALIFICATION)} AS education_required FROM m")
def _(t):
    return B.map_education(B.map_columns(t.bulk)).select("job_id", "education_required")


WORK = [D.case("trim(wt)", {k: v[i] for k, v in V.WORK_TYPES.items()}, D.q(V.WORK_TYPE_DEFAULT[i])) for i in (0, 1)]


@query("map_work_type", "bulk", f"{MAPPED} SELECT job_id, {WORK[0]} AS employment_type, {WORK[1]} AS remote_type FROM m")
def _(t):
    return B.map_work_type(B.map_columns(t.bulk)).select("job_id", "employment_type", "remote_type")


BULK_EXPERIENCE, BULK_SIZE = D.bulk_experience("exp"), D.size_category("company_size")
BULK_SOURCE = f"coalesce(nullif(trim(portal), ''), {D.q(V.BULK_SOURCE_DEFAULT)})"
BULK_FLAGS = [D.flag(D.has("perks", p)) for p in (V.BULK_EQUITY, V.BULK_BONUS)]


def derived(t):
    return t.bulk.transform(B.map_columns).transform(B.derive_fields)


@query("bulk_experience", "bulk", f"{MAPPED} SELECT job_id, {BULK_EXPERIENCE} AS experience_required FROM m")
def _(t):
    return derived(t).select("job_id", "experience_required")


@query("size_category", "bulk", f"{MAPPED} SELECT job_id, {BULK_SIZE} AS company_size_category FROM m")
def _(t):
    return derived(t).select("job_id", "company_size_category")


@query("bulk_source", "bulk", f"{MAPPED} SELECT job_id, {BULK_SOURCE} AS source_website FROM m")
def _(t):
    return derived(t).select("job_id", "source_website")


@query("benefit_flags", "bulk", f"{MAPPED} SELECT job_id, {BULK_FLAGS[0]} AS has_equity, {BULK_FLAGS[1]} AS has_bonus FROM m")
def _(t):
    return derived(t).select("job_id", "has_equity", "has_bonus")


LOADED = f"""{MAPPED}, loaded AS (SELECT job_id, job_title, "role", company_name, city, country, {COST} AS cost_of_living_index,
    {D.money(ADJUSTED)} AS salary_usd_numeric, {D.salary_label(ADJUSTED)} AS salary, {BULK_EXPERIENCE} AS experience_required,
    {D.case('ql', V.EDUCATION_BY_QUALIFICATION)} AS education_required, {WORK[0]} AS employment_type, {WORK[1]} AS remote_type,
    {D.infer_seniority('job_title')} AS seniority_level, {D.flag(f"lower(trim(company_name)) IN ({', '.join(D.q(n) for n in V.FAANG_NAMES)})")} AS is_faang,
    {BULK_FLAGS[0]} AS has_equity, {BULK_FLAGS[1]} AS has_bonus, {BULK_SOURCE} AS source_website,
    {D.extract_skills('skills_raw')} AS skills_required, {BULK_SIZE} AS company_size_category,
    {D.key_of('company_name', 'job_title', 'location')} AS dedup_key FROM m
    WHERE {IN_COUNTRIES} AND length(job_title) >= 3 AND ({ADJUSTED} IS NULL OR {ADJUSTED} BETWEEN 25000 AND 400000))"""
LOADED_SHOWN = ["job_id", "job_title", "role", "company_name", "city", "country", "cost_of_living_index", "salary_usd_numeric",
                "salary", "experience_required", "education_required", "employment_type", "remote_type", "seniority_level",
                "is_faang", "has_equity", "has_bonus", "source_website", "skills_required", "company_size_category", "dedup_key"]


@query("bulk_load_map", "bulk", f"{LOADED} SELECT * FROM loaded")
def _(t):
    return B.load_bulk(t.bulk).select(*LOADED_SHOWN).withColumn(
        "salary_usd_numeric", F.round(F.col("salary_usd_numeric").cast("decimal(28,8)"), 2).cast("double"))


@query("bulk_summary", "bulk", f"""{LOADED} SELECT count(*) AS "rows", count(salary_usd_numeric) AS salary_rows,
    round(count(salary_usd_numeric) / count(*) * 100, 1) AS salary_fill_pct, count(DISTINCT country) AS countries,
    count(DISTINCT job_title) AS titles FROM loaded""")
def _(t):
    return B.bulk_summary(B.load_bulk(t.bulk))


@query("bulk_top_roles", "bulk", f"""{LOADED} SELECT "role", count(*) AS "count" FROM loaded GROUP BY "role"
    ORDER BY count(*) DESC, "role" LIMIT 5""")
def _(t):
    return B.top_roles(B.load_bulk(t.bulk))


# --- unions and accumulation --------------------------------------------------

CUT = "TIMESTAMP '1996-01-01 00:00:00'"


def halves(t):
    """Stored master (older postings, deduplicated) and the batch that arrives."""
    keyed = K.with_key(t.raw)
    return K.keep_with_salary(keyed.where(F.expr(f"scraped_at < {CUT}"))), keyed.where(F.expr(f"scraped_at >= {CUT}"))


HALVES = f"""WITH keyed AS (SELECT * REPLACE ({KEY} AS dedup_key), {IDENTITY} AS identity FROM raw), batch AS (SELECT * FROM keyed WHERE scraped_at >= {CUT}),
    master AS (SELECT * FROM keyed WHERE scraped_at < {CUT} QUALIFY row_number() OVER (PARTITION BY identity
      ORDER BY CASE WHEN salary IS NULL THEN 1 ELSE 0 END, id) = 1)"""
MERGED = f"""{HALVES}, merged AS (SELECT * FROM (SELECT *, 0 AS fresh FROM master UNION ALL SELECT *, 1 FROM batch)
    QUALIFY row_number() OVER (PARTITION BY identity ORDER BY CASE WHEN salary IS NULL THEN 1 ELSE 0 END, fresh, id) = 1)"""
INSERTED = f"""{HALVES} SELECT dedup_key, id FROM batch WHERE identity NOT IN (SELECT identity FROM master)
    QUALIFY row_number() OVER (PARTITION BY identity ORDER BY id) = 1"""


@query("insert_if_absent", "raw", INSERTED)
def _(t):
    master, batch = halves(t)
    return K.insert_if_absent(master, batch, batch.columns).select("dedup_key", "id")


@query("union_master", "raw", MERGED + " SELECT dedup_key, id, salary FROM merged")
def _(t):
    return K.merge_master(*halves(t)).select("dedup_key", "id", "salary")


@query("run_summary", "raw", f"""{MERGED} SELECT (SELECT count(*) FROM batch) AS new_jobs,
    count(*) - (SELECT count(*) FROM master) AS unique_added,
    (SELECT count(*) FROM batch) + (SELECT count(*) FROM master) - count(*) AS duplicates_dropped, count(*) AS total_jobs FROM merged""")
def _(t):
    return K.run_summary(*halves(t))


def sources(t):
    loaded = B.load_bulk(t.bulk).select("job_id", "job_title", "company_name", "city", "salary", "salary_usd_numeric",
                                        "skills_required", "role", "dedup_key")
    collected = t.raw.select("id", "job_title", "company_name", "city", "salary", "salary_usd_numeric", "industry", "dedup_key")
    return loaded.withColumn("id", F.col("job_id").cast("bigint")), collected


@query("union_sources", "bulk raw", f"""{LOADED} SELECT CAST(job_id AS BIGINT) AS id, job_title, company_name, "role", NULL AS industry FROM loaded
    UNION ALL SELECT id, job_title, company_name, NULL, industry FROM raw""")
def _(t):
    return K.union_sources(*sources(t)).select("id", "job_title", "company_name", "role", "industry")


@query("dedup_keep_first", "bulk raw", f"""{LOADED}, u AS (SELECT 0 AS src, CAST(job_id AS BIGINT) AS id, dedup_key, {IDENTITY} AS identity FROM loaded
    UNION ALL SELECT 1, id, {KEY}, {IDENTITY} FROM raw) SELECT dedup_key, id FROM u
    QUALIFY row_number() OVER (PARTITION BY identity ORDER BY src, id) = 1""")
def _(t):
    return K.keep_first(list(sources(t))).select("dedup_key", "id")
