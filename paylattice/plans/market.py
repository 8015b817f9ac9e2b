"""Insight, search, company and report queries."""

from pyspark.sql import functions as F

from ..operators import insights as I
from ..operators import quality as Q
from ..operators import search as R
from ..operators.search_index import SearchIndex
from ..session import scratch_path
from . import duck as D
from .registry import query

MEDIAN = "percentile_disc(0.5) WITHIN GROUP (ORDER BY salary_usd_numeric DESC)"

BY_CITY = f"""SELECT city, {D.money('avg(salary_usd_numeric)')} AS avg_salary, round({MEDIAN}, 2) AS median_salary,
    round(min(salary_usd_numeric), 2) AS salary_min, round(max(salary_usd_numeric), 2) AS salary_max,
    count(*) AS job_count FROM jobs WHERE salary_usd_numeric IS NOT NULL AND city IS NOT NULL %s GROUP BY city"""


def flat_range(df):
    return df.select("city", "avg_salary", "median_salary", F.col("salary_range.min").alias("salary_min"),
                     F.col("salary_range.max").alias("salary_max"), "job_count")


@query("salary_by_city", "jobs", BY_CITY % "")
def _(t):
    return flat_range(I.salary_by_city(t.jobs))


@query("salary_by_city_keyword", "jobs", BY_CITY % "AND contains(lower(job_title), 'engineer')")
def _(t):
    return flat_range(I.salary_by_city(t.jobs, "Engineer"))


BY_LEVEL = f"""SELECT seniority_level, {D.money('avg(salary_usd_numeric)')} AS avg_salary, round({MEDIAN}, 2) AS median_salary,
    count(*) AS "count", {D.seniority_score("seniority_level")} AS seniority_score
    FROM jobs WHERE salary_usd_numeric IS NOT NULL AND seniority_level IS NOT NULL GROUP BY seniority_level"""


@query("salary_by_seniority", "jobs", BY_LEVEL)
def _(t):
    return I.salary_by_seniority(t.jobs)


REMOTE = """WITH a AS (SELECT
    avg(CASE WHEN lower(remote_type) = 'remote' THEN salary_usd_numeric END) r,
    avg(CASE WHEN lower(remote_type) = 'hybrid' THEN salary_usd_numeric END) h,
    avg(CASE WHEN lower(remote_type) = 'on-site' THEN salary_usd_numeric END) o,
    count(CASE WHEN lower(remote_type) = 'remote' THEN 1 END) rc, count(CASE WHEN lower(remote_type) = 'hybrid' THEN 1 END) hc,
    count(CASE WHEN lower(remote_type) = 'on-site' THEN 1 END) oc FROM jobs WHERE salary_usd_numeric IS NOT NULL),
  remote AS (SELECT round(r, 2) AS remote_avg, round(h, 2) AS hybrid_avg, round(o, 2) AS onsite_avg,
    round((r - o) / o * 100, 2) AS remote_premium_pct, round((h - o) / o * 100, 2) AS hybrid_premium_pct,
    rc AS remote_count, hc AS hybrid_count, oc AS onsite_count FROM a)"""


@query("remote_vs_onsite", "jobs", REMOTE + " SELECT * FROM remote")
def _(t):
    return I.remote_vs_onsite(t.jobs)


@query("market_summary", "jobs", f"""SELECT count(*) AS total_jobs, count(DISTINCT city) AS cities_count,
    count(DISTINCT source_website) AS sources_count, round(min(salary_usd_numeric), 2) AS salary_min,
    round(max(salary_usd_numeric), 2) AS salary_max, {D.money('avg(salary_usd_numeric)')} AS salary_avg,
    round((SELECT {MEDIAN} FROM jobs WHERE salary_usd_numeric IS NOT NULL), 2) AS salary_median,
    round(count(salary_usd_numeric) / count(*) * 100, 1) AS jobs_with_salary_pct, max(date_posted_raw) AS last_scraped FROM jobs""")
def _(t):
    return I.market_summary(t.jobs)


@query("top_companies", "jobs", """SELECT company_name AS company, count(*) AS "count" FROM jobs WHERE company_name IS NOT NULL
    GROUP BY company_name ORDER BY count(*) DESC, company_name LIMIT 10""")
def _(t):
    return I.top_companies(t.jobs)


MENTIONS = f"""WITH s AS (SELECT unnest({D.split_skills("skills_required")}) AS skill FROM jobs WHERE skills_required IS NOT NULL)
    SELECT skill, count(*) AS "count" FROM s GROUP BY skill ORDER BY count(*) DESC, skill LIMIT """


@query("market_top_skills", "jobs", MENTIONS + "10")
def _(t):
    return I.skill_mentions(t.jobs)


@query("batch_top_skills", "jobs", MENTIONS + "15")
def _(t):
    return Q.batch_top_skills(t.jobs)


def skills_sql(where: str = "TRUE") -> str:
    """Straight from the definition: averages over rows with and without, per skill."""
    return f"""WITH r AS (SELECT id, salary_usd_numeric pay, list_distinct({D.split_skills("skills_required")}) ss FROM jobs
        WHERE skills_required IS NOT NULL AND {where}),
      names AS (SELECT DISTINCT unnest(ss) AS skill FROM r),
      p AS (SELECT skill, count(CASE WHEN list_contains(ss, skill) THEN 1 END) c,
          avg(CASE WHEN list_contains(ss, skill) THEN pay END) w, avg(CASE WHEN NOT list_contains(ss, skill) THEN pay END) o
        FROM names, r GROUP BY skill),
      skills AS (SELECT skill, c AS "count", {D.money('w')} AS avg_salary_with_skill, {D.money('o')} AS avg_salary_without_skill,
          CASE WHEN o > 0 THEN {D.money('(w - o) / o * 100')} END AS salary_premium_pct FROM p
        ORDER BY coalesce(CASE WHEN o > 0 THEN {D.money('(w - o) / o * 100')} END, 0) DESC, skill LIMIT 30)"""


@query("top_skills", "jobs", skills_sql() + " SELECT * FROM skills")
def _(t):
    return I.top_skills(t.jobs)


@query("top_skills_filtered", "jobs", skills_sql(
    "contains(lower(city), 'nation_1') AND contains(lower(seniority_level), 'senior')") + " SELECT * FROM skills")
def _(t):
    return I.top_skills(t.jobs, city="NATION_1", seniority="Senior")


@query("chart_top_skills", "jobs", skills_sql() + """ SELECT skill, floor(salary_premium_pct * 10 + 0.5) / 10 AS premium FROM skills
    WHERE salary_premium_pct IS NOT NULL AND "count" >= 3 ORDER BY salary_premium_pct DESC, skill LIMIT 15""")
def _(t):
    return I.chart_top_skills(I.top_skills(t.jobs))


@query("home_top_skills", "jobs", skills_sql() + """ SELECT * FROM skills WHERE salary_premium_pct IS NOT NULL
    ORDER BY salary_premium_pct DESC, skill LIMIT 5""")
def _(t):
    return I.home_top_skills(I.top_skills(t.jobs))


@query("chart_city", "jobs", f"""WITH c AS ({BY_CITY % ""}) SELECT split_part(city, ',', 1) AS city,
    CAST(floor(avg_salary + 0.5) AS BIGINT) AS avg_salary, CAST(floor(median_salary + 0.5) AS BIGINT) AS median_salary
    FROM c ORDER BY c.avg_salary DESC, c.city LIMIT 15""")
def _(t):
    return I.chart_city(I.salary_by_city(t.jobs))


@query("chart_seniority", "jobs", f"""WITH c AS ({BY_LEVEL}) SELECT trim(split_part(seniority_level, '(', 1)) AS level,
    CAST(floor(avg_salary + 0.5) AS BIGINT) AS avg_salary, CAST(floor(median_salary + 0.5) AS BIGINT) AS median_salary, "count" FROM c""")
def _(t):
    return I.chart_seniority(I.salary_by_seniority(t.jobs))


@query("chart_remote", "jobs", REMOTE + " " + " UNION ALL ".join(
    f"""SELECT '{label}' AS type, CAST(floor(coalesce({k}_avg, 0) + 0.5) AS BIGINT) AS salary, {k}_count AS "count" FROM remote"""
    for label, k in (("Remote", "remote"), ("Hybrid", "hybrid"), ("On-site", "onsite"))))
def _(t):
    return I.chart_remote(I.remote_vs_onsite(t.jobs))


@query("salary_histogram", "jobs", """WITH p AS (SELECT salary_usd_numeric s FROM jobs WHERE salary_usd_numeric > 0),
    b AS (SELECT unnest(generate_series(CAST(floor(min(s) / 20000) * 20000 AS BIGINT), CAST(floor(max(s) / 20000) * 20000 AS BIGINT), 20000)) AS bin FROM p)
    SELECT bin, '$' || (bin // 1000) || 'k-$' || ((bin + 20000) // 1000) || 'k' AS "range", count(s) AS "count"
    FROM b LEFT JOIN p ON s >= bin AND s < bin + 20000 GROUP BY bin""")
def _(t):
    return I.salary_histogram(t.jobs)


# --- companies ----------------------------------------------------------------

PROFILE = f"""SELECT company_name, count(*) AS job_count, count(salary_usd_numeric) AS salary_count,
    {D.money('avg(salary_usd_numeric)')} AS avg_salary,
    round(percentile_disc(0.5) WITHIN GROUP (ORDER BY salary_usd_numeric DESC) FILTER (WHERE salary_usd_numeric IS NOT NULL), 2) AS median_salary,
    round(min(salary_usd_numeric), 2) AS salary_min, round(max(salary_usd_numeric), 2) AS salary_max,
    round(avg(CASE WHEN has_equity > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS equity_frequency_pct,
    round(avg(CASE WHEN has_bonus > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS bonus_frequency_pct,
    round(avg(CASE WHEN contains(lower(remote_type), 'remote') THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS remote_frequency_pct
    FROM jobs WHERE company_name IS NOT NULL %s GROUP BY company_name"""


@query("company_profile", "jobs", PROFILE % "AND contains(lower(company_name), 'customer#00000010')"
       + " ORDER BY job_count DESC, company_name LIMIT 1")
def _(t):
    return I.company_profile(t.jobs, "CUSTOMER#00000010")


@query("company_profiles", "jobs", PROFILE % "")
def _(t):
    return I.company_profiles(t.jobs)


def company_top_sql(column: str) -> str:
    return f"""WITH g AS (SELECT company_name, {column}, count(*) AS "count", {D.money('avg(salary_usd_numeric)')} AS avg_salary
        FROM jobs WHERE company_name IS NOT NULL GROUP BY company_name, {column})
      SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY "count" DESC, {column}) AS position FROM g QUALIFY position <= 5"""


@query("company_top_roles", "jobs", company_top_sql("job_title"))
def _(t):
    return I.company_top(t.jobs, "job_title")


@query("company_top_cities", "jobs", company_top_sql("city"))
def _(t):
    return I.company_top(t.jobs, "city")


@query("company_recent", "jobs", """SELECT company_name, id, job_title, scraped_at,
    row_number() OVER (PARTITION BY company_name ORDER BY scraped_at DESC NULLS LAST, id) AS position FROM jobs QUALIFY position <= 6""")
def _(t):
    return I.company_recent(t.jobs).select("company_name", "id", "job_title", "scraped_at", "position")


# --- search -------------------------------------------------------------------

FILTERS = dict(keyword="Engineer", city="nation_1", min_salary=50000, max_salary=400000, skills="java, aws")
WHERE = """(contains(lower(job_title), 'engineer') OR contains(lower(company_name), 'engineer')) AND contains(lower(city), 'nation_1')
    AND salary_usd_numeric >= 50000 AND salary_usd_numeric <= 400000
    AND (contains(lower(skills_required), 'java') OR contains(lower(skills_required), 'aws'))"""


@query("search_filter", "jobs", f"SELECT id, job_title, city FROM jobs WHERE {WHERE}")
def _(t):
    return R.search(t.jobs, **FILTERS).select("id", "job_title", "city")


@query("search_filter_exact", "jobs", """SELECT id FROM jobs WHERE lower(remote_type) = 'remote'
    AND contains(lower(seniority_level), 'staff') AND lower(source_website) = 'building'""")
def _(t):
    return R.search(t.jobs, remote_type="REMOTE", seniority_level="Staff", source="Building").select("id")


LISTED = """id, job_title, company_name, city, salary, salary_usd_numeric, seniority_level, experience_required, remote_type,
    employment_type, skills_required, source_website, job_link, has_equity <> 0 AS has_equity, has_bonus <> 0 AS has_bonus, industry"""


@query("search_projection", "jobs", f"SELECT {LISTED} FROM jobs")
def _(t):
    return R.listing(t.jobs).drop("is_faang")


@query("search_page", "jobs", f"""SELECT {LISTED} FROM jobs WHERE contains(lower(job_title), 'data') OR contains(lower(company_name), 'data')
    ORDER BY CASE WHEN job_link <> '' THEN 0 ELSE 1 END, scraped_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def _(t):
    return R.search_page(t.jobs, page=2, page_size=20, keyword="data").drop("is_faang")


@query("search_total", "jobs", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM jobs WHERE {WHERE}")
def _(t):
    return R.search_total(t.jobs, **FILTERS)


def indexed(t):
    """The postings as an index of two segments; the second is offered twice and stored once."""
    index = SearchIndex(t.spark, scratch_path(t.spark, "search-index"), buckets=8)
    index.add(t.jobs.where("id % 3 <> 0"), "first")
    for _ in range(2):
        index.add(t.jobs.where("id % 3 = 0"), "second")
    return index


@query("search_index_filter", "jobs", f"SELECT id, scraped_at FROM jobs WHERE {WHERE}")
def _(t):
    return indexed(t).matches(**FILTERS).select("id", "scraped_at")


@query("search_index_page", "jobs", f"""SELECT {LISTED} FROM jobs WHERE contains(lower(job_title), 'data') OR contains(lower(company_name), 'data')
    ORDER BY CASE WHEN job_link <> '' THEN 0 ELSE 1 END, scraped_at DESC NULLS LAST, id LIMIT 20 OFFSET 40""")
def _(t):
    index, last = indexed(t), None
    for _ in range(2):
        rows = index.page(20, last, keyword="data").collect()  # one page
        last = rows[-1] if rows else last
    return index.page(20, last, keyword="data").select([c for c in R.LISTED if c != "is_faang"])


@query("search_index_total", "jobs", f"SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM jobs WHERE {WHERE}")
def _(t):
    return indexed(t).total(**FILTERS)


@query("job_by_id", "jobs", f"SELECT {LISTED} FROM jobs WHERE id = 7")
def _(t):
    return R.job_by_id(t.jobs, 7).drop("is_faang")


@query("listing_card", "jobs", f"""SELECT id, array_to_string({D.split_skills("skills_required")}[1:4], '|') AS skills,
    coalesce(nullif(salary, ''), {D.salary_label("nullif(salary_usd_numeric, 0)")}) AS salary_text FROM jobs""")
def _(t):
    return R.listing_card(t.jobs).withColumn("skills", F.array_join("skills", "|"))


# --- reports ------------------------------------------------------------------

HEALTH = """count(*) AS tasks, count(CASE WHEN status = 'success' THEN 1 END) AS successes,
    count(CASE WHEN status = 'failed' THEN 1 END) AS failures, CAST(sum(jobs_found) AS BIGINT) AS jobs_found,
    CAST(sum(salary_hits) AS BIGINT) AS salary_hits, round(avg(duration_sec), 2) AS avg_duration_sec,
    round(count(CASE WHEN status = 'success' THEN 1 END) / count(*) * 100, 2) AS success_rate_pct,
    CASE WHEN sum(jobs_found) > 0 THEN round(sum(salary_hits) / sum(jobs_found) * 100, 2) ELSE 0.0 END AS salary_hit_rate_pct"""


@query("source_health", "health", f"SELECT source, {HEALTH} FROM health GROUP BY source")
def _(t):
    return Q.source_health(t.health)


@query("task_health", "jobs", """SELECT source_website, role, city, count(*) AS jobs_found,
    count(CASE WHEN coalesce(salary, '') <> '' OR coalesce(salary_usd_numeric, 0) <> 0 THEN 1 END) AS salary_hits,
    round(count(CASE WHEN coalesce(salary, '') <> '' OR coalesce(salary_usd_numeric, 0) <> 0 THEN 1 END) / count(*) * 100, 2) AS salary_hit_rate_pct
    FROM jobs GROUP BY source_website, role, city""")
def _(t):
    return Q.task_health(t.jobs, ["source_website", "role", "city"])


FILL_COLUMNS = ["job_title", "company_name", "salary", "salary_usd_numeric", "seniority_level", "employment_type",
                "remote_type", "industry", "education_required", "skills_required", "has_equity", "dedup_key"]


def fill_sql(view: str, columns, bands) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS filled, count(*) AS total, round(count({c}) / count(*) * 100, 1) AS rate_pct,
        CASE WHEN count({c}) / count(*) * 100 > {bands[0]} THEN 'good' WHEN count({c}) / count(*) * 100 > {bands[1]} THEN 'fair'
        ELSE 'poor' END AS band FROM {view}""" for c in columns)


@query("fill_rates", "raw", fill_sql("raw", FILL_COLUMNS, (70, 30)))
def _(t):
    return Q.fill_rates(t.raw, FILL_COLUMNS)


@query("salary_fill", "jobs", """SELECT 'source' AS dimension, source_website AS "value", count(salary) AS filled, count(*) AS total,
    round(count(salary) / count(*) * 100, 0) AS rate_pct FROM jobs GROUP BY source_website
    UNION ALL SELECT 'city', city, count(salary), count(*), round(count(salary) / count(*) * 100, 0) FROM jobs GROUP BY city""")
def _(t):
    return Q.salary_fill(t.jobs)


@query("seniority_distribution", "jobs", """SELECT seniority_level, count(*) AS "count" FROM jobs
    WHERE seniority_level IS NOT NULL GROUP BY seniority_level""")
def _(t):
    return Q.seniority_distribution(t.jobs)


@query("basic_stats", "jobs", """SELECT count(*) AS "rows", count(DISTINCT source_website) AS sources, count(DISTINCT city) AS cities FROM jobs""")
def _(t):
    return Q.basic_stats(t.jobs)


READINESS = """WITH c AS (SELECT count(*) n, count(salary_usd_numeric) p, count(DISTINCT city) ci, count(DISTINCT seniority_level) se FROM jobs),
    s AS (SELECT coalesce(source_website, 'unknown') src, count(*) k FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    r AS (SELECT n AS total_rows, p AS salary_rows, round(p / n * 100, 2) AS salary_coverage_pct, ci AS cities_count,
      se AS seniority_levels_count, src AS top_source, round(k / n * 100, 2) AS top_source_pct FROM c, s),
    k AS (SELECT *, salary_rows >= {rows} AS salary_rows_ok, salary_coverage_pct >= 30 AS salary_coverage_ok, cities_count >= 5 AS cities_ok,
      seniority_levels_count >= {levels} AS seniority_levels_ok, top_source_pct <= {share} AS source_balance_ok FROM r),
    w AS (SELECT *, list_filter([
      CASE WHEN NOT salary_rows_ok THEN 'needs at least ' || format('{{:,}}', {rows}) || ' salary rows; found ' || format('{{:,}}', salary_rows) END,
      CASE WHEN NOT salary_coverage_ok THEN 'needs salary coverage >= 30%; found ' || printf('%.1f%%', salary_coverage_pct) END,
      CASE WHEN NOT cities_ok THEN 'needs at least 5 cities; found ' || cities_count END,
      CASE WHEN NOT seniority_levels_ok THEN 'needs at least {levels} seniority levels; found ' || seniority_levels_count END,
      CASE WHEN NOT source_balance_ok THEN concat('single source ''', top_source, ''' dominates ', printf('%.1f%%', top_source_pct), ' of rows') END
      ], lambda x : x IS NOT NULL) AS texts FROM k)
    SELECT * EXCLUDE (texts), len(texts) = 0 AS ready, len(texts) AS open_reasons, array_to_string(texts, '; ') AS reason_texts FROM w"""


def readiness(t, **limits):
    out = Q.training_readiness(t.jobs, **limits)
    checks = [F.col(f"checks.{c}").alias(f"{c}_ok") for c in ("salary_rows", "salary_coverage", "cities", "seniority_levels", "source_balance")]
    return out.select("*", F.array_join("reasons", "; ").alias("reason_texts"), *checks,
                      F.size("reasons").alias("open_reasons")).drop("reasons", "checks")


@query("training_readiness", "jobs", READINESS.format(rows=5000, levels=3, share=75))
def _(t):
    return readiness(t)


@query("training_readiness_strict", "jobs", READINESS.format(rows=10**9, levels=9, share=10))
def _(t):
    return readiness(t, min_salary_rows=10**9, min_seniority_levels=9, max_single_source_pct=10.0)


@query("min_rows_gate", "jobs", """SELECT count(salary_usd_numeric) AS salary_rows, CASE WHEN count(salary_usd_numeric) < 20 THEN 'stop'
    WHEN count(salary_usd_numeric) < 500 THEN 'warn' ELSE 'ok' END AS status FROM jobs""")
def _(t):
    return Q.min_rows_gate(t.jobs)
