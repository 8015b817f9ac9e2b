"""Job-market views derived from the star-schema test tables.

The test data has no pay text, so every view derives its columns from keys and
amounts by CASE and arithmetic.  A view is a list of (column, SQL expression);
the same expressions run in Spark (``selectExpr``) and in the DuckDB oracle, so
both sides start from equal inputs.  Orders may be a stream: the dimension joins
are then stream-static.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def text(expr: str) -> str:
    return f"CAST(CAST(floor({expr}) AS BIGINT) AS STRING)"


def pick(expr: str, *values: str, other: str = "NULL") -> str:
    """CASE expr WHEN 0 THEN values[0] WHEN 1 THEN ... ELSE other END."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} ELSE {other} END"


K, P = "o_orderkey", "o_totalprice"

JOBS = [
    ("id", K),
    ("job_title", pick(
        f"{K} % 8", "'senior data scientist'", "'machine learning engineer'", "'software engineer ii'",
        "'junior data analyst'", "'staff platform engineer'", "'director of data'", "'devops engineer'",
        other="'ui/ux designer 12345678'")),
    ("role", pick(f"{K} % 3", "'Engineer'", "'Analyst'", other="'Scientist'")),
    ("company_name", "c_name || " + pick("c_custkey % 5", "' Inc.'", "', LLC'", "' Pvt. Ltd.'", "' GmbH'", other="''")),
    ("city", "n_name"),
    ("location", "n_name || ', ' || r_name"),
    ("country", "r_name"),
    ("salary", pick(
        f"{K} % 6", f"'$' || {text(f'{P}/2000')} || 'k - $' || {text(f'{P}/1000')} || 'k'",
        f"'$' || {text(f'{P}/2080')} || '/hr'", f"'$' || {text(f'{P}/12')} || ' per month'",
        f"CAST({text(f'{P}/100000')} AS BIGINT) + 1 || ' LPA'", "NULL", other=f"'GBP ' || {text(P)}")),
    ("salary_usd_numeric", f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE {P} END"),
    ("seniority_level", "CASE o_orderpriority WHEN '1-URGENT' THEN 'Director (8+ years)' WHEN '2-HIGH' THEN 'Staff (8+ years)' "
        "WHEN '3-MEDIUM' THEN 'Senior (5+ years)' WHEN '4-NOT SPECIFIED' THEN 'Mid-Level (2-5 years)' "
        "ELSE 'Entry Level (0-2 years)' END"),
    ("experience_required", pick(f"{K} % 5", "'3-5 years'", "'5+ years'", "'Fresher'", "NULL", other="'7 years'")),
    ("employment_type", pick(f"{K} % 4", "'Full-time'", "'Contract'", "'Internship'", other="'Part-time'")),
    ("remote_type", "CASE o_orderstatus WHEN 'F' THEN 'On-site' WHEN 'O' THEN 'Remote' ELSE 'Hybrid' END"),
    ("industry", pick(f"{K} % 2", "'Software'")),
    ("education_required", pick(f"{K} % 7", "'PhD'", "'Master''s'", "'B.Tech'")),
    ("skills_required", pick(f"{K} % 5", "'Python, SQL, Spark'", "'Python, AWS'", "'Java, SQL'", "'React, Python'")),
    ("source_website", "c_mktsegment"),
    ("job_link", f"CASE WHEN {K} % 4 = 0 THEN '' ELSE 'http://example.org/job/' || CAST({K} AS STRING) END"),
    ("has_equity", f"CAST({K} % 2 AS INT)"),
    ("has_bonus", f"CASE WHEN {K} % 3 = 0 THEN 1 ELSE 0 END"),
    ("job_description", f"'Requires ' || CAST({K} % 9 + 1 AS STRING) || CASE WHEN {K} % 2 = 0 THEN '+ years' ELSE '-12 years' END "
        f"|| ' with Python and C++17. ' || CASE WHEN {K} % 3 = 0 THEN 'Remote or hybrid. Stock options and bonus. Posted 2 days ago, 1,234 applicants.' "
        "ELSE 'Seniority level Associate Employment type Contract Industries Software' END"),
    ("company_rating", f"CASE WHEN {K} % 9 = 0 THEN NULL ELSE CAST(3 + ({K} % 20) / 10.0 AS DOUBLE) END"),
    ("date_posted_raw", f"'Posted ' || CAST({K} % 28 AS STRING) || ' days ago'"),
    ("scraped_at", "CAST(o_orderdate AS TIMESTAMP)"),
]
JOB_COLUMNS = [name for name, _ in JOBS]

# listings before cleaning: holes, blanks, padding and copies without pay
RAW_FIXES = {
    "job_title": "CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN 'QA' "
                 "WHEN id % 6 = 0 THEN '- ' || job_title || ' :' ELSE job_title END",
    "salary_usd_numeric": "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 31 = 0 THEN 1200.0 ELSE salary_usd_numeric END",
    "seniority_level": "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE seniority_level END",
    "employment_type": "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE employment_type END",
    "remote_type": "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE remote_type END",
    "education_required": "CASE WHEN id % 7 = 1 THEN '' ELSE education_required END",
    "has_equity": "CASE WHEN id % 8 = 0 THEN NULL ELSE has_equity END",
    "source_website": "' ' || lower(source_website) || '.com '",
}
RAW = [(n, RAW_FIXES.get(n, n)) for n in JOB_COLUMNS] + [
    ("dedup_key", "CASE id % 50 WHEN 0 THEN '' WHEN 1 THEN 'key' || CAST(id % 1000 AS STRING) ELSE NULL END")]
COPY_FIXES = {"id": "id + 10000000", "salary": "CAST(NULL AS STRING)"}
COPIES = [(n, COPY_FIXES.get(n, n)) for n, _ in RAW]

BULK = [
    ("Job Id", f"CAST({K} AS STRING)"),
    ("Job Title", pick(f"{K} % 3", "'Data Engineer'", "'Wedding Planner'", other="'QA'")),
    ("Role", pick(f"{K} % 4", "'Builder'", "'Planner'", "'Tester'", other="'Owner'")),
    ("Company", pick(f"{K} % 11", "'Google'", other="c_name")),
    ("location", "n_name"),
    ("Country", pick(f"{K} % 4", "'Germany'", "'Japan'", "'India'", other="'Hong Kong'")),
    ("Salary Range", f"'$' || CAST({K} % 40 + 40 AS STRING) || 'K-$' || CAST({K} % 40 + 80 AS STRING) || 'K'"),
    ("Experience", f"CAST({K} % 5 AS STRING) || ' to ' || CAST({K} % 5 + 8 AS STRING) || ' Years'"),
    ("Qualifications", pick(f"{K} % 4", "'M.Tech'", "'BCA'", "'PhD'", other="'Diploma'")),
    ("Work Type", pick(f"{K} % 4", "'Intern'", "'Remote'", "'Contract'", other="'Shift'")),
    ("Company Size", f"CAST({K} % 2000 AS STRING)"),
    ("Benefits", pick(f"{K} % 3", "'Stock options'", "'Annual bonus'")),
    ("Job Description", pick(f"{K} % 5", "'Commission paid'", other="'Plain work'")),
    ("skills", pick(f"{K} % 4", "'Python and C++17, CI/CD on AWS'", "'Excel; Power BI reports'", "'Go, R and AI/ML'")),
    ("Job Portal", pick(f"{K} % 5", "' Indeed '", "'  '", "NULL", other="'Snagajob'")),
    ("Job Posting Date", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
]

OFFERS = [
    ("request_id", "c_custkey"),
    ("job_title", pick("c_custkey % 3", "'Senior Data Scientist'", "'DevOps Engineer'", other="'Software Engineer'")),
    ("city", "n_name || ', X'"),
    ("seniority_level", pick("c_custkey % 3", "'Senior (5+ years)'", "'Staff (8+ years)'", other="'Mid-Level (2-5 years)'")),
    ("experience_years", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 15 AS INT) END"),
    ("employment_type", pick("c_custkey % 4", "'Internship'", "'Part-time'", "'Contract'", other="'Full-time'")),
    ("remote_type", pick("c_custkey % 5", "'Remote'", "'Hybrid'", other="'On-site'")),
    ("education_required", pick("c_custkey % 3", "'PhD'", "'Master'")),
    ("company_name", pick("c_custkey % 4", "'Google'", "'IBM'", other="c_name")),
    ("skills", pick("c_custkey % 6", "'Python,SQL'", "'GenAI'", "'Cobol,Go,python'", "'MongoDB,Excel,Rust'", "'AWS'")),
    ("base_salary_usd", "60000 + CAST(floor(abs(c_acctbal) * 20) AS BIGINT)"),
    ("annual_bonus_usd", "(c_custkey % 7) * 1000"),
    ("annual_equity_usd", "(c_custkey % 11) * 1000"),
    # stand-ins for the two model outputs, so that the rule chain can be checked alone
    ("model_usd", "CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE CAST(60000 + (c_custkey % 50) * 731 AS DOUBLE) END"),
    ("model_no_skills_usd", "CAST(58000 + (c_custkey % 40) * 911 AS DOUBLE)"),
]

HISTORY = [
    ("id", "event_id"), ("user_id", "user_id"), ("job_id", "event_id % 50"), ("kind", "event_type"),
    ("payload", "props"), ("created_at", "CAST(ts AS TIMESTAMP)"),
]

_FAILED = "event_id % 6 = 0"
HEALTH = [
    ("event_id", "event_id"), ("source", "event_type"),
    ("keyword", pick("user_id % 3", "'data scientist'", "'data engineer'", other="'qa engineer'")),
    ("city", pick("user_id % 4", "'London, UK'", "'Singapore'", "'Berlin, Germany'", other="'Toronto, Canada'")),
    ("status", f"CASE WHEN {_FAILED} THEN 'failed' ELSE 'success' END"),
    ("jobs_found", f"CASE WHEN {_FAILED} THEN 0 ELSE event_id % 20 END"),
    ("salary_hits", f"CASE WHEN {_FAILED} THEN 0 ELSE event_id % 7 END"),
    ("duration_sec", "value"), ("ts", "CAST(ts AS TIMESTAMP)"),
]

PREDICTIONS = [
    ("id", "l_orderkey"), ("n", "l_linenumber"), ("y", "l_extendedprice"), ("pred", "l_quantity * 1500"),
    ("model", pick("l_linenumber % 3", "'forest'", "'boosted'", other="'linear'")),
]

RESUMES = [
    ("resume_id", "conv_id * 1000 + turn"),
    ("text", "text || " + pick(
        "(conv_id + turn) % 9", "' Senior data scientist.'", "' DevOps and SRE work.'", "' full-stack apps'",
        "' React developer'", "' knows Tableau and Docker'", "' product owner'", other="''")),
    ("job_title", pick("conv_id % 3", "NULL", "'  '", other="'Data Engineer'")),
    ("experience_years", pick("conv_id % 6", "NULL", "'3-5 years'", "'Not mentioned'", "'7'", "'2.5 to 4'", other="'10+'")),
    ("skills", pick("conv_id % 5", "'PyTorch,NLP'", "'Python,SQL'", "'react,javascript'", "'GenAI,aws,docker'")),
]

_JOB = ("'{\"id\":\"j' || CAST(page_id AS STRING) || '-{n}\",\"title\":' || {title} || ',\"minTotalSalary\":' || {lo} || "
        "',\"maxTotalSalary\":' || {hi} || ',\"minBaseSalary\":' || CAST(80000 + page_id AS STRING) || ',\"maxBaseSalary\":' || "
        "CAST(90000 + page_id AS STRING) || ',\"locations\":' || {loc} || ',\"workArrangement\":\"' || {arr} || "
        "'\",\"applicationUrl\":\"http://example.org/a' || CAST(page_id AS STRING) || '\",\"postingDate\":\"2024-01-0{n}\"}}'")


def _job(n, title, lo, hi, loc, arr):
    out = _JOB.replace("{n}", str(n)).replace("{title}", title).replace("{lo}", lo).replace("{hi}", hi)
    return out.replace("{loc}", loc).replace("{arr}", arr).replace("}}", "}")


_SCRIPT = (
    "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\":{\"pageProps\":{\"initialJobsData\":{\"totalMatchingJobs\":2,"
    "\"results\":[{\"companyName\":\"Company ' || CAST(page_id % 50 AS STRING) || '\",\"companyType\":\"public\",\"employeeCount\":' || "
    "CAST(page_id * 3 AS STRING) || ',\"jobs\":[' || "
    + _job(1, "'\"Senior Engineer ' || CAST(page_id % 7 AS STRING) || '\"'", "CAST(100000 + page_id AS STRING)",
           "CAST(140000 + page_id AS STRING)", "'[\"Austin\",\"Remote\"]'",
           pick("page_id % 3", "'remote'", "'Hybrid'", other="'office'"))
    + " || ',' || "
    + _job(2, "CASE WHEN page_id % 9 = 0 THEN 'null' ELSE '\"Data Analyst\"' END", "'null'", "'null'", "'[]'", "'office'")
    + " || ']}]}}}}</script>'"
)
_ANCHOR = ("'<a class=\"x\" href=\"/research/US/Job=Data_Scientist/Salary/ab12cd/Acme\">Acme ' || CAST({n} AS STRING) || "
           "' IncAvg. Salary: $' || CAST(({pay}) / 1000 AS STRING) || ',' || lpad(CAST(({pay}) % 1000 AS STRING), 3, '0') || '</a>'")


def _anchor(n, pay):
    return _ANCHOR.replace("{n}", n).replace("{pay}", pay)


# integer division differs between engines, so thousands are cut with floor
_ANCHOR = _ANCHOR.replace("CAST(({pay}) / 1000 AS STRING)", "CAST(CAST(floor(({pay}) / 1000) AS BIGINT) AS STRING)")

PAGES = [
    ("page_id", "page_id"), ("url", "url"),
    ("html", "html || CASE WHEN page_id % 5 = 4 THEN '' ELSE " + _SCRIPT + " END"
     " || CASE WHEN page_id % 4 = 3 THEN '' ELSE " + _anchor("page_id % 20", "90000 + page_id * 10") + " || "
     + _anchor("page_id % 20", "70000 + page_id") + " || " + _anchor("page_id % 20 + 100", "101000 + page_id") + " END"
     " || '<span class=\"paycharts__value\">$' || CAST(80000 + page_id AS STRING) || '</span>'"
     " || '<div class=\"tablerow__value\">Base Salary: $' || CAST(60 + page_id % 40 AS STRING) || 'k - $' || CAST(110 + page_id % 40 AS STRING) || 'k</div>'"
     " || '<div class=\"job_card\"><h2 class=\"title\">Senior  Data Engineer ' || CAST(page_id % 6 AS STRING) || '</h2><span class=\"company\">Acme '"
     " || CAST(page_id % 30 AS STRING) || '</span><span class=\"location\">Town ' || CAST(page_id % 8 AS STRING) || '</span><a class=\"go\" href=\"' || CASE WHEN page_id % 2 = 0 THEN 'http://example.org' ELSE '' END || '/view/' || CAST(page_id AS STRING) || '\"></a><p class=\"snippet\">'"
     " || CASE WHEN page_id % 2 = 0 THEN 'Remote or hybrid, ' ELSE '' END || CAST(page_id % 6 + 2 AS STRING) || '+ years of Python and Spark, $' || CAST(50 + page_id % 50 AS STRING)"
     " || 'k - $' || CAST(120 + page_id % 50 AS STRING) || 'k' || CASE WHEN page_id % 3 = 0 THEN ' plus bonus' ELSE '' END || '</p></div>'"
     " || CASE WHEN page_id % 6 = 1 THEN '<div class=\"salary-estimate\">Est. $' || CAST(30 + page_id % 20 AS STRING) || ' per hour</div>' ELSE '' END"),
    ("keyword", pick("page_id % 3", "'data scientist'", "'data engineer'", other="'senior qa engineer'")),
    ("location", pick("page_id % 4", "'London, UK'", "'Singapore'", "'Berlin, Germany'", other="'Nowhere'")),
    ("usd_rate", "CAST(" + pick("page_id % 4", "1.27", "0.74", "1.08", other="1.0") + " AS DOUBLE)"),
]

DETAILS = [
    ("id", K), ("job_title", dict(JOBS)["job_title"]), ("company_name", "c_name"), ("location", "n_name"),
    ("card_salary", f"CASE WHEN {K} % 3 = 0 THEN '$' || {text(f'{P}/1000')} || 'k' ELSE NULL END"),
    ("detail_salary", f"CASE WHEN {K} % 4 = 0 THEN '£' || {text(f'{P}/2080')} || ' per hour' WHEN {K} % 4 = 1 THEN 'Full-time job' ELSE NULL END"),
    ("description", f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE 'We need ' || CAST({K} % 12 + 1 AS STRING) || CASE WHEN {K} % 2 = 0 THEN '+ years' ELSE ' days' END "
        f"|| ' of Java and Docker. Pay USD ' || {text(P)} || '. ' || CASE WHEN {K} % 5 = 0 THEN 'Hybrid, remote days, RSU grants. Bachelor''s degree. Part-time possible' ELSE 'On the spot' END END"),
    ("card_snippet", f"CASE WHEN {K} % 6 = 0 THEN 'Contract · Permanent' ELSE NULL END"),
    ("detail_snippet", f"CASE WHEN {K} % 6 = 1 THEN 'Job type Temporary' ELSE NULL END"),
    ("job_link", f"'http://example.org/viewjob?jk=' || lower(substring(md5(CAST({K} AS STRING)), 1, 16)) || '&from=x'"),
    ("date_text", f"CASE {K} % 3 WHEN 0 THEN 'Posted 3 days ago' WHEN 1 THEN 'EmployerActive' ELSE 'Today' END"),
    ("usd_rate", f"CAST(CASE WHEN {K} % 4 = 0 THEN 1.27 ELSE 1.0 END AS DOUBLE)"),
]


def project(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in columns])


class Tables:
    """Lazy access to the test tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table, one file or a folder of them, as an incremental file source.

        The path is a pattern for the table's own name, which file streams need for a single file.
        """
        schema = self.table(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    def sold(self, orders: DataFrame | None = None) -> DataFrame:
        """Orders with customer, nation and region; the dimensions are broadcast by size."""
        orders = self.table("orders") if orders is None else orders
        return (orders.join(self.table("customer"), F.expr("o_custkey = c_custkey"))
                .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
                .join(self.table("region"), F.expr("n_regionkey = r_regionkey")))

    @cached_property
    def jobs(self) -> DataFrame:
        return project(self.sold(), JOBS)

    def jobs_stream(self) -> DataFrame:
        return project(self.sold(self.stream("orders")), JOBS)

    @cached_property
    def raw(self) -> DataFrame:
        base = project(self.jobs, RAW)
        return base.unionByName(project(base.where("id % 10 = 0"), COPIES))

    @cached_property
    def bulk(self) -> DataFrame:
        return project(self.sold(), BULK)

    @cached_property
    def offers(self) -> DataFrame:
        return project(self.table("customer").join(self.table("nation"), F.expr("c_nationkey = n_nationkey")), OFFERS)

    @cached_property
    def history(self) -> DataFrame:
        return project(self.table("events"), HISTORY)

    @cached_property
    def health(self) -> DataFrame:
        return project(self.table("events"), HEALTH)

    @cached_property
    def predictions(self) -> DataFrame:
        return project(self.table("lineitem"), PREDICTIONS)

    @cached_property
    def resumes(self) -> DataFrame:
        return project(self.table("conversations").where("role = 'user'"), RESUMES)

    @cached_property
    def pages(self) -> DataFrame:
        return project(self.table("pages"), PAGES)

    @cached_property
    def details(self) -> DataFrame:
        return project(self.sold(), DETAILS)


# --- the same views as CTE text for the SQL check -----------------------------
_SOLD = ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
         "JOIN region ON n_regionkey = r_regionkey")


def _select(columns, source):
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns) + f" FROM {source}"


CTES = {
    "jobs": _select(JOBS, _SOLD),
    "raw0": _select(RAW, "jobs"),
    "raw": "SELECT * FROM raw0 UNION ALL " + _select(COPIES, "raw0 WHERE id % 10 = 0"),
    "bulk": _select(BULK, _SOLD),
    "offers": _select(OFFERS, "customer JOIN nation ON c_nationkey = n_nationkey"),
    "history": _select(HISTORY, "events"),
    "health": _select(HEALTH, "events"),
    "predictions": _select(PREDICTIONS, "lineitem"),
    "resumes": _select(RESUMES, "conversations WHERE role = 'user'"),
    "crawl": _select(PAGES, "pages"),
    "details": _select(DETAILS, _SOLD),
}
CTE_NEEDS = {"raw0": ["jobs"], "raw": ["jobs", "raw0"]}


def with_views(names: str, body: str) -> str:
    """Prefix a query with the named view definitions; ``body`` may add CTEs after "WITH "."""
    wanted: list[str] = []
    for name in names.split():
        for n in CTE_NEEDS.get(name, []) + [name]:
            if n not in wanted:
                wanted.append(n)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
