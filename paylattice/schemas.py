"""Table schemas.  Nothing is inferred at run time."""

from pyspark.sql import types as T

TEXT, NUM, INT, LONG, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()


def struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# raw listings as collected; the column order is the export order
LISTING = struct(
    ("job_title", TEXT), ("company_name", TEXT), ("city", TEXT), ("location", TEXT),
    ("salary", TEXT), ("salary_currency", TEXT), ("seniority_level", TEXT),
    ("experience_required", TEXT), ("employment_type", TEXT), ("remote_type", TEXT),
    ("industry", TEXT), ("education_required", TEXT), ("has_equity", NUM),
    ("has_bonus", NUM), ("has_remote_benefits", NUM), ("skills_required", TEXT),
    ("job_description", TEXT), ("job_link", TEXT), ("job_id", TEXT),
    ("source_website", TEXT), ("dedup_key", TEXT), ("is_faang", NUM),
    ("cost_of_living_index", NUM), ("date_posted_raw", TEXT), ("applicant_count", NUM),
    ("currency", TEXT),
)

# the stored jobs table
JOBS = struct(
    ("id", LONG), ("job_title", TEXT), ("company_name", TEXT), ("company_name_raw", TEXT),
    ("city", TEXT), ("location", TEXT), ("salary", TEXT), ("salary_currency", TEXT),
    ("salary_usd_numeric", NUM), ("seniority_level", TEXT), ("experience_required", TEXT),
    ("employment_type", TEXT), ("remote_type", TEXT), ("industry", TEXT),
    ("education_required", TEXT), ("has_equity", NUM), ("has_bonus", NUM),
    ("has_remote_benefits", NUM), ("skills_required", TEXT), ("job_description", TEXT),
    ("job_link", TEXT), ("job_id", TEXT), ("source_website", TEXT), ("dedup_key", TEXT),
    ("is_faang", NUM), ("cost_of_living_index", NUM), ("date_posted_raw", TEXT),
    ("applicant_count", NUM), ("currency", TEXT), ("scraped_at", TS),
)

# columns of the bulk job-description file that are read
BULK = struct(*[(name, TEXT) for name in (
    "Job Id", "Experience", "Qualifications", "Salary Range", "location", "Country",
    "latitude", "longitude", "Work Type", "Company Size", "Job Posting Date",
    "Preference", "Contact Person", "Contact", "Job Title", "Role", "Job Portal",
    "Job Description", "Benefits", "skills", "Responsibilities", "Company",
    "Company Profile",
)])

# embedded JSON payload of a crawled listing page
PAGE_PAYLOAD = struct(("props", struct(("pageProps", struct(("initialJobsData", struct(
    ("totalMatchingJobs", LONG),
    ("results", T.ArrayType(struct(
        ("companyName", TEXT), ("companyType", TEXT), ("employeeCount", LONG),
        ("jobs", T.ArrayType(struct(
            ("id", TEXT), ("title", TEXT), ("minTotalSalary", NUM), ("maxTotalSalary", NUM),
            ("minBaseSalary", NUM), ("maxBaseSalary", NUM), ("baseSalaryCurrency", TEXT),
            ("locations", T.ArrayType(TEXT)), ("workArrangement", TEXT),
            ("applicationUrl", TEXT), ("postingDate", TEXT),
        ))),
    ))),
)))))))
