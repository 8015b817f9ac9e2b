"""Mapping of the bulk job-description file to the listing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import experience as E
from ..functions import metadata as M
from ..functions import salary as S
from ..functions import text as X

# bulk column -> listing column, copied as it is
RENAMED = {
    "Job Id": "job_id", "Job Title": "job_title", "Role": "role", "Company": "company_name",
    "location": "location", "Country": "country", "latitude": "latitude", "longitude": "longitude",
    "Job Posting Date": "date_posted_raw", "Job Description": "job_description", "skills": "skills_raw",
    "Benefits": "benefits_raw", "Responsibilities": "responsibilities", "Preference": "gender_preference",
    "Company Profile": "company_profile_raw", "Contact Person": "contact_person", "Contact": "contact",
}
EMPTY = ["job_link", "linkedin_seniority_raw", "job_type_raw", "salary_raw", "experience_raw",
         "company_industry", "industry"]
# bulk columns that are read by later steps and then dropped
CARRIED = {"Salary Range": "_range", "Experience": "_experience", "Qualifications": "_qualification",
           "Work Type": "_work", "Job Portal": "_portal"}


def keep_countries(df: DataFrame, column: str = "country") -> DataFrame:
    return df.where(F.col(column).isin(*vocab.BULK_COUNTRIES))


def map_columns(df: DataFrame) -> DataFrame:
    """Renames, the city copy, numeric size, constant currency, empty columns."""
    def source(name: str):
        return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")

    return df.select(
        *[source(a).alias(b) for a, b in RENAMED.items()],
        *[source(a).alias(b) for a, b in CARRIED.items()],
        source("location").alias("city"),
        source("Company Size").try_cast("double").alias("company_size"),
        F.lit("USD").alias("salary_currency"), F.lit("USD").alias("currency"),
        *[F.lit(None).cast("string").alias(c) for c in EMPTY],
    )


def country_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_of_living_index", E.lookup(
        X.strip(F.col("country")), vocab.COUNTRY_COST, vocab.COUNTRY_COST_DEFAULT))


def adjust_salary(df: DataFrame) -> DataFrame:
    adjusted = S.range_midpoint(F.col("_range")) * (F.col("cost_of_living_index") / vocab.COUNTRY_COST_BASE)
    return df.withColumn("salary_usd_numeric", adjusted).withColumn("salary", S.salary_label(F.col("salary_usd_numeric")))


def drop_outliers(df: DataFrame) -> DataFrame:
    pay = F.col("salary_usd_numeric")
    return df.where(pay.isNull() | pay.between(*vocab.BULK_PAY_RANGE))


def map_education(df: DataFrame) -> DataFrame:
    return df.withColumn("education_required", E.lookup(F.col("_qualification"), vocab.EDUCATION_BY_QUALIFICATION))


def map_work_type(df: DataFrame) -> DataFrame:
    work, (full, onsite) = X.strip(F.col("_work")), vocab.WORK_TYPE_DEFAULT
    return df.withColumns({
        "employment_type": E.lookup(work, {k: v[0] for k, v in vocab.WORK_TYPES.items()}, full),
        "remote_type": E.lookup(work, {k: v[1] for k, v in vocab.WORK_TYPES.items()}, onsite),
    })


def derive_fields(df: DataFrame) -> DataFrame:
    benefits = F.concat_ws(" ", F.coalesce("benefits_raw", F.lit("")), F.coalesce("job_description", F.lit("")))
    title = F.col("job_title")
    return df.withColumns({
        "experience_required": E.bulk_experience(F.col("_experience")),
        "seniority_level": F.when(title.isNotNull(), E.infer_seniority(title)),
        "is_faang": M.faang_flag(F.col("company_name")),
        "has_equity": M.flag(benefits.rlike(f"(?i){vocab.BULK_EQUITY}")),
        "has_bonus": M.flag(benefits.rlike(f"(?i){vocab.BULK_BONUS}")),
        "source_website": F.coalesce(X.blank_to_null(X.strip(F.col("_portal"))), F.lit(vocab.BULK_SOURCE_DEFAULT)),
        "skills_required": X.extract_skills(F.col("skills_raw")),
        "company_size_category": M.size_category(F.col("company_size")),
        "dedup_key": X.key_of(F.col("company_name"), title, F.col("location")),
    })


def load_bulk(df: DataFrame) -> DataFrame:
    """Whole mapping; all filters sit on source columns or cheap expressions, no shuffle."""
    out = (
        df.transform(map_columns).transform(keep_countries).where(F.length("job_title") >= 3)
        .transform(country_cost).transform(adjust_salary).transform(drop_outliers)
        .transform(map_education).transform(map_work_type).transform(derive_fields)
    )
    return out.drop(*CARRIED.values())


def bulk_summary(loaded: DataFrame) -> DataFrame:
    """Rows, pay fill, distinct countries and titles.

    One pre-aggregation on (country, title) feeds every figure, so distinct
    counting does not multiply the input rows.
    """
    small = loaded.groupBy("country", "job_title").agg(
        F.count(F.lit(1)).alias("n"), F.count("salary_usd_numeric").alias("paid"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("paid"), F.lit(0)).alias("salary_rows"),
        F.round(F.sum("paid") / F.sum("n") * 100, 1).alias("salary_fill_pct"),
        F.countDistinct("country").alias("countries"),
        F.countDistinct("job_title").alias("titles"),
    )


def top_roles(loaded: DataFrame, n: int = 5) -> DataFrame:
    counts = loaded.where(F.col("role").isNotNull()).groupBy("role").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "role").limit(n)
