"""Filtered, ordered and paged search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import salary as S
from ..functions import text as X
from .insights import contains_text

LISTED = [
    "id", "job_title", "company_name", "city", "salary", "salary_usd_numeric", "seniority_level",
    "experience_required", "remote_type", "employment_type", "skills_required", "source_website",
    "job_link", "has_equity", "has_bonus", "is_faang", "industry",
]


def predicate(keyword: str | None = None, city: str | None = None, min_salary: float | None = None,
              max_salary: float | None = None, remote_type: str | None = None, seniority_level: str | None = None,
              skills: str | None = None, source: str | None = None) -> Column:
    """All given conditions together; an absent one does not restrict."""
    parts = []
    if keyword:
        parts.append(contains_text("job_title", keyword) | contains_text("company_name", keyword))
    if city:
        parts.append(contains_text("city", city))
    if min_salary is not None:
        parts.append(F.col("salary_usd_numeric") >= min_salary)
    if max_salary is not None:
        parts.append(F.col("salary_usd_numeric") <= max_salary)
    if remote_type:
        parts.append(F.lower(F.col("remote_type")) == remote_type.lower())
    if seniority_level:
        parts.append(contains_text("seniority_level", seniority_level))
    if source:
        parts.append(F.lower(F.col("source_website")) == source.lower())
    wanted = [s.strip() for s in (skills or "").split(",") if s.strip()]
    if wanted:
        parts.append(reduce(lambda a, b: a | b, [contains_text("skills_required", s) for s in wanted]))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(jobs: DataFrame, **filters) -> DataFrame:
    return jobs.where(predicate(**filters))


def listing(jobs: DataFrame) -> DataFrame:
    """The seventeen listed columns, flags as booleans."""
    def column(name: str) -> Column:
        if name not in jobs.columns:
            return F.lit(None).alias(name)
        c = F.col(name)
        return (c.cast("boolean") if name in ("has_equity", "has_bonus") else c).alias(name)

    return jobs.select(*[column(c) for c in LISTED])


def search_page(jobs: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """Rows with a link first, newest first."""
    no_link = F.when(F.coalesce(F.col("job_link"), F.lit("")) != "", 0).otherwise(1)
    found = search(jobs, **filters).orderBy(no_link, F.col("scraped_at").desc_nulls_last(), "id")
    return listing(found.offset((page - 1) * page_size).limit(page_size))


def search_total(jobs: DataFrame, page_size: int = 20, **filters) -> DataFrame:
    return search(jobs, **filters).agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / page_size).alias("pages"))


def job_by_id(jobs: DataFrame, job_id: int) -> DataFrame:
    return listing(jobs.where(F.col("id") == job_id))


def listing_card(jobs: DataFrame) -> DataFrame:
    """Card shape: first four skills, pay text or the formatted amount."""
    amount = F.nullif(F.col("salary_usd_numeric"), F.lit(0.0))
    return jobs.select(
        "id", F.slice(X.split_skills(F.col("skills_required")), 1, 4).alias("skills"),
        F.coalesce(X.blank_to_null(F.col("salary")), S.salary_label(amount)).alias("salary_text"))
