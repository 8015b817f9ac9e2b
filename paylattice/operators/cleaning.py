"""Cleaning of collected listings, one step per function, one shuffle in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import experience as E
from ..functions import metadata as M
from ..functions import salary as S
from ..functions import text as X
from .dedup import keep_with_salary, with_key


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.where(F.length("job_title") >= 3)


def deduplicate(df: DataFrame) -> DataFrame:
    return keep_with_salary(with_key(df))


def clean_titles(df: DataFrame) -> DataFrame:
    return df.withColumn("job_title", X.clean_title(F.col("job_title")))


def clean_companies(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "company_name_raw": F.col("company_name"),
        "company_name": X.clean_company(F.col("company_name")),
    })


def clean_salary(df: DataFrame, usd_rate: Column | float = 1.0) -> DataFrame:
    """The text was converted at collection time, hence the default rate of one."""
    return df.withColumn("salary_usd_numeric", S.keep_or_parse(F.col("salary_usd_numeric"), F.col("salary"), usd_rate))


def with_footer(df: DataFrame) -> DataFrame:
    """Read the description once; both following steps use the struct."""
    return df.withColumn("_footer", M.footer(F.col("job_description")))


def fix_seniority(df: DataFrame) -> DataFrame:
    label = F.lower(X.strip(F.col("_footer.seniority_raw")))
    return df.withColumn("seniority_level", F.coalesce(
        X.blank_to_null(F.col("seniority_level")),
        E.lookup(label, vocab.SENIORITY_BY_PLATFORM_LABEL),
        E.infer_seniority(F.col("job_title")),
    ))


def fix_metadata(df: DataFrame) -> DataFrame:
    def fill(column: str, default: str | None = None) -> Column:
        parts = [X.blank_to_null(F.col(column)), F.col(f"_footer.{column}")]
        return F.coalesce(*parts, F.lit(default)) if default else F.coalesce(*parts, F.col(column))

    return df.withColumns({
        "employment_type": fill("employment_type", "Full-time"),
        "remote_type": fill("remote_type", "On-site"),
        "industry": fill("industry"),
        "education_required": fill("education_required"),
    })


def fix_equity_bonus(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("job_description"), F.lit(""))
    return df.withColumns({
        "has_equity": M.rescan_flag(F.col("has_equity"), text, vocab.RESCAN_EQUITY),
        "has_bonus": M.rescan_flag(F.col("has_bonus"), text, vocab.RESCAN_BONUS),
    })


def normalize_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("source_website", X.normalize_source(F.col("source_website")))


def clean_jobs(df: DataFrame) -> DataFrame:
    """All steps in order.  Deduplication runs before the text work, on fewer rows after it."""
    steps = [
        drop_invalid, deduplicate, clean_titles, clean_companies, clean_salary, with_footer,
        fix_seniority, fix_metadata, fix_equity_bonus, normalize_sources,
    ]
    for step in steps:
        df = df.transform(step)
    return df.drop("_footer")


def validate_records(df: DataFrame) -> DataFrame:
    """Per record: list of issues and whether it is free of them."""
    title, link, source = X.strip(F.col("job_title")), X.strip(F.col("job_link")), F.col("source_website")
    pay = F.col("salary_usd_numeric")
    issues = F.array_compact(F.array(
        F.when(F.coalesce(title, F.lit("")) == "", "job_title"),
        F.when(~F.coalesce(link.startswith("http"), F.lit(False)), "job_link"),
        F.when(~F.coalesce(source.isin(*vocab.VALID_SOURCES), F.lit(False)), "source_website"),
        F.when(~pay.between(vocab.PAY_MIN, vocab.PAY_MAX), "salary_usd_numeric"),
    ))
    return df.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)
