"""Market questions over the jobs table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import experience as E
from ..functions import text as X
from .dedup import first_per
from .ranks import one_row, with_median

PAY = "salary_usd_numeric"


def nonzero(c: Column) -> Column:
    """Zero counts as absent, as in every optional amount of the responses."""
    return F.nullif(c, F.lit(0.0))


def money(c: Column) -> Column:
    """Two decimals.  The detour over a decimal takes out the noise that the order
    of a distributed sum leaves in the last bits, so ties always round alike."""
    return F.round(c.cast("decimal(28,8)"), 2).cast("double")


def contains_text(column: str, needle: str | None) -> Column:
    """Case-insensitive literal substring test; no needle, no restriction."""
    return F.lower(F.col(column)).contains(needle.lower()) if needle else F.lit(True)


def salary_by_city(jobs: DataFrame, keyword: str | None = None) -> DataFrame:
    rows = jobs.where(F.col("city").isNotNull() & contains_text("job_title", keyword))
    return with_median(rows, ["city"], PAY).select(
        "city", money(F.col("total") / F.col("n")).alias("avg_salary"), money(F.col("median")).alias("median_salary"),
        F.col("n").alias("job_count"),
        F.struct(money(F.col("low")).alias("min"), money(F.col("high")).alias("max")).alias("salary_range"),
    ).orderBy(F.desc("avg_salary"), "city")


def salary_by_seniority(jobs: DataFrame) -> DataFrame:
    rows = jobs.where(F.col("seniority_level").isNotNull())
    return with_median(rows, ["seniority_level"], PAY).select(
        "seniority_level", money(F.col("total") / F.col("n")).alias("avg_salary"),
        money(F.col("median")).alias("median_salary"), F.col("n").alias("count"),
        E.seniority_score(F.col("seniority_level"), ignore_case=True).alias("seniority_score"),
    ).orderBy("seniority_score", "seniority_level")


def remote_vs_onsite(jobs: DataFrame) -> DataFrame:
    kind = F.lower(F.col("remote_type"))
    names = {"remote": "remote", "hybrid": "hybrid", "onsite": "on-site"}
    paid = jobs.where(F.col(PAY).isNotNull() & kind.isNotNull())
    one = paid.agg(
        *[F.avg(F.when(kind == v, F.col(PAY))).alias(f"_{k}") for k, v in names.items()],
        *[F.count(F.when(kind == v, 1)).alias(f"{k}_count") for k, v in names.items()],
    )

    def premium(k: str) -> Column:
        base = F.when(F.col("_onsite") > 0, F.col("_onsite"))
        return money((nonzero(F.col(f"_{k}")) - base) / base * 100)

    return one.select(
        *[money(nonzero(F.col(f"_{k}"))).alias(f"{k}_avg") for k in names],
        premium("remote").alias("remote_premium_pct"), premium("hybrid").alias("hybrid_premium_pct"),
        *[f"{k}_count" for k in names],
    )


def market_summary(jobs: DataFrame) -> DataFrame:
    """Scalar part of the summary.

    Distinct counts come from a pre-aggregation on (city, source) instead of
    expanding every row; the median comes from the binned rank search.
    """
    small = jobs.groupBy("city", "source_website").agg(
        F.count(F.lit(1)).alias("n"), F.max("date_posted_raw").alias("last"))
    counts = small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_jobs"), F.countDistinct("city").alias("cities_count"),
        F.countDistinct("source_website").alias("sources_count"), F.max("last").alias("last_scraped"))
    pay = with_median(jobs, [], PAY)
    both = one_row(counts, pay)
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("total_jobs") * 100
    return both.select(
        "total_jobs", "cities_count", "sources_count",
        money(nonzero(F.col("low"))).alias("salary_min"), money(nonzero(F.col("high"))).alias("salary_max"),
        money(nonzero(F.col("total") / F.col("n"))).alias("salary_avg"),
        money(nonzero(F.col("median"))).alias("salary_median"),
        F.when(F.col("total_jobs") > 0, F.round(share, 1)).otherwise(F.lit(0.0)).alias("jobs_with_salary_pct"),
        "last_scraped",
    )


def top_companies(jobs: DataFrame, n: int = 10) -> DataFrame:
    named = jobs.where(F.col("company_name").isNotNull())
    counts = named.groupBy(F.col("company_name").alias("company")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "company").limit(n)


def skill_mentions(jobs: DataFrame, n: int = 10) -> DataFrame:
    """Every mention counts, repeated ones within a row too."""
    skills = jobs.select(F.explode(X.split_skills(F.col("skills_required"))).alias("skill"))
    return skills.groupBy("skill").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(n)


def top_skills(jobs: DataFrame, city: str | None = None, seniority: str | None = None, n: int = 30) -> DataFrame:
    """Pay with and without each skill.

    "Without" is total minus "with", so each row is read once per skill it
    names.  The two totals enter as scalar subqueries.
    """
    rows = jobs.where(
        F.col("skills_required").isNotNull() & contains_text("city", city) & contains_text("seniority_level", seniority)
    ).select(X.distinct_skills(F.col("skills_required")).alias("_skills"), PAY)
    totals = rows.agg(F.count(PAY).alias("_rows"), F.sum(PAY).alias("_pay"))
    per = rows.select(F.explode("_skills").alias("skill"), PAY).groupBy("skill").agg(
        F.count(F.lit(1)).alias("count"), F.count(PAY).alias("_n"), F.sum(PAY).alias("_s"))
    per = per.withColumns({
        "_rest_n": totals.select("_rows").scalar() - F.col("_n"),
        "_rest_s": totals.select("_pay").scalar() - F.coalesce(F.col("_s"), F.lit(0.0)),
    })
    with_skill = nonzero(F.col("_s") / F.nullif(F.col("_n"), F.lit(0)))
    without = nonzero(F.col("_rest_s") / F.nullif(F.col("_rest_n"), F.lit(0)))
    premium = F.when(without > 0, (with_skill - without) / without * 100)
    return per.select(
        "skill", "count", money(with_skill).alias("avg_salary_with_skill"),
        money(without).alias("avg_salary_without_skill"), money(premium).alias("salary_premium_pct"),
    ).orderBy(F.coalesce(F.col("salary_premium_pct"), F.lit(0.0)).desc(), "skill").limit(n)


# --- company profiles ---------------------------------------------------------

def company_profiles(jobs: DataFrame) -> DataFrame:
    """Pay profile of every company at once."""
    named = jobs.where(F.col("company_name").isNotNull())

    def share(condition: Column) -> Column:
        return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100, 1)

    counts = named.groupBy("company_name").agg(
        F.count(F.lit(1)).alias("job_count"), F.count(PAY).alias("salary_count"),
        share(F.col("has_equity") > 0).alias("equity_frequency_pct"),
        share(F.col("has_bonus") > 0).alias("bonus_frequency_pct"),
        share(F.lower(F.col("remote_type")).contains("remote")).alias("remote_frequency_pct"),
    )
    pay = with_median(named, ["company_name"], PAY)
    return counts.join(pay, "company_name", "left").select(
        "company_name", "job_count", "salary_count",
        money(nonzero(F.col("total") / F.col("n"))).alias("avg_salary"),
        money(nonzero(F.col("median"))).alias("median_salary"),
        money(nonzero(F.col("low"))).alias("salary_min"), money(nonzero(F.col("high"))).alias("salary_max"),
        "equity_frequency_pct", "bonus_frequency_pct", "remote_frequency_pct",
    )


def company_profile(jobs: DataFrame, name: str) -> DataFrame:
    """Profile of the most frequent company whose name contains the text."""
    found = jobs.where(contains_text("company_name", name))
    return company_profiles(found).orderBy(F.desc("job_count"), "company_name").limit(1)


def company_top(jobs: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent titles or cities of every company."""
    groups = jobs.where(F.col("company_name").isNotNull()).groupBy("company_name", column).agg(
        F.count(F.lit(1)).alias("count"), money(nonzero(F.avg(PAY))).alias("avg_salary"))
    return first_per(groups, ["company_name"], [F.desc("count"), F.col(column).asc_nulls_last()], n, rank="position")


def company_recent(jobs: DataFrame, n: int = 6) -> DataFrame:
    named = jobs.where(F.col("company_name").isNotNull())
    return first_per(named, ["company_name"], [F.col("scraped_at").desc_nulls_last(), "id"], n, rank="position")


# --- shapes for display -------------------------------------------------------

def whole(c: Column) -> Column:
    """Nearest whole number, halves up, as the charts round."""
    return F.floor(c + 0.5)


def chart_city(by_city: DataFrame, n: int = 15) -> DataFrame:
    return by_city.orderBy(F.desc("avg_salary"), "city").limit(n).select(
        F.substring_index("city", ",", 1).alias("city"), whole(F.col("avg_salary")).alias("avg_salary"),
        whole(F.col("median_salary")).alias("median_salary"))


def chart_top_skills(skills: DataFrame, n: int = 15, min_count: int = 3) -> DataFrame:
    shown = skills.where(F.col("salary_premium_pct").isNotNull() & (F.col("count") >= min_count))
    return shown.orderBy(F.desc("salary_premium_pct"), "skill").limit(n).select(
        "skill", (whole(F.col("salary_premium_pct") * 10) / 10).alias("premium"))


def home_top_skills(skills: DataFrame, n: int = 5) -> DataFrame:
    return skills.where(F.col("salary_premium_pct").isNotNull()).orderBy(F.desc("salary_premium_pct"), "skill").limit(n)


def chart_seniority(by_level: DataFrame) -> DataFrame:
    return by_level.select(
        X.strip(F.substring_index("seniority_level", "(", 1)).alias("level"),
        whole(F.col("avg_salary")).alias("avg_salary"), whole(F.col("median_salary")).alias("median_salary"), "count")


def chart_remote(comparison: DataFrame) -> DataFrame:
    def bar(label: str, k: str) -> Column:
        return F.struct(
            F.lit(label).alias("type"), whole(F.coalesce(F.col(f"{k}_avg"), F.lit(0.0))).alias("salary"),
            F.coalesce(F.col(f"{k}_count"), F.lit(0)).alias("count"))

    return comparison.select(F.inline(F.array(
        bar("Remote", "remote"), bar("Hybrid", "hybrid"), bar("On-site", "onsite"))))


def salary_histogram(jobs: DataFrame, width: int = 20000) -> DataFrame:
    """Counts per bin from the lowest to the highest occupied one, empty bins included."""
    pay = jobs.where(F.col(PAY) > 0)
    counts = pay.groupBy((F.floor(F.col(PAY) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    first, last = counts.agg(F.min("bin"), F.max("bin")).first()
    spark = jobs.sparkSession
    bins = spark.range(first, last + width, width).toDF("bin") if first is not None else spark.range(0).toDF("bin")
    return bins.join(counts, "bin", "left").select(
        "bin", F.concat(F.lit("$"), (F.col("bin") / 1000).cast("bigint").cast("string"), F.lit("k-$"),
                        ((F.col("bin") + width) / 1000).cast("bigint").cast("string"), F.lit("k")).alias("range"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("count")).orderBy("bin")
