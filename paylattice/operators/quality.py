"""Health and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from .ranks import one_row

PAY = "salary_usd_numeric"


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, zero for an empty base."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def source_health(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Works on tables and on streams (complete mode)."""
    totals = events.groupBy(*(keys or ["source"])).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successes"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failures"),
        F.sum("jobs_found").alias("jobs_found"), F.sum("salary_hits").alias("salary_hits"),
        F.round(F.avg("duration_sec"), 2).alias("avg_duration_sec"),
    )
    return totals.withColumns({
        "success_rate_pct": percent(F.col("successes"), F.col("tasks")),
        "salary_hit_rate_pct": percent(F.col("salary_hits"), F.col("jobs_found")),
    })


def task_health(listings: DataFrame, keys: list[str]) -> DataFrame:
    """One record per collection task from the listings it returned."""
    hit = X.blank_to_null(F.col("salary")).isNotNull() | (F.coalesce(F.col(PAY), F.lit(0.0)) != 0)
    return listings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs_found"), F.count(F.when(hit, 1)).alias("salary_hits"),
    ).withColumn("salary_hit_rate_pct", percent(F.col("salary_hits"), F.col("jobs_found")))


def fill_rates(df: DataFrame, columns: list[str] | None = None, bands: tuple[float, float] = (70, 30)) -> DataFrame:
    """Filled values per column from one pass over the rows."""
    columns = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns])
    long = row.select("_total", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled")) for c in columns])))
    rate = F.col("filled") / F.col("_total") * 100
    return long.where(F.col("_total") > 0).select(
        "column", "filled", F.col("_total").alias("total"), F.round(rate, 1).alias("rate_pct"),
        F.when(rate > bands[0], "good").when(rate > bands[1], "fair").otherwise("poor").alias("band"))


def salary_fill(df: DataFrame) -> DataFrame:
    """Pay fill by source and by city, both from one scan."""
    sets = df.groupingSets([[F.col("source_website")], [F.col("city")]], F.col("source_website"), F.col("city"))
    out = sets.agg(
        F.grouping("source_website").alias("_by_city"),
        F.count("salary").alias("filled"), F.count(F.lit(1)).alias("total"))
    return out.select(
        F.when(F.col("_by_city") == 1, "city").otherwise("source").alias("dimension"),
        F.when(F.col("_by_city") == 1, F.col("city")).otherwise(F.col("source_website")).alias("value"),
        "filled", "total", percent(F.col("filled"), F.col("total"), 0).alias("rate_pct"),
    ).where(F.col("value").isNotNull())


def seniority_distribution(df: DataFrame) -> DataFrame:
    known = df.where(F.col("seniority_level").isNotNull())
    return known.groupBy("seniority_level").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "seniority_level")


def batch_top_skills(df: DataFrame, n: int = 15) -> DataFrame:
    skills = df.select(F.explode(F.split("skills_required", ", ")).alias("skill"))
    return skills.groupBy("skill").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(n)


def basic_stats(df: DataFrame) -> DataFrame:
    small = df.groupBy("source_website", "city").agg(F.count(F.lit(1)).alias("n"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct("source_website").alias("sources"),
        F.countDistinct("city").alias("cities"))


def training_readiness(df: DataFrame, **limits) -> DataFrame:
    """Is the collected data alone good enough to train on, and if not, why."""
    t = {**vocab.READINESS, **limits}
    small = df.groupBy("city", "seniority_level", "source_website").agg(
        F.count(F.lit(1)).alias("n"), F.count(PAY).alias("paid"))
    counts = small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("paid"), F.lit(0)).alias("salary_rows"),
        F.countDistinct("city").alias("cities_count"), F.countDistinct("seniority_level").alias("seniority_levels_count"))
    sources = small.groupBy(F.coalesce("source_website", F.lit("unknown")).alias("_s")).agg(F.sum("n").alias("_n"))
    top = sources.agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_s").alias("name"))).alias("_top"))
    row = one_row(counts, top.select(F.col("_top.name").alias("top_source"), (-F.col("_top.neg")).alias("_top_n")))
    row = row.select(
        "total_rows", "salary_rows", percent(F.col("salary_rows"), F.col("total_rows")).alias("salary_coverage_pct"),
        "cities_count", "seniority_levels_count", "top_source",
        F.when(F.col("total_rows") > 0, F.round(F.col("_top_n") / F.col("total_rows") * 100, 2))
        .otherwise(F.lit(100.0)).alias("top_source_pct"))
    checks = {
        "salary_rows": F.col("salary_rows") >= t["min_salary_rows"],
        "salary_coverage": F.col("salary_coverage_pct") >= t["min_salary_coverage_pct"],
        "cities": F.col("cities_count") >= t["min_cities"],
        "seniority_levels": F.col("seniority_levels_count") >= t["min_seniority_levels"],
        "source_balance": F.col("top_source_pct") <= t["max_single_source_pct"],
    }
    one_digit = {c: F.format_string("%.1f%%", F.col(c)) for c in ("salary_coverage_pct", "top_source_pct")}
    reasons = F.array_compact(F.array(
        F.when(~checks["salary_rows"], F.concat(
            F.lit(f"needs at least {t['min_salary_rows']:,} salary rows; found "), F.format_number("salary_rows", 0))),
        F.when(~checks["salary_coverage"], F.concat(
            F.lit(f"needs salary coverage >= {t['min_salary_coverage_pct']:.0f}%; found "), one_digit["salary_coverage_pct"])),
        F.when(~checks["cities"], F.concat(
            F.lit(f"needs at least {t['min_cities']} cities; found "), F.col("cities_count").cast("string"))),
        F.when(~checks["seniority_levels"], F.concat(
            F.lit(f"needs at least {t['min_seniority_levels']} seniority levels; found "),
            F.col("seniority_levels_count").cast("string"))),
        F.when(~checks["source_balance"], F.concat(
            F.lit("single source '"), F.coalesce(F.col("top_source"), F.lit("None")), F.lit("' dominates "),
            one_digit["top_source_pct"], F.lit(" of rows"))),
    ))
    row = row.withColumns({"checks": F.struct(*[c.alias(k) for k, c in checks.items()]), "reasons": reasons})
    return row.withColumn("ready", F.size("reasons") == 0)


def min_rows_gate(df: DataFrame, warn: int = vocab.ROWS_WARN, stop: int = vocab.ROWS_STOP) -> DataFrame:
    return df.agg(F.count(PAY).alias("salary_rows")).withColumn(
        "status", F.when(F.col("salary_rows") < stop, "stop").when(F.col("salary_rows") < warn, "warn").otherwise("ok"))
