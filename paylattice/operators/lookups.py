"""Joins with dimensions.

Dimensions whose whole content is a constant of this package are broadcast
(a dozen rows) or used as CASE literals.  Everything learned from data is joined
without a hint, so its real size decides the strategy at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import experience as E
from ..functions import text as X

LISTING_TITLE = 4  # shortest title word that can stand for the title


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.CITIES, "city string, city_display string, city_currency string, usd_rate double")


def stamp_city(jobs: DataFrame) -> DataFrame:
    """Display name, currency and USD rate of the search city."""
    return jobs.join(F.broadcast(cities(jobs.sparkSession)), "city", "left")


def col_index_city(jobs: DataFrame, column: str = "city", name: str = "col_index") -> DataFrame:
    return jobs.withColumn(name, E.lookup(F.col(column), vocab.CITY_COST, vocab.CITY_COST_DEFAULT))


def seniority_score(jobs: DataFrame, ignore_case: bool = False) -> DataFrame:
    return jobs.withColumn("seniority_score", E.seniority_score(F.col("seniority_level"), ignore_case))


def skill_bonuses(skills: Column) -> Column:
    """Array of (skill, bonus) for a request's skill array; unknown skills get the default."""
    return F.transform(skills, lambda s: F.struct(
        s.alias("skill"), E.lookup(s, vocab.SKILL_PREMIUMS, vocab.SKILL_PREMIUM_DEFAULT).cast("int").alias("bonus")))


def total_premium(bonuses: Column) -> Column:
    return F.aggregate(bonuses, F.lit(0), lambda acc, b: acc + b["bonus"])


def skill_premium_join(requests: DataFrame, skills: str = "skills") -> DataFrame:
    """Premium per requested skill and in total; the premium table is a literal, so nothing moves."""
    bonuses = skill_bonuses(F.coalesce(F.col(skills), F.array().cast("array<string>")))
    return requests.withColumn("skill_bonuses", bonuses).withColumn("total_skill_premium", total_premium(F.col("skill_bonuses")))


def company_tier(company: Column) -> Column:
    """Tier by name fragment, first tier first."""
    name = F.lower(F.coalesce(company, F.lit("")))
    return (F.when(name.rlike("|".join(vocab.TIER1_COMPANIES)), 1)
            .when(name.rlike("|".join(vocab.TIER2_COMPANIES)), 2).otherwise(3))


def skill_gap(resumes: DataFrame, skills: str = "skills", n: int = 5) -> DataFrame:
    """Best-paid skills a resume does not name, and the lift of the best three.

    The premium table is a seventeen-entry literal array in falling order, so the
    anti join is an array filter inside the row.
    """
    known = F.transform(F.coalesce(F.col(skills), F.array().cast("array<string>")), lambda s: F.lower(s))
    table = F.array(*[
        F.struct(F.lit(s).alias("skill"), F.lit(v).alias("estimated_lift_usd")) for s, v in vocab.SKILL_PREMIUMS.items()])
    out = resumes.withColumn("_known", known).withColumn(
        "missing_skills", F.slice(F.filter(table, lambda p: ~F.array_contains(F.col("_known"), F.lower(p["skill"]))), 1, n))
    return out.withColumn("estimated_top3_lift_usd", F.aggregate(
        F.slice("missing_skills", 1, 3), F.lit(0), lambda a, p: a + p["estimated_lift_usd"])).drop("_known")


def missing_skills(resumes: DataFrame, key: str, skills: str = "skills", n: int = 5) -> DataFrame:
    """One row per missing skill with its position."""
    return skill_gap(resumes, skills, n).select(key, F.posexplode("missing_skills").alias("_at", "_m")).select(
        key, (F.col("_at") + 1).alias("position"), F.col("_m.skill").alias("skill"),
        F.col("_m.estimated_lift_usd").alias("estimated_lift_usd"))


def match_presets(skills: Column) -> Column:
    """Given skills that are on the preset list, in the preset spelling."""
    names = {s.lower(): s for s in vocab.PRESET_SKILLS}
    return F.array_compact(F.transform(skills, lambda s: E.lookup(F.lower(s), names)))


def infer_title(text: Column, skills: Column) -> Column:
    """Target title: text patterns first, then skill groups (listed or named in the text)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    have = F.transform(F.coalesce(skills, F.array().cast("array<string>")), lambda s: F.lower(s))
    out = None
    for title, pattern in vocab.RESUME_TITLES:
        hit = low.rlike(f"(?U){pattern}")
        out = F.when(hit, title) if out is None else out.when(hit, title)
    for title, words in vocab.RESUME_SKILL_TITLES:
        listed = F.arrays_overlap(have, F.array(*[F.lit(w) for w in words]))
        out = out.when(F.coalesce(listed, F.lit(False)) | X.contains_any(low, words), title)
    return out.otherwise(vocab.RESUME_TITLE_DEFAULT)


def resume_defaults(resumes: DataFrame) -> DataFrame:
    """Complete extracted resume fields for scoring."""
    out = resumes.withColumn("experience_years", E.coerce_years(F.col("experience_years")))
    return out.withColumns({
        "seniority_level": E.years_to_seniority(F.col("experience_years")),
        "job_title": F.when(X.strip(F.coalesce("job_title", F.lit(""))) == "", infer_title(F.col("text"), F.col("skills")))
        .otherwise(F.col("job_title")),
        "employment_type": F.lit("Full-time"), "remote_type": F.lit("On-site"),
        "has_equity": F.lit(False), "has_bonus": F.lit(False),
    })
