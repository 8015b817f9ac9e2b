"""Pay scoring of requests and offers: model output plus fixed adjustments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as X
from .lookups import company_tier, skill_bonuses, total_premium


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def first_word(c: Column, table: list, default) -> Column:
    """Value of the first entry whose word (or one of whose words) is contained."""
    out = None
    for words, value in table:
        hit = X.contains_any(c, [words] if isinstance(words, str) else words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def employment_multiplier(c: Column) -> Column:
    return first_word(low(c), vocab.EMPLOYMENT_MULTIPLIERS, 1.0)


def seniority_adjustment(c: Column) -> Column:
    return first_word(low(c), vocab.SENIORITY_ADJUSTMENTS, 0)


def experience_adjustment(years: Column) -> Column:
    """4,500 per year up to 3, 3,500 up to 8, 2,000 beyond; a missing value adds nothing."""
    y = years.cast("int")
    return (F.when(y <= 3, y * 4500).when(y <= 8, 13500 + (y - 3) * 3500)
            .when(y > 8, 31000 + (y - 8) * 2000).otherwise(0))


def city_adjustment(c: Column) -> Column:
    return first_word(low(c), vocab.CITY_ADJUSTMENTS, 0)


def role_adjustment(c: Column) -> Column:
    return first_word(low(c), vocab.ROLE_ADJUSTMENTS, 0)


def tier_bonus(company: Column) -> Column:
    tier = company_tier(company)
    return F.when(tier == 1, vocab.TIER_BONUS[1]).when(tier == 2, vocab.TIER_BONUS[2]).otherwise(vocab.TIER_BONUS[3])


def education_adjustment(c: Column) -> Column:
    return first_word(low(c), vocab.EDUCATION_ADJUSTMENTS, 0)


def remote_adjustment(c: Column) -> Column:
    return F.when(low(c).contains("remote"), vocab.REMOTE_ADJUSTMENT).otherwise(0)


ADDED = {
    "seniority_adjustment": ("seniority_level", seniority_adjustment),
    "experience_adjustment": ("experience_years", experience_adjustment),
    "city_adjustment": ("city", city_adjustment),
    "role_adjustment": ("job_title", role_adjustment),
    "company_tier_bonus": ("company_name", tier_bonus),
    "academic_bonus": ("education_required", education_adjustment),
    "remote_adjustment": ("remote_type", remote_adjustment),
}


def adjustments(requests: DataFrame) -> DataFrame:
    """All additive parts, the multiplier and the skill premium as columns."""
    bonuses = skill_bonuses(F.coalesce(F.col("skills"), F.array().cast("array<string>")))
    out = requests.withColumns({name: rule(F.col(column)) for name, (column, rule) in ADDED.items()})
    return out.withColumns({
        "employment_multiplier": employment_multiplier(F.col("employment_type")),
        "company_tier": company_tier(F.col("company_name")),
        "skill_bonuses": bonuses, "total_skill_premium": total_premium(bonuses),
    })


def boosted(model: Column, base: Column, premium: Column) -> Column:
    return F.greatest(F.coalesce(model, F.lit(0.0)), base + premium * vocab.SKILL_PREMIUM_SHARE)


def final_prediction(requests: DataFrame, model: str = "model_usd", base: str = "model_no_skills_usd") -> DataFrame:
    """Combine the two model outputs with the adjustments; see the README for the rule."""
    out = adjustments(requests)
    added = sum((F.col(c) for c in ADDED), F.lit(0))
    base_pay = F.coalesce(F.col(base), F.lit(float(vocab.BASE_PAY_DEFAULT)))
    scored = F.coalesce(F.col(model), F.lit(0.0)) != 0

    def settle(pay: Column) -> Column:
        return F.greatest(F.lit(vocab.PAY_FLOOR), ((pay + added) * F.col("employment_multiplier")).cast("bigint"))

    out = out.withColumn("predicted_salary_usd", F.when(
        scored, settle(boosted(F.col(model), base_pay, F.col("total_skill_premium")))).otherwise(settle(base_pay)))
    pay = F.col("predicted_salary_usd")
    return out.withColumns({
        "model_prediction_usd": F.coalesce(F.col(model), F.lit(0.0)).cast("bigint"),
        "adjusted_prediction_usd": pay,
        "base_prediction_usd": base_pay.cast("bigint"),
        "confidence_low": (pay * F.when(scored, vocab.BAND_MODEL[0]).otherwise(vocab.BAND_FALLBACK[0])).cast("bigint"),
        "confidence_high": (pay * F.when(scored, vocab.BAND_MODEL[1]).otherwise(vocab.BAND_FALLBACK[1])).cast("bigint"),
        "confidence_method": F.when(scored, "model_plus_market_heuristics").otherwise("fallback_percentage_band"),
        "adjustments": F.struct(*ADDED, "total_skill_premium", "employment_multiplier"),
    })


def analyze_offers(offers: DataFrame, market: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Total compensation against the market reference, else against the prediction.

    ``offers`` carries ``predicted_salary_usd``; ``market`` one row per request.
    """
    out = offers.join(market, request_id, "left")
    total = F.col("base_salary_usd") + F.coalesce("annual_bonus_usd", F.lit(0)) + F.coalesce("annual_equity_usd", F.lit(0))
    reference = F.coalesce(F.nullif("market_salary_usd", F.lit(0)), F.col("predicted_salary_usd"))
    out = out.withColumns({"total_comp_usd": total, "market_reference_usd": reference})
    out = out.withColumn("difference_usd", F.col("total_comp_usd") - F.col("market_reference_usd"))
    out = out.withColumn("difference_pct", F.coalesce(
        F.round(F.col("difference_usd") / F.nullif("market_reference_usd", F.lit(0)) * 100, 1), F.lit(0.0)))
    pct = F.col("difference_pct")
    verdict = F.when(pct >= vocab.OFFER_STRONG_PCT, "strong").when(pct >= vocab.OFFER_FAIR_PCT, "fair").otherwise("low")
    return out.withColumns({"verdict": verdict, "evidence_count": F.coalesce("evidence_count", F.lit(0))})
