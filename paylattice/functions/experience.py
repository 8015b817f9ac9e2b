"""Experience and seniority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .salary import strip_pay
from .text import blank_to_null, contains_any, let, strip


def lookup(c: Column, table: dict, default=None) -> Column:
    """Bounded lookup in a literal map, which evaluates ``c`` once (a CASE would once per entry)."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def experience(text: Column) -> Column:
    """Experience requirement named in a text."""
    return let(F.lower(strip_pay(text)), _experience)


def _experience(t: Column) -> Column:
    low = F.regexp_extract(t, vocab.EXP_RANGE, 1).try_cast("int")
    high = F.regexp_extract(t, vocab.EXP_RANGE, 2).try_cast("int")
    single = F.regexp_extract(t, vocab.EXP_SINGLE, 0)
    years = F.regexp_extract(t, vocab.EXP_SINGLE, 1).try_cast("int")
    return (
        F.when(t.contains("fresher") & t.rlike(r"(?U)\bfresher\b"), "Fresher")
        .when(t.contains("intern") & t.rlike(r"(?U)\bintern\b"), "Internship")
        .when(t.contains("entry") & t.rlike(r"(?U)\bentry\s+level\b"), "Entry Level")
        .when(~t.contains("year"), F.lit(None).cast("string"))
        .when((low < vocab.EXP_LIMIT) & (high < vocab.EXP_LIMIT),
              F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years")))
        .when(years < vocab.EXP_LIMIT,
              F.concat(years.cast("string"), F.when(single.contains("+"), "+ years").otherwise(" years")))
    )


def experience_midpoint(required: Column, description: Column) -> Column:
    """Years as a number; the description is read when the field is empty."""
    return let(strip(F.lower(F.coalesce(blank_to_null(required), experience(description)))), _midpoint)


def _midpoint(t: Column) -> Column:
    low = F.regexp_extract(t, vocab.EXP_TEXT_RANGE, 1).try_cast("double")
    high = F.regexp_extract(t, vocab.EXP_TEXT_RANGE, 2).try_cast("double")
    plus = F.regexp_extract(t, vocab.EXP_TEXT_PLUS, 1).try_cast("double")
    years = F.regexp_extract(t, vocab.EXP_TEXT_YEARS, 1).try_cast("double")
    return (
        F.when(contains_any(t, ["fresher", "internship"]), F.lit(0.0))
        .when(t.contains("entry"), F.lit(0.5))
        .when(low.isNotNull(), (low + high) / 2)
        .when(plus.isNotNull(), plus + 1.0)
        .otherwise(years)
    )


def bulk_experience(text: Column) -> Column:
    """"5 to 15 Years" -> "5-15 years", anything else is read as free text."""
    low, high = F.regexp_extract(text, vocab.EXP_BULK, 1), F.regexp_extract(text, vocab.EXP_BULK, 2)
    return F.when(low != "", F.concat(low, F.lit("-"), high, F.lit(" years"))).otherwise(experience(text))


def coerce_years(text: Column) -> Column:
    """Free-form years field of a resume -> number, missing words -> 0."""
    return let(strip(F.lower(text)), _years)


def _years(t: Column) -> Column:
    low = F.regexp_extract(t, vocab.YEARS_RANGE, 1).try_cast("double")
    high = F.regexp_extract(t, vocab.YEARS_RANGE, 2).try_cast("double")
    number = F.regexp_extract(t, vocab.YEARS_NUMBER, 1).try_cast("double")
    return (
        F.when(t.isNull() | (t == "") | t.isin(*vocab.YEARS_MISSING), F.lit(0.0))
        .when(low.isNotNull(), (low + high) / 2)
        .otherwise(F.coalesce(number, F.lit(0.0)))
    )


def years_to_seniority(years: Column) -> Column:
    out = F.when(years <= 0, vocab.ENTRY)
    for bound, label in vocab.SENIORITY_BY_YEARS:
        out = out.when(years < bound, label)
    return out.otherwise(vocab.STAFF)


def infer_seniority(title: Column, platform_label: Column | None = None) -> Column:
    """Platform label first, then title words, then roman numerals, else mid level."""
    t = F.lower(title)
    out = None
    for label, words in vocab.SENIORITY_TITLE_WORDS:
        hit = contains_any(t, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    for numeral, label in vocab.SENIORITY_NUMERALS:
        out = out.when(t.rlike(rf"(?U)\b{numeral}\b"), label)
    out = out.otherwise(vocab.MID)
    if platform_label is None:
        return out
    return F.coalesce(lookup(strip(F.lower(platform_label)), vocab.SENIORITY_BY_PLATFORM_LABEL), out)


def seniority_score(label: Column, ignore_case: bool = False) -> Column:
    if ignore_case:
        table = {k.lower(): v for k, v in vocab.SENIORITY_SCORE.items()}
        return lookup(F.lower(label), table, vocab.SENIORITY_SCORE_DEFAULT)
    return lookup(label, vocab.SENIORITY_SCORE, vocab.SENIORITY_SCORE_DEFAULT)


def seniority_experience(label: Column) -> Column:
    return lookup(label, vocab.SENIORITY_EXPERIENCE)
