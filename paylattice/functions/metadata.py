"""Fields read from job descriptions, and small flags and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import blank_to_null, clean_text, has_word, strip, title_case


def remote_type(text: Column) -> Column:
    """Both words mean hybrid."""
    t = F.lower(text)
    return (
        F.when(t.contains("hybrid"), "Hybrid")
        .when(t.contains("remote"), "Remote")
        .otherwise("On-site")
    )


def remote_type_remote_first(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.contains("remote"), "Remote").when(t.contains("hybrid"), "Hybrid").otherwise("On-site")


def education(text: Column) -> Column:
    return title_case(blank_to_null(F.regexp_extract(F.lower(text), f"(?U){vocab.META_EDUCATION}", 1)))


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def ordered_type(text: Column, words: list[str]) -> Column:
    """First listed employment word found, as a label."""
    t = F.lower(text)
    out = None
    for w in words:
        label = w.replace("-", " ").title()
        out = F.when(t.contains(w), label) if out is None else out.when(t.contains(w), label)
    return out


def footer(text: Column) -> Column:
    """Structured footer of a description as one struct."""

    low = F.lower(text)

    def found(word: str, pattern: str, flags: str = "is") -> Column:
        """Try the pattern only where its fixed words occur."""
        return F.when(low.contains(word), F.regexp_extract(text, f"(?{flags}){pattern}", 1))

    applicants = found("applicant", vocab.META_APPLICANTS)
    return F.struct(
        clean_text(found("seniority level", vocab.META_SENIORITY)).alias("seniority_raw"),
        clean_text(found("employment type", vocab.META_EMPLOYMENT)).alias("employment_type"),
        clean_text(found("industr", vocab.META_INDUSTRY)).alias("industry"),
        remote_type(text).alias("remote_type"),
        education(text).alias("education_required"),
        flag(has_word(text, vocab.META_EQUITY)).alias("has_equity"),
        flag(has_word(text, vocab.META_BONUS)).alias("has_bonus"),
        clean_text(found("posted", vocab.META_POSTED, "iuU")).alias("date_posted_raw"),
        F.replace(applicants, F.lit(","), F.lit("")).try_cast("bigint").alias("applicant_count"),
    )


def simple_metadata(text: Column) -> Column:
    """Keyword-only variant for plain descriptions."""
    return F.struct(
        remote_type(text).alias("remote_type"),
        ordered_type(text, vocab.SIMPLE_EMPLOYMENT).alias("employment_type"),
        education(text).alias("education_required"),
        flag(has_word(text, vocab.META_EQUITY)).alias("has_equity"),
        flag(has_word(text, vocab.META_BONUS)).alias("has_bonus"),
    )


def faang_flag(name: Column) -> Column:
    return flag(F.lower(strip(name)).isin(*vocab.FAANG_NAMES))


def rescan_flag(current: Column, description: Column, pattern: str) -> Column:
    """Raise an unset flag when the description names the benefit."""
    unset = F.coalesce(current, F.lit(0)) == 0
    return F.when(unset & has_word(description, pattern), F.lit(1)).otherwise(current)


def size_category(size: Column) -> Column:
    n = size.cast("bigint")
    out = None
    for bound, label in vocab.SIZE_BANDS:
        out = F.when(n < bound, label) if out is None else out.when(n < bound, label)
    return F.when(size.isNotNull(), out.otherwise(vocab.SIZE_BAND_LAST))
