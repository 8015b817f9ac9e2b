"""Pay text to annual US dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import blank_to_null, contains_any, let


def number_of(token: Column) -> Column:
    """"12,500.5" -> 12500.5, unreadable -> null."""
    return F.replace(F.replace(token, F.lit(","), F.lit("")), F.lit(" "), F.lit("")).try_cast("double")


def annualise(amount: Column, period: Column) -> Column:
    factor = F.lit(1)
    for words, times in reversed(vocab.PAY_PER_YEAR):
        hit = period.contains(words[0])
        for w in words[1:]:
            hit = hit | period.contains(w)
        factor = F.when(hit, times).otherwise(factor)
    return amount * factor


def in_pay_limits(amount: Column) -> Column:
    """Whole dollars inside the accepted range, else null."""
    return F.when(amount.between(vocab.PAY_MIN, vocab.PAY_MAX), F.bround(amount, 0))


def salary_usd(text: Column, rate: Column | float = 1.0) -> Column:
    """Annual USD of one pay text; see the rule list in the README."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    period = F.lower(F.regexp_extract(text, f"(?i){vocab.PAY_PERIOD}", 1))

    lakh = f"(?i){vocab.PAY_LAKH}"
    low, high = number_of(F.regexp_extract(text, lakh, 1)), number_of(F.regexp_extract(text, lakh, 2))
    lakhs = F.when(high.isNotNull() & (high != 0), (low + high) / 2).otherwise(low) * vocab.PAY_LAKH_UNIT

    tokens = F.regexp_extract_all(
        F.regexp_replace(text, vocab.PAY_THOUSAND, "$1000"), F.lit(f"({vocab.PAY_NUMBER})"), F.lit(1)
    )
    amounts = F.filter(F.transform(F.slice(tokens, 1, 2), number_of), lambda v: v > 0)
    middle = F.aggregate(
        amounts, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), (acc["n"] + 1).alias("n")),
        lambda acc: acc["sum"] / F.nullif(acc["n"], F.lit(0)),
    )
    amount = F.when(low.isNotNull(), lakhs).otherwise(annualise(middle, period)) * rate
    return let(amount, in_pay_limits)


def salary_from_text(text: Column, rate: Column | float = 1.0) -> Column:
    """First snippet pattern whose first match gives an acceptable amount.

    A pattern is only tried on texts that hold one of the words it needs.
    """
    snippets = F.array(*[
        F.when(contains_any(F.lower(text), words), F.regexp_extract(text, f"(?i){p}", 0))
        for words, p in zip(vocab.PAY_SNIPPET_WORDS, vocab.PAY_SNIPPETS)])
    return F.reduce(
        F.filter(snippets, lambda s: s != ""),
        F.lit(None).cast("double"),
        lambda found, s: F.coalesce(found, salary_usd(s, rate)),
    )


def salary_number(text: Column) -> Column:
    """Number inside a formatted pay text."""
    return number_of(blank_to_null(F.regexp_extract(text, f"({vocab.PAY_NUMBER})", 1)))


def salary_label(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0), F.lit(" USD/yr"))


def keep_or_parse(existing: Column, text: Column, rate: Column | float = 1.0) -> Column:
    """Existing amount when plausible, else the parsed text; cents precision."""
    kept = F.when(existing.between(vocab.PAY_MIN, vocab.PAY_MAX), existing)
    return F.round(F.coalesce(kept, salary_usd(text, rate)), 2)


def range_midpoint(text: Column) -> Column:
    """"$59K-$99K" -> 79000."""
    pattern = f"(?i){vocab.PAY_RANGE_K}"
    low = F.regexp_extract(text, pattern, 1).try_cast("double")
    high = F.regexp_extract(text, pattern, 2).try_cast("double")
    return (low + high) / 2 * 1000


def strip_pay(text: Column) -> Column:
    """Blank out pay-looking substrings; a pattern only runs where one of its words occurs."""
    def blank(words: list[str], pattern: str):
        return lambda t: F.when(
            contains_any(F.lower(t), words), F.regexp_replace(t, f"(?i){pattern}", " ")).otherwise(t)

    for words, pattern in zip(vocab.PAY_NOISE_WORDS, vocab.PAY_NOISE):
        text = let(text, blank(words, pattern))
    return text


def page_pay_range(text: Column) -> Column:
    """"$73k - $145k" -> struct(low, high); a bare number below 1000 means thousands."""
    low = F.replace(F.regexp_extract(text, vocab.PAGE_PAY_RANGE, 1), F.lit(","), F.lit("")).try_cast("bigint")
    high = F.replace(F.regexp_extract(text, vocab.PAGE_PAY_RANGE, 2), F.lit(","), F.lit("")).try_cast("bigint")
    has_k = F.lower(text).contains("k")

    def scale(n: Column) -> Column:
        return n * F.when(has_k | (n < 1000), 1000).otherwise(1)

    return F.struct(scale(low).alias("range_min"), scale(high).alias("range_max"))
