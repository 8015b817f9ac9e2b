"""SQL text of the column rules for the check engine.

Each function takes SQL expressions and returns one; word lists and patterns
come from ``vocab`` so that both engines are given the same fixed values.
"""

from __future__ import annotations

from .. import vocab as V


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def case(expr: str, table: dict, default="NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def rx(t: str, pattern: str, group: int = 0, options: str = "i") -> str:
    return f"regexp_extract({t}, {q(pattern)}, {group}, '{options}')"


def has(t: str, pattern: str, options: str = "i") -> str:
    return f"regexp_matches({t}, {q(pattern)}, '{options}')"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def clean_text(t: str) -> str:
    return rf"nullif(trim(regexp_replace({t}, '\s+', ' ', 'g')), '')"


def title_case(t: str) -> str:
    return rf"array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_extract_all({t}, '(\p{{L}}+|\P{{L}}+)')], '')"


def contains_any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def number(t: str) -> str:
    return f"TRY_CAST(replace(replace({t}, ',', ''), ' ', '') AS DOUBLE)"


def money(t: str) -> str:
    return f"CAST(round(CAST({t} AS DECIMAL(28,8)), 2) AS DOUBLE)"


def salary_usd(t: str, rate: str = "1.0") -> str:
    """Rules in order: lakh amount, else mean of the first two numbers by period."""
    period = f"lower({rx(t, V.PAY_PERIOD, 1)})"
    low, high = number(rx(t, V.PAY_LAKH, 1)), number(rx(t, V.PAY_LAKH, 2))
    tokens = rf"regexp_extract_all(regexp_replace({t}, {q(V.PAY_THOUSAND)}, '\1000', 'g'), {q(V.PAY_NUMBER)})"
    mean = f"list_avg([v for v in [{number(tokens + '[1]')}, {number(tokens + '[2]')}] if v > 0])"
    factor = "(CASE " + " ".join(
        f"WHEN {contains_any(period, words)} THEN {n}" for words, n in V.PAY_PER_YEAR) + " ELSE 1 END)"
    lakhs = f"(CASE WHEN {high} <> 0 THEN ({low} + {high}) / 2 ELSE {low} END) * {V.PAY_LAKH_UNIT}"
    amount = f"((CASE WHEN {low} IS NOT NULL THEN {lakhs} ELSE {mean} * {factor} END) * CAST({rate} AS DOUBLE))"
    return f"(CASE WHEN {amount} BETWEEN {V.PAY_MIN} AND {V.PAY_MAX} THEN round_even({amount}, 0) END)"


def salary_from_text(t: str, rate: str = "1.0") -> str:
    return "coalesce(" + ", ".join(salary_usd(rx(t, p), rate) for p in V.PAY_SNIPPETS) + ")"


def salary_label(amount: str) -> str:
    return f"('$' || format('{{:,}}', CAST(round_even({amount}, 0) AS BIGINT)) || ' USD/yr')"


def keep_or_parse(existing: str, t: str) -> str:
    kept = f"(CASE WHEN {existing} BETWEEN {V.PAY_MIN} AND {V.PAY_MAX} THEN {existing} END)"
    return f"round(coalesce({kept}, {salary_usd(t)}), 2)"


def strip_pay(t: str) -> str:
    for p in V.PAY_NOISE:
        t = f"regexp_replace({t}, {q(p)}, ' ', 'gi')"
    return t


def experience(t: str) -> str:
    s = f"lower({strip_pay(t)})"
    low, high = (f"TRY_CAST({rx(s, V.EXP_RANGE, g)} AS INT)" for g in (1, 2))
    one, text = f"TRY_CAST({rx(s, V.EXP_SINGLE, 1)} AS INT)", rx(s, V.EXP_SINGLE, 0)
    return (
        rf"(CASE WHEN {has(s, r'\bfresher\b')} THEN 'Fresher' WHEN {has(s, r'\bintern\b')} THEN 'Internship' "
        rf"WHEN {has(s, r'\bentry\s+level\b')} THEN 'Entry Level' "
        f"WHEN {low} < {V.EXP_LIMIT} AND {high} < {V.EXP_LIMIT} THEN {low} || '-' || {high} || ' years' "
        f"WHEN {one} < {V.EXP_LIMIT} THEN {one} || CASE WHEN contains({text}, '+') THEN '+ years' ELSE ' years' END END)")


def experience_midpoint(required: str, description: str) -> str:
    t = f"trim(lower(coalesce(nullif({required}, ''), {experience(description)})))"
    low, high = (f"TRY_CAST({rx(t, V.EXP_TEXT_RANGE, g)} AS DOUBLE)" for g in (1, 2))
    plus, years = (f"TRY_CAST({rx(t, p, 1)} AS DOUBLE)" for p in (V.EXP_TEXT_PLUS, V.EXP_TEXT_YEARS))
    return (f"(CASE WHEN {contains_any(t, ['fresher', 'internship'])} THEN 0.0 WHEN contains({t}, 'entry') THEN 0.5 "
            f"WHEN {low} IS NOT NULL THEN ({low} + {high}) / 2 WHEN {plus} IS NOT NULL THEN {plus} + 1 ELSE {years} END)::DOUBLE")


def bulk_experience(t: str) -> str:
    low, high = rx(t, V.EXP_BULK, 1, "c"), rx(t, V.EXP_BULK, 2, "c")
    return f"(CASE WHEN {low} <> '' THEN {low} || '-' || {high} || ' years' ELSE {experience(t)} END)"


def coerce_years(t: str) -> str:
    s = f"trim(lower({t}))"
    low, high, n = (f"TRY_CAST({x} AS DOUBLE)" for x in (
        rx(s, V.YEARS_RANGE, 1), rx(s, V.YEARS_RANGE, 2), rx(s, V.YEARS_NUMBER, 1)))
    missing = ", ".join(q(w) for w in V.YEARS_MISSING)
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' OR {s} IN ({missing}) THEN 0.0 WHEN {low} IS NOT NULL THEN ({low} + {high}) / 2 "
            f"ELSE coalesce({n}, 0.0) END)::DOUBLE")


def years_to_seniority(y: str) -> str:
    bands = " ".join(f"WHEN {y} < {b} THEN {q(label)}" for b, label in V.SENIORITY_BY_YEARS)
    return f"(CASE WHEN {y} <= 0 THEN {q(V.ENTRY)} {bands} ELSE {q(V.STAFF)} END)"


def infer_seniority(title: str) -> str:
    t = f"lower({title})"
    words = " ".join(f"WHEN {contains_any(t, ws)} THEN {q(label)}" for label, ws in V.SENIORITY_TITLE_WORDS)
    numerals = " ".join(rf"WHEN regexp_matches({t}, '\b{n}\b') THEN {q(label)}" for n, label in V.SENIORITY_NUMERALS)
    return f"(CASE {words} {numerals} ELSE {q(V.MID)} END)"


def seniority_score(label: str) -> str:
    return case(label, V.SENIORITY_SCORE, V.SENIORITY_SCORE_DEFAULT)


def clean_title(t: str) -> str:
    s = strip(t)
    for p in (V.TITLE_ID, V.TITLE_HEAD, V.TITLE_TAIL):
        s = f"regexp_replace({s}, {q(p)}, '')"
    return f"coalesce(nullif({strip(title_case(s))}, ''), {t})"


def clean_company(t: str) -> str:
    pattern = "|".join(f"({s})$" for s in V.LEGAL_SUFFIXES)
    return f"coalesce(nullif({strip(f'regexp_replace({t}, {q(pattern)}, {q("")}, {q("i")})')}, ''), {t})"


def footer(t: str) -> dict[str, str]:
    def part(p):
        return clean_text(rx(t, p, 1, "is"))

    return {
        "seniority_raw": part(V.META_SENIORITY), "employment_type": part(V.META_EMPLOYMENT),
        "industry": part(V.META_INDUSTRY), "remote_type": remote(t), "education_required": education(t),
        "has_equity": flag(has(t, V.META_EQUITY)), "has_bonus": flag(has(t, V.META_BONUS)),
        "date_posted_raw": clean_text(rx(t, V.META_POSTED, 1)),
        "applicant_count": f"TRY_CAST(replace({rx(t, V.META_APPLICANTS, 1)}, ',', '') AS DOUBLE)",
    }


def remote(t: str) -> str:
    low = f"lower({t})"
    return f"(CASE WHEN contains({low}, 'hybrid') THEN 'Hybrid' WHEN contains({low}, 'remote') THEN 'Remote' ELSE 'On-site' END)"


def education(t: str) -> str:
    return f"nullif({title_case(rx(f'lower({t})', V.META_EDUCATION, 1))}, '')"


def flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


def ordered_type(t: str, words) -> str:
    low = f"lower({t})"
    return "(CASE " + " ".join(
        f"WHEN contains({low}, {q(w)}) THEN {q(w.replace('-', ' ').title())}" for w in words) + " END)"


def escape(word: str) -> str:
    return "".join("\\" + ch if ch in ".+*?()[]{}|^$\\" else ch for ch in word)


def extract_skills(t: str) -> str:
    low = f"lower({t})"
    items = ", ".join(
        rf"CASE WHEN regexp_matches({low}, {q(rf'\b{escape(s.lower())}\b')}) THEN {q(s)} END" for s in V.SKILLS)
    return f"nullif(array_to_string([s for s in [{items}] if s IS NOT NULL], ', '), '')"


def split_skills(t: str) -> str:
    return f"[trim(s) for s in string_split({t}, ',') if trim(s) <> '']"


def key_of(*parts: str) -> str:
    joined = " || ".join(f"lower(coalesce({p}, ''))" for p in parts)
    return f"substring(md5({joined}), 1, 12)"


def first_word(t: str, table, default) -> str:
    low = f"lower(coalesce({t}, ''))"
    whens = " ".join(
        f"WHEN {contains_any(low, [w] if isinstance(w, str) else w)} THEN {v}" for w, v in table)
    return f"(CASE {whens} ELSE {default} END)"


def company_tier(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    return (f"(CASE WHEN {contains_any(low, V.TIER1_COMPANIES)} THEN 1 WHEN {contains_any(low, V.TIER2_COMPANIES)} THEN 2 ELSE 3 END)")


def experience_adjustment(y: str) -> str:
    return (f"(CASE WHEN {y} <= 3 THEN {y} * 4500 WHEN {y} <= 8 THEN 13500 + ({y} - 3) * 3500 "
            f"WHEN {y} > 8 THEN 31000 + ({y} - 8) * 2000 ELSE 0 END)")


def tier_bonus(t: str) -> str:
    return case(company_tier(t), V.TIER_BONUS)


def remote_adjustment(t: str) -> str:
    return f"(CASE WHEN contains(lower(coalesce({t}, '')), 'remote') THEN {V.REMOTE_ADJUSTMENT} ELSE 0 END)"


ADJUSTMENTS = {
    "seniority_adjustment": first_word("seniority_level", V.SENIORITY_ADJUSTMENTS, 0),
    "experience_adjustment": experience_adjustment("experience_years"),
    "city_adjustment": first_word("city", V.CITY_ADJUSTMENTS, 0),
    "role_adjustment": first_word("job_title", V.ROLE_ADJUSTMENTS, 0),
    "company_tier_bonus": tier_bonus("company_name"),
    "academic_bonus": first_word("education_required", V.EDUCATION_ADJUSTMENTS, 0),
    "remote_adjustment": remote_adjustment("remote_type"),
}
MULTIPLIER = first_word("employment_type", V.EMPLOYMENT_MULTIPLIERS, "1.0") + "::DOUBLE"


def total_premium(skills: str) -> str:
    return (f"CAST(coalesce(list_sum([{case('s', V.SKILL_PREMIUMS, V.SKILL_PREMIUM_DEFAULT)} "
            f"for s in string_split(coalesce({skills}, ''), ',') if s <> '']), 0) AS BIGINT)")


def city_tier(city: str, country: str) -> str:
    low = f"lower(coalesce({city}, ''))"
    return (f"(CASE WHEN {contains_any(low, V.TIER4_CITIES)} THEN 4 WHEN {contains_any(low, V.TIER3_CITIES)} THEN 3 "
            f"WHEN {country} IN ({', '.join(q(c) for c in V.TIER2_COUNTRIES)}) THEN 2 ELSE 1 END)")


def word_count(t: str) -> str:
    return rf"coalesce(len([w for w in regexp_split_to_array({t}, '\s+') if w <> '']), 0)"


def size_category(n: str) -> str:
    bands = " ".join(f"WHEN CAST({n} AS BIGINT) < {b} THEN {q(label)}" for b, label in V.SIZE_BANDS)
    return f"(CASE WHEN {n} IS NULL THEN NULL {bands} ELSE {q(V.SIZE_BAND_LAST)} END)"


def unicode_word(pattern: str) -> str:
    r"""``\b(...)\b`` with boundaries that know letters beyond ASCII."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){inner}(?:$|[^\p{{L}}\p{{N}}_])"


def infer_title(text: str, skills: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    have = f"[lower(s) for s in string_split(coalesce({skills}, ''), ',')]"
    pats = " ".join(f"WHEN regexp_matches({low}, {q(unicode_word(p))}) THEN {q(title)}" for title, p in V.RESUME_TITLES)
    groups = " ".join(
        f"WHEN list_has_any({have}, [{', '.join(q(w) for w in ws)}]) OR {contains_any(low, ws)} THEN {q(title)}"
        for title, ws in V.RESUME_SKILL_TITLES)
    return f"(CASE {pats} {groups} ELSE {q(V.RESUME_TITLE_DEFAULT)} END)"
