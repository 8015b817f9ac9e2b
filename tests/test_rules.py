"""Column rules against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from paylattice.functions import experience as E
from paylattice.functions import metadata as M
from paylattice.functions import salary as S
from paylattice.functions import text as X
from paylattice.operators import lookups as L
from paylattice.operators import scoring as SC


def values(spark, rule, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v")).alias("out")).collect()]


def check(spark, rule, cases):
    assert values(spark, rule, [c[0] for c in cases]) == [c[1] for c in cases]


@pytest.mark.parametrize("text,rate,amount", [
    ("$100k - $120k", 1.0, 110000.0), ("$50/hr", 1.0, 104000.0), ("12 LPA", 0.012, 14400.0),
    ("10-14 LPA", 0.012, 14400.0), ("$5,000 per month", 1.0, 60000.0), ("£60,000", 1.27, 76200.0),
    ("$1,200 per week", 1.0, 62400.0), ("400 per day", 1.0, 104000.0), ("$80-120k", 1.0, 60040.0),
    ("12.5k", 1.0, None), ("$3,000", 1.0, None), ("$9,000,000", 1.0, None), ("", 1.0, None), (None, 1.0, None),
    ("no pay", 1.0, None), (", , 50000", 1.0, None), ("1.2.3 LPA 90000", 1.0, None),
])
def test_salary_text(spark, text, rate, amount):
    assert values(spark, lambda c: S.salary_usd(c, rate), [text]) == [amount]


def test_first_two_number_tokens_decide(spark):
    # unreadable tokens use up a place: "," and 70000 are the first two
    check(spark, S.salary_usd, [("70000 , 1", 70000.0), ("0 80000 90000", 80000.0)])


def test_salary_from_free_text(spark):
    check(spark, S.salary_from_text, [
        ("We pay $90k to $110k a year", 100000.0),
        ("pays 3 lakhs, or USD 95,000", 95000.0),
        ("£10 then 75,000 per annum", 75000.0),  # the first pattern's match is too small, a later pattern decides
        ("45 per hour", 93600.0), ("AED 120000", 120000.0), ("nothing here", None), (None, None),
    ])


def test_salary_helpers(spark):
    check(spark, S.salary_number, [("$123,456 USD/yr", 123456.0), ("none", None), (None, None)])
    check(spark, S.range_midpoint, [("$59K-$99K", 79000.0), ("$59k - $99k", 79000.0), ("59K", None)])
    row = spark.sql("SELECT 12.5D AS a, 123456D AS b").select(S.salary_label(F.col("a")), S.salary_label(F.col("b"))).first()
    assert list(row) == ["$12 USD/yr", "$123,456 USD/yr"]


def test_experience(spark):
    check(spark, E.experience, [
        ("3-5 years", "3-5 years"), ("5+ years of work", "5+ years"), ("7 years", "7 years"), ("a fresher", "Fresher"),
        ("an intern role", "Internship"), ("international 2 years", "2 years"), ("Entry  level", "Entry Level"),
        ("$80,000 - 90,000 and 4 years", "4 years"), ("40-50 years", None), ("40-12 years", "12 years"),
        ("45 years", None), ("nothing", None), (None, None), ("03 to 05 years", "3-5 years"),
    ])


def test_experience_midpoint(spark):
    rows = spark.createDataFrame(
        [("3-5 years", None), ("5+ years", None), ("7 years", None), ("Fresher", None), ("Entry Level", None),
         ("", "needs 2-4 years"), (None, None), ("soon", None)], "r string, d string")
    got = [r[0] for r in rows.select(E.experience_midpoint(F.col("r"), F.col("d"))).collect()]
    assert got == [4.0, 6.0, 7.0, 0.0, 0.5, 3.0, None, None]


def test_resume_years_and_levels(spark):
    check(spark, E.coerce_years, [(None, 0.0), ("not mentioned", 0.0), ("3-5 years", 4.0), ("7", 7.0), ("2.5 to 4", 3.25),
                                  ("about 6+", 6.0), ("many", 0.0)])
    rows = spark.createDataFrame([(float(v),) for v in (0, 2, 4, 6, 9)], "y double")
    assert [r[0] for r in rows.select(E.years_to_seniority(F.col("y"))).collect()] == [
        "Entry Level (0-2 years)", "Associate (1-3 years)", "Mid-Level (2-5 years)", "Senior (5+ years)", "Staff (8+ years)"]


def test_seniority_from_title(spark):
    check(spark, E.infer_seniority, [
        ("VP of Data", "Director (8+ years)"), ("Principal Engineer", "Staff (8+ years)"), ("Sr. Analyst", "Senior (5+ years)"),
        ("Leadership Coach", "Senior (5+ years)"), ("Graduate Trainee", "Entry Level (0-2 years)"),
        ("Engineer III", "Senior (5+ years)"), ("Engineer II", "Mid-Level (2-5 years)"), ("Engineer I", "Entry Level (0-2 years)"),
        ("Engineer", "Mid-Level (2-5 years)"), (None, "Mid-Level (2-5 years)"),
    ])
    row = spark.sql("SELECT 'Engineer' AS t, ' Mid-Senior level ' AS p").select(E.infer_seniority(F.col("t"), F.col("p"))).first()
    assert row[0] == "Senior (4-7 years)"


def test_skills(spark):
    check(spark, X.extract_skills, [
        ("Docker, python and R on AWS", "Python, R, AWS, Docker"),
        ("JavaScript only", "JavaScript"), ("c++17 and node.js", "C++, Node.js"), ("C++ alone", None),
        ("AI/ML with CI/CD", "ML, AI, AI/ML, CI/CD"), ("machine  learning", None), ("Machine Learning", "Machine Learning"),
        ("pythonic", None), ("école_r", None), ("", None), (None, None),
    ])


def test_titles_companies_sources(spark):
    check(spark, X.clean_title, [
        ("  - senior data scientist : ", "Senior Data Scientist"), ("ui/ux designer 12345678", "Ui/Ux Designer"),
        ("12345678", "12345678"), ("o'brien 3d artist", "O'Brien 3D Artist"), (None, None),
    ])
    check(spark, X.clean_company, [
        ("Acme Inc.", "Acme"), ("Acme, LLC", "Acme"), ("Acme Pvt. Ltd.", "Acme"), ("Acme Private Limited", "Acme"),
        ("Zinc", "Z"), ("Inc.", "Inc."), ("Acme", "Acme"), (None, None),
    ])
    check(spark, X.normalize_source, [(" linkedin ", "Linkedin"), ("levels.fyi", "Levels.Fyi")])


def test_footer(spark):
    text = ("Great job. Posted 2 weeks ago 1,234 applicants Seniority level Associate Employment type Contract Job function IT "
            "Industries Software Referrals. Remote or hybrid, master's degree, stock options.")
    f = spark.createDataFrame([(text,)], "t string").select(M.footer(F.col("t")).alias("f")).first()["f"]
    assert (f.seniority_raw, f.employment_type, f.industry) == ("Associate", "Contract", "Software")
    assert (f.remote_type, f.education_required, f.has_equity, f.has_bonus) == ("Hybrid", "Master'S", 1, 0)
    assert (f.date_posted_raw, f.applicant_count) == ("2 weeks ago", 1234)


def test_simple_metadata(spark):
    m = spark.createDataFrame([("A part-time remote role with a bonus, PhD",)], "t string").select(
        M.simple_metadata(F.col("t")).alias("m")).first()["m"]
    assert tuple(m) == ("Remote", "Part Time", "Phd", 0, 1)


def test_keys(spark):
    import hashlib

    row = spark.sql("SELECT 'Acme' AS c, 'Dev' AS t, NULL AS p").select(
        X.dedup_key(F.lit(""), F.col("c"), F.col("t"), F.col("p").cast("string"))).first()
    assert row[0] == hashlib.md5(b"acmedev").hexdigest()[:12]


def test_resume_titles(spark):
    rows = spark.createDataFrame([
        ("Built React and Node.js applications", []), ("", ["PyTorch", "NLP"]), ("", []), (None, None),
        ("ml engineer at Acme", ["SQL"]), ("uses terraform", []), ("misread", ["docker"])], "t string, s array<string>")
    assert [r[0] for r in rows.select(L.infer_title(F.col("t"), F.col("s"))).collect()] == [
        "Full Stack Developer", "Machine Learning Engineer", "Software Engineer", "Software Engineer",
        "Machine Learning Engineer", "DevOps Engineer", "DevOps Engineer"]


def test_adjustments(spark):
    check(spark, SC.seniority_adjustment, [("Senior (5+ years)", 30000), ("Internship (0 years)", -20000), (None, 0), ("Boss", 0)])
    check(spark, SC.city_adjustment, [("New York, NY", 28000), ("Bangalore", -15000), ("Nowhere", 0), (None, 0)])
    check(spark, SC.role_adjustment, [("Senior ML Engineer", 18000), ("Data Scientist", 12000), ("QA tester", -3000), ("Chef", 0)])
    check(spark, SC.employment_multiplier, [("Internship", 0.45), ("Part-time", 0.55), ("Contract", 1.05), (None, 1.0)])
    check(spark, L.company_tier, [("Meta Platforms", 1), ("KPMG", 2), ("Keystone", 2), ("Acme", 3), (None, 3)])
    check(spark, lambda c: SC.experience_adjustment(c.cast("double")), [("2", 9000), ("5", 20500), ("12", 39000), (None, 0)])
