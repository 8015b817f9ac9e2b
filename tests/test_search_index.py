"""The stored search index against a plain search, page by page, and what its plan reads."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paylattice.operators import search as R
from paylattice.operators.search_index import SearchIndex, probes
from paylattice.session import scratch_path
from paylattice.sources import published

SCHEMA = ("id long, job_title string, company_name string, city string, salary_usd_numeric double, remote_type string, "
          "seniority_level string, skills_required string, source_website string, job_link string, scraped_at timestamp, "
          "has_equity int, bucket string")


def postings(n=400, seed=5):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice([*v, None])
    return [(i, pick("Data Engineer", "data scientist", "ML", "Größe Ingenieur", "", "a" * 3000 + " tail"),
             pick("Databricks?", "Acme, Inc.", "日本データ"), pick("Oslo", "New York, NY", "York"), pick(50000.0, 90000.0, 90000.5),
             pick("Remote", "remote", "Hybrid"), pick("Senior (5+)", "Junior"), pick("java, aws ", "Java,SQL", "c++,, r", ","),
             pick("Indeed", "indeed", "Other"), pick("http://x", ""), pick(datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2023, 5, 5)),
             pick(0, 1), "clash") for i in range(n)]


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(postings(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def index(spark, jobs):
    index = SearchIndex(spark, scratch_path(spark, "index"), buckets=4)
    assert index.add(jobs.where("id < 250"), "a") and index.add(jobs.where("id >= 250"), "b")
    assert not index.add(jobs.where("id >= 250"), "b")
    return index


FILTERS = [
    {}, {"keyword": "data"}, {"keyword": "DATA ENG"}, {"keyword": "a"}, {"keyword": "データ"}, {"keyword": "größe"},
    {"keyword": "aaaa tail"}, {"keyword": "absent"}, {"city": "york"}, {"skills": "java, aws"}, {"skills": " C++ ,"},
    {"skills": "r"}, {"seniority_level": "(5+"}, {"min_salary": 90000, "max_salary": 90000.4}, {"remote_type": "REMOTE", "source": "Indeed"},
    {"keyword": "data", "city": "o", "skills": "sql,r", "min_salary": 60000, "seniority_level": "junior", "source": "indeed"},
]


@pytest.mark.parametrize("filters", FILTERS, ids=lambda f: "-".join(f"{k}={v}" for k, v in f.items()) or "none")
def test_finds_what_a_plain_search_finds(jobs, index, filters):
    plain = sorted(r.id for r in R.search(jobs, **filters).collect())
    assert sorted(r.id for r in index.matches(**filters).collect()) == plain
    total = index.total(20, **filters).collect()[0]
    assert (total.total, total.pages) == (len(plain), -(-len(plain) // 20))


@pytest.mark.parametrize("filters", [{}, {"keyword": "data"}, {"skills": "java", "city": "york"}], ids=str)
def test_pages_by_key_equal_pages_by_offset(jobs, index, filters):
    last, number = None, 0
    while True:
        number += 1
        plain = [tuple(r) for r in R.search_page(jobs, number, 90, **filters).collect()]
        rows = index.page(90, last, **filters).collect()
        assert [tuple(r[c] for c in R.LISTED) for r in rows] == plain
        if not rows:
            break
        last = rows[-1]
    assert number > 1


def test_a_search_reads_postings_and_few_buckets(index):
    plan = index.matches(keyword="engineer")._jdf.queryExecution().executedPlan().toString()
    assert "/rows" not in plan and "/postings" in plan and "/grams" in plan
    scan = index.texts_with(["city"], "yor")
    scan.collect()
    text = scan._jdf.queryExecution().toString()
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    page = index.page(5, keyword="engineer")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in page and "CartesianProduct" not in page and "NestedLoop" not in page


@pytest.mark.parametrize("owner, step", [(SearchIndex, "_write"), (published.Pointer, "swap")])
def test_a_killed_batch_is_not_seen_and_can_be_repeated(spark, jobs, monkeypatch, owner, step):
    index = SearchIndex(spark, scratch_path(spark, "index"), buckets=2)
    index.add(jobs.where("id < 40"), "a")

    def die(*args, **kwargs):
        raise InterruptedError

    with monkeypatch.context() as m:
        m.setattr(owner, step, die)
        with pytest.raises(InterruptedError):
            index.add(jobs.where("id between 40 and 59"), "b")
    assert index.matches().count() == 40
    assert index.add(jobs.where("id between 40 and 59"), "b")
    assert index.matches().count() == 60


def test_empty_batches_and_no_batch(spark, jobs):
    index = SearchIndex(spark, scratch_path(spark, "index"), buckets=2)
    with pytest.raises(ValueError):
        index.matches()
    index.add(jobs.limit(0), "none")
    assert index.matches(keyword="data").count() == 0 and index.page(5).collect() == []
    index.add(jobs.where(F.col("id") == 7), "one")
    assert [r.id for r in index.page(5).collect()] == [7]


def test_probes_are_few_and_short():
    assert probes("a") == ["a"] and probes("ab") == ["ab"] and probes("abc") == ["abc"]
    assert len(probes("software engineer in test")) <= 4 and all(len(g) == 3 for g in probes("software engineer"))
