"""Table-level jobs on small hand-made tables and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paylattice.operators import cleaning as C
from paylattice.operators import dedup as K
from paylattice.operators import insights as I
from paylattice.operators import models as MD
from paylattice.operators import quality as Q
from paylattice.operators import ranks as RK
from paylattice.operators import scoring as SC
from paylattice.operators import similar as SM
from paylattice.session import scratch_path
from paylattice.sources import io
from paylattice.streaming import jobs as ST

CLEAN_SCHEMA = ("id int, job_title string, company_name string, city string, salary string, salary_usd_numeric double, dedup_key string, "
                "seniority_level string, employment_type string, remote_type string, industry string, education_required string, "
                "has_equity int, has_bonus int, job_description string, source_website string")


def test_cleaner_keeps_numeric_and_parses_text(spark):
    rows = [
        (1, "Data Scientist", "Acme Inc.", "New York, NY, USA", "$10/hr", 123456.0, "abc", "Mid-Level (2-5 years)", "Full-time",
         "On-site", None, None, 0, 0, "", "Indeed"),
        (2, "Software Engineer", "Acme", "New York, NY, USA", "$80k - $120k", None, "def", "Mid-Level (2-5 years)", "Full-time",
         "Remote", None, None, 0, 0, "", "Indeed"),
        (3, "QA", "Acme", "x", None, None, "ghi", None, None, None, None, None, 0, 0, None, None),
    ]
    out = {r["id"]: r for r in C.clean_jobs(spark.createDataFrame(rows, CLEAN_SCHEMA)).collect()}
    assert set(out) == {1, 2}
    assert (out[1]["salary_usd_numeric"], out[1]["company_name"], out[1]["company_name_raw"]) == (123456.0, "Acme", "Acme Inc.")
    assert out[2]["salary_usd_numeric"] == 100000.0


def test_clean_is_independent_of_partitioning(spark):
    rows = [(i, "Data Engineer", f"c{i % 7}", "x", None if i % 3 else "$90k", None, None, None, None, None, None, None, 0, 0, None, "a")
            for i in range(300)]
    df = spark.createDataFrame(rows, CLEAN_SCHEMA)
    first = sorted(map(str, C.clean_jobs(df.repartition(1)).collect()))
    again = sorted(map(str, C.clean_jobs(df.orderBy(F.rand(3)).repartition(7)).collect()))
    assert first == again and len(first) == 7


def test_order_stats_match_brute_force_on_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(9)}", rng.choice([None, round(rng.uniform(0, 9000), 2), 500.0]))
            for _ in range(4000)] + [("one", 5.0), ("two", 1.0), ("two", 9.0), ("none", None), ("neg", -1500.25), ("neg", 10.0), ("neg", -20.0)]
    out = {r["g"]: r for r in RK.with_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(out) == set(groups)
    for g, vs in groups.items():
        vs.sort()
        r = out[g]
        assert (r["n"], r["median"], r["low"], r["high"]) == (len(vs), vs[len(vs) // 2], vs[0], vs[-1])
        assert r["total"] == pytest.approx(sum(vs))


def test_percentiles_interpolate_like_numpy(spark):
    values = [float(v) for v in np.random.default_rng(2).uniform(1e4, 5e5, 777).round(2)]
    row = RK.linear_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", [10, 25, 50, 75, 90]).first()
    for p in (10, 25, 50, 75, 90):
        assert row[f"p{p}"] == pytest.approx(np.percentile(values, p))


def test_percentile_of_counts_smaller_values(spark):
    rng = np.random.default_rng(3)
    train = sorted(float(v) for v in rng.integers(0, 20000, 500))
    asked = [float(v) for v in rng.integers(-3000, 30000, 200)] + [train[0], train[-1], train[250]]
    out = RK.percentile_of(spark.createDataFrame([(v,) for v in train], "t double"), "t",
                           spark.createDataFrame([(v,) for v in asked], "x double"), "x").collect()
    assert len(out) == len(asked)
    for r in out:
        expected = int(np.searchsorted(train, r["x"]) / len(train) * 100)
        assert r["percentile"] == min(99, max(1, expected))


def test_snapshot_copies_are_compressed_and_complete(spark, tmp_path):
    rows = [(i, f"title {i}", 'a "b", c\nnext  ' if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, job_title string, extra string").repartition(3)
    paths = io.snapshot_export(df, str(tmp_path / "out"), "t1")
    schema = io.ordered_columns(df).schema
    for back in (io.scan_csv(spark, paths["csv"], schema), spark.read.schema(schema).json(paths["json"])):
        assert sorted((r["id"], r["job_title"], r["extra"]) for r in back.collect()) == rows
    files = [f for f in (tmp_path / "out").rglob("part-*")]
    assert len(files) >= 2 and all(f.name.endswith(".gz") for f in files)


def test_insert_if_absent(spark):
    stored = spark.createDataFrame([("a",), (None,)], "dedup_key string")
    batch = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, None, "z"), (5, None, "z")],
                                  "id int, dedup_key string, extra string")
    out = K.insert_if_absent(stored, batch, ["id", "dedup_key"])
    assert sorted(r["id"] for r in out.collect()) == [2, 4, 5]
    assert out.columns == ["id", "dedup_key", "scraped_at"]


def test_merge_prefers_rows_with_salary(spark):
    schema = "id int, dedup_key string, salary string"
    master = spark.createDataFrame([(1, "a", None), (2, "b", "x")], schema)
    batch = spark.createDataFrame([(3, "a", "y"), (4, "b", "z"), (5, "c", None)], schema)
    assert sorted(r["id"] for r in K.merge_master(master, batch).collect()) == [2, 3, 5]
    assert tuple(K.run_summary(master, batch).first()) == (3, 1, 2, 3)


def test_top_skills_small(spark):
    jobs = spark.createDataFrame(
        [("Python, SQL, Python", 100.0, "x", "s"), ("SQL", 50.0, "x", "s"), ("Go", None, "x", "s"), (None, 999.0, "x", "s")],
        "skills_required string, salary_usd_numeric double, city string, seniority_level string")
    out = {r["skill"]: r for r in I.top_skills(jobs).collect()}
    assert (out["Python"]["count"], out["Python"]["avg_salary_with_skill"], out["Python"]["avg_salary_without_skill"]) == (1, 100.0, 50.0)
    assert out["Python"]["salary_premium_pct"] == 100.0
    assert out["SQL"]["avg_salary_without_skill"] is None and out["SQL"]["salary_premium_pct"] is None
    assert out["Go"]["count"] == 1 and out["Go"]["avg_salary_with_skill"] is None


def test_readiness(spark):
    schema = "salary_usd_numeric double, city string, seniority_level string, source_website string"
    small = spark.createDataFrame([(100000.0, "New York", "Senior", "Indeed"), (None, "New York", "Senior", "Indeed"),
                                   (120000.0, "London", "Mid", "Indeed")], schema)
    r = Q.training_readiness(small).first()
    assert not r["ready"] and "salary_rows" in r["checks"].asDict() and len(r["reasons"]) > 0
    good = spark.createDataFrame([(100000.0, "New York", "Senior", "Indeed"), (120000.0, "London", "Mid", "Levels.fyi"),
                                  (90000.0, "Berlin", "Entry", "PayScale"), (80000.0, "Toronto", "Staff", "ZipRecruiter")], schema)
    r = Q.training_readiness(good, min_salary_rows=4, min_salary_coverage_pct=75, min_cities=4, min_seniority_levels=4,
                             max_single_source_pct=50).first()
    assert r["ready"] and r["salary_rows"] == 4
    empty = Q.training_readiness(good.where("false")).first()
    assert (empty["total_rows"], empty["salary_coverage_pct"], empty["top_source_pct"]) == (0, 0.0, 100.0)


def test_offer_shape(spark):
    offers = spark.createDataFrame([(1, 120000, 10000, 15000, 99000), (2, 50000, 0, 0, 100000)],
                                   "request_id int, base_salary_usd int, annual_bonus_usd int, annual_equity_usd int, predicted_salary_usd int")
    market = spark.createDataFrame([(1, 135000, 12)], "request_id int, market_salary_usd int, evidence_count int")
    out = {r["request_id"]: r for r in SC.analyze_offers(offers, market).collect()}
    r = out[1]
    assert (r["total_comp_usd"], r["market_reference_usd"], r["difference_usd"], r["difference_pct"], r["verdict"], r["evidence_count"]) == (
        145000, 135000, 10000, 7.4, "fair", 12)
    assert (out[2]["market_reference_usd"], out[2]["verdict"], out[2]["evidence_count"]) == (100000, "low", 0)


def test_similar_jobs_brute_force(spark):
    rng = random.Random(5)
    words = ["data", "engineer", "qa", "ml", "senior", "analyst", "ui", "enginee", "lead"]
    cities, levels = ["York", "New York", "Kew", None, "K"], ["Senior (5+)", "Senior Staff (8+)", None, "Mid (2)"]
    jobs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), f"c{i}", rng.choice(cities),
             rng.choice([None, float(rng.randint(1, 40))]), rng.choice(levels), "Remote", "src") for i in range(400)]
    asked = [(i, " ".join(rng.choices(words + ["zebra"], k=rng.randint(1, 2))).title(), rng.choice(["York, X", "k", "", "Paris"]),
              rng.choice(["Senior (5+ years)", "Mid", "", None])) for i in range(120)] + [(900, "", "York", "")]
    out = {}
    for r in SM.similar_jobs(
            spark.createDataFrame(asked, "request_id int, job_title string, city string, seniority_level string"),
            spark.createDataFrame(jobs, "id int, job_title string, company_name string, city string, salary_usd_numeric double, "
                                        "seniority_level string, remote_type string, source_website string"), 4).collect():
        out.setdefault(r["request_id"], {})[r["position"]] = r["id"]
    for rid, title, city, level in asked:
        low = title.lower()
        kw = next((w for w in low.split() if len(w) >= 4), low)
        ck, lk = city.split(",")[0].strip().lower(), (level or "").split("(")[0].strip().lower()

        def best(strict):
            rows = [j for j in jobs if j[4] is not None and kw in j[1].lower()
                    and (not strict or ((not ck or (j[3] and ck in j[3].lower())) and (not lk or (j[5] and lk in j[5].lower()))))]
            return [j[0] for j in sorted(rows, key=lambda j: (-j[4], j[0]))[:4]]

        expected = best(True) or (best(False) if kw else [])
        assert [i for _, i in sorted(out.get(rid, {}).items())] == expected, (rid, title, city, level)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    one = {r["id"] for r in df.repartition(1).where(MD.split_column()).collect()}
    many = {r["id"] for r in df.repartition(13).where(MD.split_column()).collect()}
    assert one == many and 700 < len(one) < 900


def test_training_run(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["Data Engineer", "QA Tester"]), rng.choice(["Berlin", "Paris"]), rng.choice(["Python, SQL", "Java"]), f"{i % 9}+ years")
            for i in range(400)]
    jobs = spark.createDataFrame(rows, "id int, job_title string, city string, skills_required string, experience_required string").select(
        "*", (60000 + 4000 * (F.col("id") % 9) + F.when(F.col("city") == "Berlin", 9000).otherwise(0)).cast("double").alias("salary_usd_numeric"),
        F.lit("Senior (5+ years)").alias("seniority_level"), F.lit(None).cast("string").alias("job_description"),
        F.lit("Indeed").alias("source_website"))
    model = MD.train(spark, jobs, scratch_path(spark, "t"), {"random_forest": lambda: MD.random_forest(20, 6)})
    assert model.metrics["r2"] > 0.8 and len(model.columns) == len(set(model.columns))
    path = scratch_path(spark, "m")
    model.save(spark, path)
    back = MD.SalaryModel.load(spark, path)
    a = sorted(map(tuple, model.predict_band(jobs, ["id"]).collect()))
    assert a == sorted(map(tuple, back.predict_band(jobs, ["id"]).collect())) and len(a) == 400
    gate = MD.promotion_gate(spark.createDataFrame([(0.5, 0.51), (0.4, 0.5), (0.4, None)], "new_r2 double, old_r2 double"))
    assert [r["promoted"] for r in gate.collect()] == [True, False, True]


def test_csv_round_trip_with_breaks_and_quotes(spark):
    df = spark.createDataFrame([(1, 'say "hi"\nnext, line'), (2, None)], "id int, t string")
    path = scratch_path(spark, "csv")
    io.write_csv(df, path)
    assert sorted(map(tuple, io.scan_csv(spark, path, df.schema, breaks=True).collect())) == [(1, 'say "hi"\nnext, line'), (2, None)]
    assert io.scan_jobs(spark, scratch_path(spark, "absent")).count() == 0


def test_stream_equals_batch_over_several_files(spark):
    rows = [(i, f"t{i % 23}", f"c{i % 5}", "x", None if i % 4 else "$90k", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, job_title string, company_name string, city string, salary string, dedup_key string")
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    for lo, hi in ((0, 150), (150, 400)):
        df.where((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(src)
        ST.insert_new(stream(), f"{out}/a", f"{out}/ca", ["id"])
        ST.accumulate(stream(), f"{out}/b", f"{out}/cb", ["id"])
    keyed = K.with_key(df)
    first = {r["dedup_key"]: r["id"] for r in K.first_per(keyed, ["dedup_key"], ["id"]).collect()}
    assert {r["dedup_key"]: r["id"] for r in spark.read.parquet(f"{out}/a").collect()} == first
    paid = {r["dedup_key"]: r["salary"] for r in K.keep_with_salary(keyed).collect()}
    master = ST.current_master(spark, f"{out}/b").collect()
    assert {r["dedup_key"]: r["salary"] for r in master} == paid and len(master) == len(paid)


def test_first_seen_over_several_batches(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 17}") for i in range(300)]
    df = spark.createDataFrame(rows, "i int, key string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1700000000) + F.col("i") * 60))
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for lo, hi in ((0, 120), (120, 300)):
        df.where((F.col("i") >= lo) & (F.col("i") < hi)).coalesce(1).write.mode("append").parquet(src)
        arriving = spark.readStream.schema(df.schema).parquet(src)
        ST.append_stream(ST.first_seen(arriving, ["key"], delay="2 days"), f"{out}/t", f"{out}/c")
    got = [r["key"] for r in spark.read.parquet(f"{out}/t").collect()]
    assert len(got) == len(set(got)) and set(got) == {k for _, k in rows}


def test_identity_keeps_glued_postings_apart(spark):
    schema = "id int, company_name string, job_title string, city string, salary string, dedup_key string"
    rows = [(1, "Data", "Engineer II", "x", None, None), (2, "DataE", "ngineer II", "x", None, None), (3, "DATA", "engineer ii", "X", "$9", ""),
            (4, "Data", "Engineer II", "x", None, "own")]
    df = spark.createDataFrame(rows, schema)
    keyed = K.with_key(df)
    short = {r["id"]: r["dedup_key"] for r in keyed.collect()}
    assert short[1] == short[2] == short[3]  # the short name cannot tell them apart
    assert sorted(r["id"] for r in K.keep_with_salary(keyed).collect()) == [2, 3, 4]
    stored = K.with_key(df.where("id = 1"))
    again = K.with_key(stored.withColumn("company_name", F.lit("cleaned")))
    assert again.first()["identity"] == stored.first()["identity"]
    assert sorted(r["id"] for r in K.insert_if_absent(stored, keyed, keyed.columns).collect()) == [2, 4]


def test_histogram_counts_the_top_value(spark):
    jobs = spark.createDataFrame([(20000.0,), (45000.0,), (100000.0,), (None,), (0.0,)], "salary_usd_numeric double")
    out = [(r["bin"], r["count"]) for r in I.salary_histogram(jobs).collect()]
    assert out == [(20000, 1), (40000, 1), (60000, 0), (80000, 0), (100000, 1)]
    assert I.salary_histogram(jobs.where("false")).count() == 0


def test_late_and_repeated_keys_are_stored_once(spark):
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for day, key in ((20, "a"), (11, "b"), (31, "a"), (30, None)):
        rows = spark.createDataFrame([(day, key), (day, None)], "day int, key string")
        rows.withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("day") * 86400)).coalesce(1).write.mode("append").parquet(src)
        arriving = spark.readStream.schema("day int, key string, ts timestamp").parquet(src)
        ST.store_first_seen(arriving, ["key"], f"{out}/t", f"{out}/c", ["day"])
    assert sorted((r["key"] or "", r["day"]) for r in spark.read.parquet(f"{out}/t").collect()) == [("", 20), ("a", 20), ("b", 11)]


def test_compaction_keeps_the_master(spark):
    rows = [(i, f"t{i % 7}", "c", "x", None if i % 3 else "$9", None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, job_title string, company_name string, city string, salary string, dedup_key string")
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for lo in (0, 20, 40):
        df.where((F.col("id") >= lo) & (F.col("id") < lo + 20)).coalesce(1).write.mode("append").parquet(src)
        ST.accumulate(spark.readStream.schema(df.schema).parquet(src), f"{out}/t", f"{out}/c", ["id"])
        if lo == 20:
            before = sorted((r["identity"], r["id"]) for r in ST.current_master(spark, f"{out}/t").collect())
            ST.compact(spark, f"{out}/t")
            ST.compact(spark, f"{out}/t")
            assert sorted((r["identity"], r["id"]) for r in ST.current_master(spark, f"{out}/t").collect()) == before
            assert spark.read.parquet(f"{out}/t").select("batch").distinct().count() == 1
    want = {r["identity"]: r["salary"] for r in K.keep_with_salary(K.with_key(df)).collect()}
    assert {r["identity"]: r["salary"] for r in ST.current_master(spark, f"{out}/t").collect()} == want


def test_foldered_tables_stream_their_rows(spark):
    from paylattice.sources.views import Tables
    base = scratch_path(spark, "tables")
    spark.range(30).repartition(3).write.parquet(f"{base}/orders.parquet")
    path = scratch_path(spark, "copy")
    ST.append_stream(Tables(spark, base).stream("orders"), f"{path}/t", f"{path}/c")
    assert spark.read.parquet(f"{path}/t").count() == 30


def test_broken_reads_are_errors_and_csv_splits(spark):
    path = scratch_path(spark, "csv")
    spark.range(2000).selectExpr("CAST(id AS INT) AS id", "repeat('x', 50) AS t").coalesce(1).write.option("header", True).csv(path)
    schema = "id int, t string"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = io.scan_csv(spark, path, spark.createDataFrame([], schema).schema)
        assert rows.select(F.spark_partition_id()).distinct().count() > 3 and rows.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.createDataFrame([("id,t",), ("x,b",), ("3,c",)], "value string").coalesce(1).write.text(f"{path}/bad")
    counted = io.count_bad_rows(spark, f"{path}/bad", spark.createDataFrame([], schema).schema).first()
    assert tuple(counted)[:2] == (2, 1)
    with pytest.raises(ValueError):
        io.scan_jobs(spark, jdbc={"url": "jdbc:none"})
    (spark.createDataFrame([("broken",)], "value string").write.text(f"{path}/text"))
    with pytest.raises(Exception):
        io.scan_jobs(spark, f"{path}/text").count()


# --- pages with nested elements -------------------------------------------------

def page(spark, html):
    return spark.createDataFrame([(1, "u", html, "data engineer", "Berlin, Germany", 1.0)],
                                 "page_id long, url string, html string, keyword string, location string, usd_rate double")


def test_cards_end_at_their_own_closing_tag(spark):
    from paylattice.operators import pages as P

    def card(name, title):
        return (f'<div class="job_card"><div class="job_card_head"><h2>{title}</h2><br/><img src="a"></div><!-- </div> -->'
                f'<div class="box"><span class="company"><span>{name}</span> Ltd</span></div><div><DIV class="location">Oslo</DIV></div>'
                '<div class="snippet"><div>5+ years of Python</div><div>$100k - $140k plus bonus</div></div></div>')

    html = f'<div id="list">{card("Acme", "Data Engineer")}<div>ad</div>{card("Bolt", "Data Analyst")}</div><div>foot</div>'
    rows = P.card_jobs(page(spark, html)).orderBy("job_title").collect()
    assert [(r.job_title, r.company_name, r.location, r.experience_required, r.has_bonus) for r in rows] == [
        ("Data Analyst", "Bolt Ltd", "Oslo", "5+ years", 1), ("Data Engineer", "Acme Ltd", "Oslo", "5+ years", 1)]
    assert all(r.job_description == "5+ years of Python $100k - $140k plus bonus" and r.salary for r in rows)
    # an inner element that is never closed loses no later card
    broken = html.replace('<div class="box">', "", 1).replace('<div id="list">', '<div id="list"><div class="job_card"><div><h3>Odd</h3></div>', 1)
    assert {r.job_title for r in P.card_jobs(page(spark, broken)).collect()} == {"Odd", "Data Engineer", "Data Analyst"}


def test_pay_cells_and_marked_elements_are_read_whole(spark):
    from paylattice.operators import pages as P
    cell = '<div class="tablerow__value"><div>Base Salary:</div> <b>$70k</b><div> - $120k</div></div>'
    assert P.page_salary_range(page(spark, cell)).first()[1:] == (70000, 120000)
    for html in ('<p>$20 per hour</p><div class="salary-estimate"><div>Est.</div><div>$50 per hour</div></div>',
                 '<p>$20 per hour</p><span>Compensation <span>(est.)</span> $50 per hour</span>'):
        assert P.page_salary_scan(page(spark, html)).first()["salary_usd"] == 104000.0
