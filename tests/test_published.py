"""Stored tables under failures: nothing half-written is ever seen, repeated work is stored once."""

import pytest
from pyspark.sql import functions as F

from paylattice.operators import dedup as K
from paylattice.session import scratch_path
from paylattice.sources import io, published
from paylattice.streaming import jobs as ST

SCHEMA = "id int, job_title string, company_name string, city string, salary string, dedup_key string"


class Killed(Exception):
    pass


def listings(spark, lo, hi):
    rows = [(i, f"t{i % 40}", "c", "x", None if i % 3 else "$9", None) for i in range(lo, hi)]
    return spark.createDataFrame(rows, SCHEMA)


def kill_at(monkeypatch, owner, name):
    def die(*args, **kwargs):
        raise Killed(name)
    monkeypatch.setattr(owner, name, die)


@pytest.mark.parametrize("owner, step", [(published.Published, "_write"), (published.Pointer, "swap")])
def test_a_killed_append_changes_nothing_and_can_be_repeated(spark, monkeypatch, owner, step):
    path = scratch_path(spark, "master")
    first, second = K.with_key(listings(spark, 0, 20)), K.with_key(listings(spark, 20, 50))
    assert io.append_master(first, path, "a")
    with monkeypatch.context() as m:
        kill_at(m, owner, step)
        with pytest.raises(Killed):
            io.append_master(second, path, "b")
    assert io.read_master(spark, path).count() == 20
    assert io.append_master(second, path, "b") and not io.append_master(second, path, "b")
    assert sorted(r.id for r in io.read_master(spark, path).collect()) == list(range(50))


def test_two_writers_never_lose_a_run(spark, monkeypatch):
    path = scratch_path(spark, "master")
    io.append_master(K.with_key(listings(spark, 0, 5)), path, "a")
    swap, raced = published.Pointer.swap, []

    def late(self, folders, after):
        if not raced:  # another writer gets in between
            raced.append(1)
            io.append_master(K.with_key(listings(spark, 5, 9)), path, "other")
        return swap(self, folders, after)

    monkeypatch.setattr(published.Pointer, "swap", late)
    io.append_master(K.with_key(listings(spark, 9, 12)), path, "late")
    assert sorted(r.id for r in io.read_master(spark, path).collect()) == list(range(12))
    table = published.Published(spark, path, label="run")
    with pytest.raises(published.Conflict):
        table.pointer.swap(["run=x"], table.pointer.number() - 1)


def test_a_small_batch_opens_only_its_buckets(spark):
    path = scratch_path(spark, "master")
    rows = K.with_key(spark.range(3000).select(F.col("id").cast("int"), F.concat(F.lit("t"), F.col("id")).alias("job_title"), F.lit("c").alias("company_name"),
                                               F.lit("x").alias("city"), F.lit(None).cast("string").alias("salary"), F.lit(None).cast("string").alias("dedup_key")))
    io.append_master(rows, path, "a")
    few = rows.where("id in (7, 1234)")
    seen = io.read_master(spark, path, among=few)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    opened = [r.f for r in seen.select(F.input_file_name().alias("f")).distinct().collect()]
    buckets = {f.split("bucket=")[1].split("/")[0] for f in opened}
    assert len(buckets) <= 2 and seen.count() < 100
    assert K.insert_if_absent(seen, few, few.columns).count() == 0
    new = few.withColumn("identity", F.concat("identity", F.lit("new")))
    assert K.insert_if_absent(io.read_master(spark, path, among=new), new, new.columns).count() == 2


def test_null_keys_are_spread_over_buckets(spark):
    path = scratch_path(spark, "nulls")
    rows = spark.range(500).select("id", F.lit(None).cast("string").alias("identity"))
    table = published.Published(spark, path, buckets=16)
    table.add(rows, "0")
    assert table.read().count() == 500 and table.read().select("bucket").distinct().count() == 16


@pytest.mark.parametrize("owner, step", [(published.Published, "_write"), (published.Pointer, "swap"), (ST, "delete")])
def test_a_killed_compaction_loses_nothing(spark, monkeypatch, owner, step):
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")

    def arrive(lo, hi):
        listings(spark, lo, hi).coalesce(1).write.mode("append").parquet(src)
        ST.accumulate(spark.readStream.schema(SCHEMA).parquet(src), f"{out}/t", f"{out}/c", ["id"])

    def master():
        return sorted((r["identity"], r["salary"] or "") for r in ST.current_master(spark, f"{out}/t").collect())

    arrive(0, 30)
    arrive(30, 50)
    before = master()
    with monkeypatch.context() as m:
        kill_at(m, owner, step)
        with pytest.raises(Killed):
            ST.compact(spark, f"{out}/t")
    assert master() == before
    arrive(50, 90)  # the stream goes on as if nothing had happened
    want = K.keep_with_salary(K.with_key(listings(spark, 0, 90)))
    assert master() == sorted((r["identity"], r["salary"] or "") for r in want.collect())
    ST.compact(spark, f"{out}/t")
    ST.compact(spark, f"{out}/t")
    assert len(master()) == 40 and spark.read.parquet(f"{out}/t").select("batch").distinct().count() == 1


def test_a_replayed_batch_is_stored_once(spark, monkeypatch):
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    listings(spark, 0, 30).coalesce(1).write.parquet(src)

    def run():
        ST.insert_new(spark.readStream.schema(SCHEMA).parquet(src), f"{out}/t", f"{out}/c", ["id"])

    add = published.Published.add
    with monkeypatch.context() as m:
        def add_and_die(self, rows, name):
            add(self, rows, name)
            raise Killed("after publishing")
        m.setattr(published.Published, "add", add_and_die)
        with pytest.raises(Exception):
            run()
    run()
    assert ST.read_table(spark, f"{out}/t").count() == 30 and ST.read_table(spark, f"{out}/t").columns[0] == "id"


def test_state_remembers_keys_over_restarts(spark):
    src, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for batch in ([("a", 1), ("a", 2), (None, 3)], [("a", 4), ("b", 5)], [("b", 6), (None, 7), ("c", 8)]):
        spark.createDataFrame(batch, "key string, n int").coalesce(1).write.mode("append").parquet(src)
        ST.first_seen_by_state(spark.readStream.schema("key string, n int").parquet(src), ["key"], f"{out}/t", f"{out}/c")
    assert sorted(r.key or "" for r in spark.read.parquet(f"{out}/t").collect()) == ["", "a", "b", "c"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == kept
