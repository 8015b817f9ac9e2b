"""Structured Streaming jobs over arriving listings and task reports."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_per, insert_if_absent, keep_with_salary, small_side, with_key
from ..operators.quality import source_health
from ..sources.io import delete
from ..sources.published import BUCKET, Published


SEEN = f"identity string, salary string, batch long, {BUCKET} int"  # what later batches need of stored rows


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


@contextmanager
def held(batch: DataFrame):
    """A batch that several steps read: computed once, and again only where an executor is lost."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def stored_before(table: Published, batch_id: int, schema: str, batch: DataFrame) -> DataFrame:
    """Published rows of earlier batches that lie in the buckets of this batch's keys."""
    earlier = [n for n in table.names() if int(n) < batch_id]  # compacted ones have negative names
    rows = table.read(schema, among=batch, names=earlier)
    return table.spark.createDataFrame([], schema) if rows is None else rows


def read_table(spark: SparkSession, path: str, key: str = "identity") -> DataFrame:
    """The published rows of a table that one of these streams stores."""
    rows = Published(spark, path, key).read()
    if rows is None:
        raise ValueError(f"nothing is published below {path}")
    return rows.drop("batch", BUCKET)


def insert_new(listings: DataFrame, path: str, checkpoint: str, order: list[str]) -> None:
    """Store arriving listings whose key is not stored yet, for all time.

    Every micro-batch is published once under its number, and it looks only at earlier
    batches for stored keys, so a retry after a lost executor or driver stores the same
    rows once.  Of the stored table only the buckets of the batch's keys are read.
    """
    keyed = with_key(listings)
    arrived = F.col("scraped_at") if "scraped_at" in keyed.columns else F.current_timestamp()

    def store(batch: DataFrame, batch_id: int) -> None:
        table = Published(batch.sparkSession, path)
        with held(batch):
            stored = stored_before(table, batch_id, SEEN, batch)
            table.add(insert_if_absent(stored, batch, keyed.columns, order, stamp=arrived), str(batch_id))

    run_available(keyed.writeStream.foreachBatch(store), checkpoint)


def accumulate(listings: DataFrame, path: str, checkpoint: str, order: list[str]) -> None:
    """Merge arriving batches into a master where a row with pay replaces one without.

    A batch stores only what changes the master: rows of new keys, and rows with
    pay for keys stored without.  The master itself is never rewritten;
    ``current_master`` picks the winning one of at most two rows per key.
    """
    keyed = with_key(listings)

    def store(batch: DataFrame, batch_id: int) -> None:
        table = Published(batch.sparkSession, path)
        with held(keep_with_salary(batch, order)) as best:
            stored = stored_before(table, batch_id, SEEN, best)
            stored = stored.join(small_side(best.select("identity")), "identity", "left_semi")
            known = stored.groupBy("identity").agg(F.max(F.col("salary").isNotNull()).alias("_paid"))
            better = F.col("_paid").isNull() | (~F.col("_paid") & F.col("salary").isNotNull())
            table.add(best.join(known, "identity", "left").where(better).drop("_paid"), str(batch_id))

    run_available(keyed.writeStream.foreachBatch(store), checkpoint)


def current_master(spark: SparkSession, path: str) -> DataFrame:
    rows = Published(spark, path).read()
    if rows is None:
        raise ValueError(f"nothing is published below {path}")
    return keep_with_salary(rows, ["batch"]).drop("batch", BUCKET)


def compact(spark: SparkSession, path: str) -> None:
    """Replace the batches of an accumulated table by one that holds its current rows.

    The new folder is published in one step; readers see all batches or the compacted
    one, wherever a run breaks off.  If a stream publishes a batch meanwhile, this run gives up
    with a Conflict and changes nothing.  Folders out of use go with the compaction after.
    """
    table = Published(spark, path)
    names = table.names()
    if len(names) < 2:
        table.pointer.remove_unlisted("batch=")
        return
    lowest = min(int(n.removeprefix("batch=")) for n in table.pointer.entries() if n.startswith("batch="))
    table.replace(current_master(spark, path), str(min(lowest, 0) - 1))
    number = table.pointer.number()
    for name in set(table.pointer.read(number - 1)) - set(table.pointer.read(number)):
        delete(spark, f"{path}/{name}")


def store_first_seen(rows: DataFrame, keys: list[str], path: str, checkpoint: str, order: list) -> None:
    """Store the first arrival of every key, for all time, however late it comes.

    As ``insert_new``: each micro-batch owns a folder and looks at earlier ones, of which
    only rows of its own keys are shuffled.
    """
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})

    def store(batch: DataFrame, batch_id: int) -> None:
        table = Published(batch.sparkSession, path, key="_key")
        with held(first_per(batch.withColumn("_key", name), ["_key"], order)) as best:
            stored = stored_before(table, batch_id, f"_key string, batch long, {BUCKET} int", best).select("_key")
            known = stored.join(small_side(best.select("_key")), "_key", "left_semi")
            table.add(best.join(known, "_key", "left_anti"), str(batch_id))

    run_available(rows.writeStream.foreachBatch(store), checkpoint)


def first_seen(listings: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day", salts: int = 16) -> DataFrame:
    """First arrival per key within a time limit: the form for streams whose keys come back soon or never.

    State is bounded, at a price: a key that arrives later than ``delay`` behind the
    newest row is dropped, and one that comes again after it is stored twice.  Where
    that matters, use ``store_first_seen``.

    Two steps: the copies of a hot key are first thinned out over ``salts`` tasks,
    so that at most that many rows per key meet in the second step.
    """
    stamped = listings.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    salted = stamped.withColumn("_salt", F.pmod(F.xxhash64(time), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).dropDuplicatesWithinWatermark(keys).drop("_salt")


def first_seen_by_state(listings: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Store the first arrival of every key from keyed state alone, without reading what is stored.

    The state holds each key once, for all time, in RocksDB on the executors' disks; each
    batch adds its changes to the checkpoint, so a restart or a lost executor goes on from there.
    Right for many small batches; state grows with the number of keys.
    """
    conf = listings.sparkSession.conf
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: conf.get(k, None) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        append_stream(listings.dropDuplicates(keys), path, checkpoint)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> None:
    run_available(rows.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)


def running_health(events: DataFrame, path: str, checkpoint: str) -> None:
    """Current health per source; each batch replaces the result table."""
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        delete(batch.sparkSession, f"{path}/batch={batch_id - 2}")  # readers may still hold the one before

    run_available(source_health(events).writeStream.outputMode("complete").foreachBatch(store), checkpoint)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.select(F.max("batch").alias("b")).scalar()).drop("batch")
