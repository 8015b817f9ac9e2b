"""Duplicates, unions, insert-if-absent, upserts.

All of them are keep-one-per-key windows.  Spark turns ``row_number() = 1`` into
a group limit that already runs before the shuffle, so the copies of a hot key
are dropped on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_key, identity


def first_per(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every key in the given order; ``rank`` keeps the position."""
    position = rank or "_position"
    out = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(position) <= n)
    return out if rank else out.drop(position)


def with_key(df: DataFrame) -> DataFrame:
    """Add ``dedup_key``, the short name, and ``identity``, which decides what is the same posting.

    An identity that a row already has stays, so that later cleaning of its title or
    company does not make it another posting.
    """
    existing = F.col("dedup_key") if "dedup_key" in df.columns else F.lit(None).cast("string")
    parts = [F.col(c) for c in ("company_name", "job_title", "city")]
    same = identity(existing, *parts)
    return df.withColumns({
        "dedup_key": dedup_key(existing, *parts),
        "identity": F.coalesce(F.col("identity"), same) if "identity" in df.columns else same,
    })


def key_column(*frames: DataFrame) -> str:
    """``identity``; the short ``dedup_key`` only where no table knows more than that.

    A table without identities beside one that has them is an error, as the short key
    alone would merge different postings.
    """
    known = ["identity" in f.columns for f in frames]
    if any(known) and not all(known):
        raise ValueError("some tables have no identity: add it with with_key(), or name the key column")
    return "identity" if any(known) else "dedup_key"


def keep_with_salary(df: DataFrame, order: list | None = None, key: str | None = None) -> DataFrame:
    """One row per posting, rows that name a salary first."""
    return first_per(df, [key or key_column(df)], [F.col("salary").isNull(), *(order or ["id"])])


def keep_first(frames: list[DataFrame], order: list | None = None) -> DataFrame:
    """Union of sources in priority order; the first source wins per key."""
    merged = None
    for rank, f in enumerate(frames):
        f = with_key(f).withColumn("_source_rank", F.lit(rank))
        merged = f if merged is None else merged.unionByName(f, allowMissingColumns=True)
    return first_per(merged, ["identity"], ["_source_rank", *(order or ["id"])]).drop("_source_rank")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union of tables with differing columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_master(master: DataFrame, batch: DataFrame, order: list | None = None) -> DataFrame:
    """Master plus one run's batch, one row per key, salary rows win."""
    merged = union_sources(master.withColumn("_new", F.lit(0)), batch.withColumn("_new", F.lit(1)))
    return keep_with_salary(merged, ["_new", *(order or ["id"])]).drop("_new")


def run_summary(master: DataFrame, batch: DataFrame, key: str | None = None) -> DataFrame:
    """Counts of one accumulation run, from keys alone."""
    key = key or key_column(master, batch)
    tagged = master.select(key, F.lit(0).alias("_new")).unionByName(batch.select(key, F.lit(1).alias("_new")))
    per_key = tagged.groupBy(key).agg(
        F.sum(1 - F.col("_new")).alias("_old"), F.sum("_new").alias("_add"))
    return per_key.agg(
        F.coalesce(F.sum("_add"), F.lit(0)).alias("new_jobs"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("_old"), F.lit(0))).alias("unique_added"),
        (F.coalesce(F.sum(F.col("_old") + F.col("_add")), F.lit(0)) - F.count(F.lit(1))).alias("duplicates_dropped"),
        F.count(F.lit(1)).alias("total_jobs"),
    )


def insert_if_absent(existing: DataFrame, batch: DataFrame, columns: list[str], order: list | None = None,
                     key: str | None = None, stamp: Column | None = None) -> DataFrame:
    """Rows of the batch that an insert with do-nothing-on-conflict would add.

    Columns the table does not have are dropped.  The first row of a key wins
    inside the batch, keys already stored are skipped, null keys never conflict;
    those rows get a key of their own so that they do not meet in one task.
    """
    order, key = order or ["id"], key or key_column(existing, batch)
    alone = F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string"))
    first = first_per(batch.withColumn("_key", F.coalesce(F.col(key), alone)), ["_key"], order)
    stored = existing.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"))
    stored = stored.join(small_side(first.select("_key")), "_key", "left_semi")
    fresh = first.join(stored, "_key", "left_anti")
    kept = [c for c in columns if c in batch.columns and c != "scraped_at"]
    return fresh.select(*kept, (F.current_timestamp() if stamp is None else stamp).alias("scraped_at"))


def small_side(keys: DataFrame, bytes_per_row: int = 128) -> DataFrame:
    """Keys of a batch, marked for broadcast if their counted size allows it.

    History is cut to these keys first; then it is read but not shuffled.  A batch of
    more keys is joined as Spark sees fit.
    """
    spark = keys.sparkSession
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return F.broadcast(keys) if keys.count() * bytes_per_row <= limit else keys


def upsert(rows: DataFrame, keys: list[str], newest: list) -> DataFrame:
    """Last write per key."""
    return first_per(rows, keys, newest)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def latest_per(rows: DataFrame, key: str, newest: list, n: int) -> DataFrame:
    return first_per(rows, [key], newest, n, rank="position")
