"""Saved items of users: predictions, offers, resumes, favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import delete_keys, latest_per, upsert


LIMITS = {"favorites": 50}
LIMIT = 20


def newest() -> list:
    return [F.desc("created_at"), F.desc("id")]


def favorites_upsert(writes: DataFrame) -> DataFrame:
    """One row per (user, job), the last write wins."""
    return upsert(writes, ["user_id", "job_id"], newest())


def favorites_delete(favorites: DataFrame, removals: DataFrame) -> DataFrame:
    return delete_keys(favorites, removals, ["user_id", "job_id"])


def favorite_flag(views: DataFrame, favorites: DataFrame) -> DataFrame:
    """Mark which (user, job) pairs are favourites; the favourite side is one row per pair."""
    marks = favorites.select("user_id", "job_id", F.lit(True).alias("is_favorite")).distinct()
    return views.join(marks, ["user_id", "job_id"], "left").withColumn(
        "is_favorite", F.coalesce("is_favorite", F.lit(False)))


def latest_per_user(items: DataFrame, n: int = LIMIT) -> DataFrame:
    return latest_per(items, "user_id", newest(), n)


def append_history(rows: DataFrame, payloads: list[str], path: str) -> None:
    """Append saved items; nested columns are stored as JSON text."""
    rows.withColumns({c: F.to_json(c) for c in payloads}).write.mode("append").parquet(path)


def read_history(spark, path: str, schema: str, payloads: dict[str, str]) -> DataFrame:
    return spark.read.schema(schema).parquet(path).withColumns({
        c: F.from_json(c, kind) for c, kind in payloads.items()})
