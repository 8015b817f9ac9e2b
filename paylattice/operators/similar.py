"""Best-paid comparable postings per request.

A posting compares when its title contains the request's keyword, its city the
request's city part and its level the request's level part.  Substring tests do
not hash, so a direct join would compare every request with every posting.
Instead every text column is matched once on *distinct* values through short
character grams (``substring_pairs``), and the postings then move through three
equality joins.  After each step only the k best rows per key survive; that is
exact, because a row outside the k best of a finer key cannot be among the k
best of a coarser one, and Spark cuts to k before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import scratch_path
from .dedup import first_per

PAY = "salary_usd_numeric"
COMPACT = ["id", "job_title", "company_name", "city", PAY, "seniority_level", "remote_type", "source_website"]
GRAM = 4


def keyword(title: Column) -> Column:
    """First word of at least four letters, else the whole title."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(F.get(F.filter(F.split(low, r"(?U)\W+"), lambda w: F.length(w) >= 4), F.lit(0)), low)


def city_part(city: Column) -> Column:
    return strip(F.lower(F.substring_index(F.coalesce(city, F.lit("")), ",", 1)))


def level_part(level: Column) -> Column:
    return strip(F.lower(F.substring_index(F.coalesce(level, F.lit("")), "(", 1)))


def substring_pairs(keys: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """Pairs (key, value) of distinct non-empty texts with the key inside the value.

    A key is filed under its rarest gram (its own text when shorter than a gram),
    a value under all its grams; they meet on the gram and the test is then done
    exactly.
    """
    keys = keys.where(F.col(key) != "").select(key).distinct()
    values = values.where(F.col(value).isNotNull()).select(value).distinct()

    def grams(c: Column, size: int) -> Column:
        n = F.length(c) - size + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))

    filed = values.select(value, F.explode(F.array_distinct(F.concat(
        *[grams(F.col(value), size) for size in range(1, GRAM + 1)]))).alias("_gram"))
    common = filed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_spread"))
    own = F.when(F.length(key) < GRAM, F.array(F.col(key))).otherwise(grams(F.col(key), GRAM))
    sized = keys.select(key, F.explode(own).alias("_gram")).join(common, "_gram")
    rarest = sized.groupBy(key).agg(F.min(F.struct("_spread", "_gram"))["_gram"].alias("_gram"))
    return filed.join(rarest, "_gram").where(F.col(value).contains(F.col(key))).select(key, value)


def keys_by_value(keys: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """Per distinct text the request keys it contains; a text holds few of them."""
    return substring_pairs(keys, key, values, value).groupBy(value).agg(F.collect_list(key).alias("_keys"))


def widen(rows: DataFrame, matches: DataFrame, wanted: DataFrame, key: str, value: str, others: list[str], k: int) -> DataFrame:
    """Replace the text column ``value`` by the request keys it contains, keep the k best.

    The empty key stands for "no restriction" and takes every row.
    """
    every = F.concat(F.array(F.lit("")), F.coalesce(F.col("_keys"), F.array().cast("array<string>")))
    found = rows.join(matches, value, "left").withColumn(key, F.explode(every)).drop(value, "_keys")
    found = found.join(wanted.select(key, *others).distinct(), [key, *others], "left_semi")
    rest = [c for c in found.columns if c.startswith("_t")]
    return first_per(found, [key, *others, *rest], [F.desc(PAY), "id"], k)


def best_matches(wanted: DataFrame, jobs: DataFrame, k: int) -> DataFrame:
    """The k best-paid postings for every (keyword, city part, level part)."""
    texts = {"_title": ("_kw", F.lower("job_title")), "_town": ("_city", F.lower("city")),
             "_tier": ("_level", F.lower("seniority_level"))}
    paid = jobs.where(F.col(PAY).isNotNull())
    rows = paid.select(*COMPACT, *[c.alias(name) for name, (_, c) in texts.items()])
    # stored once: it holds every distinct text, and all that follows reads it, not the postings
    best = first_per(rows, list(texts), [F.desc(PAY), "id"], k)
    path = scratch_path(jobs.sparkSession, "best-paid")
    best.write.parquet(path)
    best = rows = jobs.sparkSession.read.schema(best.schema).parquet(path)
    others: list[str] = []
    for value, (key, _) in texts.items():
        matches = keys_by_value(wanted, key, best.select(value), value)
        rows = widen(rows, matches, wanted, key, value, others, k)
        others = [*others, key]
    return rows


COMBO = ["_kw", "_city", "_level"]


def keyed_requests(requests: DataFrame, request_id: str) -> DataFrame:
    return requests.select(
        request_id, keyword(F.col("job_title")).alias("_kw"), city_part(F.col("city")).alias("_city"),
        level_part(F.col("seniority_level")).alias("_level"))


def answers_per_combination(keyed: DataFrame, jobs: DataFrame, k: int) -> DataFrame:
    """Top-k postings per distinct (keyword, city part, level part); without any, the title alone decides."""
    combos = keyed.select(*COMBO).distinct()
    # what a combination may be answered from: its own conditions, else the title alone
    strict = F.struct(F.lit(0).alias("rank"), F.col("_city").alias("city"), F.col("_level").alias("level"))
    loose = F.when(F.col("_kw") != "", F.struct(F.lit(1).alias("rank"), F.lit("").alias("city"), F.lit("").alias("level")))
    routes = combos.withColumn("_r", F.explode(F.array_compact(F.array(strict, loose)))).select(
        *COMBO, F.col("_r.rank").alias("_rank"), F.col("_r.city").alias("_use_city"), F.col("_r.level").alias("_use_level"))
    wanted = routes.select("_kw", F.col("_use_city").alias("_city"), F.col("_use_level").alias("_level")).distinct()
    best = best_matches(wanted, jobs, k).withColumnsRenamed({"_city": "_use_city", "_level": "_use_level"})
    per_combo = Window.partitionBy(*COMBO)
    return (
        routes.join(best, ["_kw", "_use_city", "_use_level"])
        .withColumn("position", F.row_number().over(per_combo.orderBy("_rank", F.desc(PAY), "id")))
        .where(F.col("position") <= k)
        .withColumn("_first", F.min("_rank").over(per_combo))
        .where(F.col("_rank") == F.col("_first"))
        .select(*COMBO, "position", *COMPACT)
    )


def similar_jobs(requests: DataFrame, jobs: DataFrame, k: int = 5, request_id: str = "request_id") -> DataFrame:
    """Top-k comparable postings per request."""
    keyed = keyed_requests(requests, request_id)
    return keyed.join(answers_per_combination(keyed, jobs, k), COMBO).select(request_id, "position", *COMPACT)


def market_reference(requests: DataFrame, jobs: DataFrame, k: int = 50, request_id: str = "request_id") -> DataFrame:
    """Upper median over the k best-paid comparable postings and how many there are.

    Requests that ask the same share one answer; its array holds at most k amounts.
    """
    keyed = keyed_requests(requests, request_id)
    found = answers_per_combination(keyed, jobs, k).groupBy(*COMBO).agg(F.sort_array(F.collect_list(PAY)).alias("_pay"))
    found = found.select(
        *COMBO, F.get("_pay", F.floor(F.size("_pay") / 2).cast("int")).cast("bigint").alias("market_salary_usd"),
        F.size("_pay").alias("evidence_count"))
    return keyed.join(found, COMBO, "left").select(
        request_id, "market_salary_usd", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))
