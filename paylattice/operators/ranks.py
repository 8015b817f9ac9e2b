"""Exact order statistics per group, without gathering a group in one task.

A group may hold a third of all rows, so its values are never sorted as a
whole.  Rows are first counted per (group, value) with map-side combine, the
counts are rolled up into bins of ``width``, and a running sum over the bins
finds the bin that holds the wanted rank.  Only that bin's values are sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_WIDTH = 1000.0


def value_counts(df: DataFrame, keys: list[str], value: str, width: float = BIN_WIDTH) -> DataFrame:
    """Row count per (keys, value); rows with a null key or value are left out.

    The not-null conditions are spelled out because a later join would add them
    to its own side only; with equal sides Spark shuffles the counts once.
    """
    known = F.floor(F.col("_v") / width).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return (
        df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull() & known)
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col("_v") / width))
    )


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    width: float = BIN_WIDTH,
) -> DataFrame:
    """One row per group: ``n``, ``total``, ``low``, ``high`` and one column per rank.

    A rank is a function from the group's row count to a zero-based position in
    ascending order.
    """
    counts = value_counts(df, keys, value, width)
    bins = counts.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bin_n"),
        F.sum(F.col("_v") * F.col("_n")).alias("_bin_total"),
        F.min("_v").alias("_bin_low"),
        F.max("_v").alias("_bin_high"),
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys, "_bin", "_bin_n",
        F.coalesce(F.sum("_bin_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_bin_n").over(whole).alias("n"),
        F.sum("_bin_total").over(whole).alias("total"),
        F.min("_bin_low").over(whole).alias("low"),
        F.max("_bin_high").over(whole).alias("high"),
    )
    asked = F.array(*[
        F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("at")) for name, rank in ranks.items()
    ])
    wanted = (
        bins.withColumn("_ask", F.explode(asked))
        .where((F.col("_ask.at") >= F.col("_before")) & (F.col("_ask.at") < F.col("_before") + F.col("_bin_n")))
        .select(*keys, "_bin", "n", "total", "low", "high",
                F.col("_ask.name").alias("_name"), (F.col("_ask.at") - F.col("_before")).alias("_offset"))
    )
    running = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(wanted, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(running))
        .where((F.col("_upto") > F.col("_offset")) & (F.col("_upto") - F.col("_n") <= F.col("_offset")))
    )
    return picked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("n", "total", "low", "high")],
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def with_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group statistics with the upper median: the element at n // 2."""
    return order_stats(df, keys, value, {"median": lambda n: F.floor(n / 2)})


def linear_percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours, as ``p10``, ``p25``, ..."""

    def position(n: Column, p: int) -> Column:
        return (n - 1) * (p / 100)

    ranks = {}
    for p in percents:
        ranks[f"_lo{p}"] = lambda n, p=p: F.floor(position(n, p))
        ranks[f"_hi{p}"] = lambda n, p=p: F.ceil(position(n, p))
    stats = order_stats(df, keys, value, ranks)
    return stats.select(*keys, "n", *[
        (F.col(f"_lo{p}") + (F.col(f"_hi{p}") - F.col(f"_lo{p}"))
         * (position(F.col("n"), p) - F.floor(position(F.col("n"), p)))).alias(f"p{p}")
        for p in percents
    ])


def percentile_of(train: DataFrame, train_value: str, scored: DataFrame, value: str,
                  name: str = "percentile", width: float = BIN_WIDTH) -> DataFrame:
    """Share of training values strictly below each scored value, in 1..99.

    Training counts and distinct scored values meet in bins of ``width``: inside
    a bin a running sum counts the smaller values, and whole bins below are
    added from the bin totals.  The bin totals are one row per occupied bin.
    """
    counts = value_counts(train, [], train_value, width)
    asked = (
        scored.select(F.col(value).alias("_v"))
        .where(F.col("_v").isNotNull() & F.floor(F.col("_v") / width).isNotNull()).distinct()
        .select("_v", F.lit(0).cast("bigint").alias("_n"), F.floor(F.col("_v") / width).alias("_bin"),
                F.lit(0).alias("_side"))
    )
    both = counts.select("_v", "_n", "_bin", F.lit(1).alias("_side")).unionByName(asked)
    totals = both.groupBy("_bin").agg(F.sum("_n").alias("_bin_n"))
    line = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_bin", F.coalesce(F.sum("_bin_n").over(line), F.lit(0)).alias("_before"),
        F.sum("_bin_n").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    inside = Window.partitionBy("_bin").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("_below") / F.col("_all") * 100
    ranked = (
        both.withColumn("_in", F.sum("_n").over(inside)).where(F.col("_side") == 0)
        .join(totals, "_bin")
        .select(F.col("_v").alias(value), (F.col("_before") + F.col("_in")).alias("_below"), "_all")
        .select(value, F.greatest(F.lit(1), F.least(F.lit(99), share.cast("int"))).alias(name))
    )
    return scored.join(ranked, value, "left")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row results side by side without a join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy().agg(*[F.max(c).alias(c) for c in out.columns])
