"""Search over a stored inverted index, with pages that start after a given row.

Substring conditions cannot use an ordinary index, so a plain search reads the whole table.
Here every distinct text of a searched field is filed under its short character grams, and the
rows of a text stand in a posting list.  A search reads the gram folders of its needles, tests the
few texts found there exactly, reads the posting lists of those that hold the needle, and fetches
the listings of one page.  Batches of rows are segments, published at once like other stored tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.published import Published
from .search import LISTED

#: Longest grams under which a text is filed.
GRAM = 3
#: Grams of a needle that are looked up; fewer only mean that more texts are tested.
PROBES = 4
#: Fields searched by substring; skills are filed piece by piece, as no needle holds a comma.
FIELDS = ["job_title", "company_name", "city", "seniority_level", "skills_required"]
#: What a posting carries beside the id: order of pages and conditions that need no text.
ORDER = ["no_link", "scraped_at", "id"]
EXACT = ["salary_usd_numeric", "remote_type", "source_website"]

#: Stored type of each listed column; a batch without rows has no file that would tell.
KINDS = {c: "string" for c in LISTED} | {"id": "bigint", "salary_usd_numeric": "double", "has_equity": "boolean", "has_bonus": "boolean",
                                         "is_faang": "double", "scraped_at": "timestamp"}
_POSTED = ", ".join(f"{c} {'int' if c == 'no_link' else KINDS[c]}" for c in [*ORDER, *EXACT])
SCHEMAS = {"rows": ", ".join(f"{c} {k}" for c, k in KINDS.items()) + ", no_link int, bucket int",
           "postings": f"value string, {_POSTED}, field string, bucket int", "grams": "value string, gram string, field string, bucket int"}


def probes(needle: str) -> list[str]:
    """Up to ``PROBES`` grams of a needle, evenly spread."""
    size = min(len(needle), GRAM)
    grams = [needle[i : i + size] for i in range(len(needle) - size + 1)]
    return sorted({grams[i * (len(grams) - 1) // max(PROBES - 1, 1)] for i in range(PROBES)})


def grams(text: Column) -> Column:
    """All distinct grams of a text, of one character up to ``GRAM``."""
    def of(size: int) -> Column:
        last = F.length(text) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


def after_row(last: Row) -> Column:
    """Rows behind ``last`` in the order of pages: with a link first, newest first (null last), then id."""
    if last["scraped_at"] is None:
        later = F.col("scraped_at").isNull() & (F.col("id") > last["id"])
    else:
        at = F.lit(last["scraped_at"])
        later = (F.col("scraped_at") < at) | F.col("scraped_at").isNull() | ((F.col("scraped_at") == at) & (F.col("id") > last["id"]))
    return (F.col("no_link") > last["no_link"]) | ((F.col("no_link") == last["no_link"]) & later)


def in_page_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("no_link", F.col("scraped_at").desc_nulls_last(), "id")


class SearchIndex(Published):
    """Listings with their grams and posting lists, split into buckets.

    ``add(rows, name)`` stores a batch of listings once; ids must not be null and not
    repeat within the index (``insert_if_absent`` sees to that before).  Absent columns
    count as null, other columns are left out, null texts match no condition, and an empty needle restricts nothing.
    A segment is complete before it is seen, so a search never meets half of one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, key=None, buckets=buckets, label="segment")

    def _store(self, rows: DataFrame, key: str, folder: str, order: list[str], also: list[str] | None = None) -> None:
        split = [*(also or []), "bucket"]
        placed = rows.withColumn("bucket", self.bucket(F.col(key))).hint("rebalance", *split)
        placed.sortWithinPartitions(*split, *order).write.mode("overwrite").partitionBy(*split).parquet(folder)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        path = f"{self.path}/{folder}"
        kept = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in KINDS.items()])
        kept = kept.withColumn("no_link", F.when(F.coalesce(F.col("job_link"), F.lit("")) != "", 0).otherwise(1))
        self._store(kept, "id", f"{path}/rows", ["id"])
        kept = self._open(folder, "rows")

        def texts(field: str) -> Column:
            low = F.lower(F.col(field).cast("string"))
            pieces = F.transform(F.split(low, ","), F.trim) if field == "skills_required" else F.array(low)
            named = F.transform(pieces, lambda p: F.struct(F.lit(field).alias("field"), p.alias("value")))
            return F.coalesce(F.filter(named, lambda s: F.coalesce(s["value"], F.lit("")) != ""),
                              F.array().cast("array<struct<field:string,value:string>>"))

        every = F.array_distinct(F.concat(*[texts(f) for f in FIELDS]))
        posted = kept.select(F.explode(every).alias("t"), *ORDER, *EXACT).select("t.field", "t.value", *ORDER, *EXACT)
        self._store(posted, "value", f"{path}/postings", ["value", "no_link", "scraped_at"], ["field"])
        known = self._open(folder, "postings").select("field", "value").distinct()
        filed = known.select("field", "value", F.explode(grams(F.col("value"))).alias("gram"))
        self._store(filed, "gram", f"{path}/grams", ["gram"], ["field"])

    def part(self, name: str) -> DataFrame:
        """Rows of ``rows``, ``postings`` or ``grams`` of all published segments."""
        folders = self.pointer.read()
        if not folders:
            raise ValueError(f"nothing is published below {self.path}")
        # each segment is its own root of bucket folders
        return reduce(DataFrame.unionByName, [self._open(folder, name) for folder in folders])

    def _open(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}/{name}")

    def texts_with(self, fields: list[str], needle: str) -> DataFrame:
        """(field, value, bucket): the distinct texts of these fields that hold a lower-case needle."""
        asked = probes(needle)
        numbers = [F.pmod(F.xxhash64(F.lit(g)), F.lit(self.buckets)).cast("int") for g in asked]
        found = (self.part("grams").where(F.col("field").isin(fields) & reduce(
            lambda a, b: a | b, [(F.col("bucket") == n) & (F.col("gram") == g) for n, g in zip(numbers, asked, strict=True)]))
            .where(F.col("value").contains(needle)))
        return found.groupBy("field", "value").agg(F.lit(1).alias("one")).select("field", "value", self.bucket(F.col("value")).alias("bucket"))

    def matches(self, keyword: str | None = None, city: str | None = None, min_salary: float | None = None,
                max_salary: float | None = None, remote_type: str | None = None, seniority_level: str | None = None,
                skills: str | None = None, source: str | None = None, after: Row | None = None) -> DataFrame:
        """(no_link, scraped_at, id) of the rows that meet all given conditions, those of ``search.predicate``."""
        asked = [(["job_title", "company_name"], [keyword.lower()])] if keyword else []
        asked += [([field], [text.lower()]) for field, text in (("city", city), ("seniority_level", seniority_level)) if text]
        pieces = [s.strip().lower() for s in (skills or "").split(",") if s.strip()]
        asked += [(["skills_required"], pieces)] if pieces else []

        rest = F.lit(True)
        if min_salary is not None:
            rest &= F.col("salary_usd_numeric") >= min_salary
        if max_salary is not None:
            rest &= F.col("salary_usd_numeric") <= max_salary
        if remote_type:
            rest &= F.lower(F.col("remote_type")) == remote_type.lower()
        if source:
            rest &= F.lower(F.col("source_website")) == source.lower()
        if after is not None:
            rest &= after_row(after)
        if not asked:
            return self.part("rows").where(rest).select(*ORDER)

        wanted = reduce(DataFrame.unionByName, [
            self.texts_with(fields, needle).withColumn("mark", F.lit(1 << number))
            for number, (fields, needles) in enumerate(asked) for needle in needles])
        wanted = wanted.groupBy("field", "bucket", "value").agg(F.bit_or("mark").alias("mark"))
        met = self.part("postings").where(F.col("field").isin(sorted({f for fields, _ in asked for f in fields})) & rest)
        met = met.join(wanted, ["field", "bucket", "value"]).groupBy(*ORDER).agg(F.bit_or("mark").alias("mark"))
        return met.where(F.col("mark") == (1 << len(asked)) - 1).select(*ORDER)

    def page(self, page_size: int = 20, after: Row | None = None, **filters) -> DataFrame:
        """Listings of the page that starts behind ``after``, with ``no_link`` and ``scraped_at``.

        ``after`` is the last row of the page before (any Row with no_link, scraped_at
        and id), so a deep page costs what the first one does.  The page has ``page_size``
        ids at most, which are broadcast to open their buckets of listings only.
        """
        ids = in_page_order(self.matches(after=after, **filters)).limit(page_size)
        ids = ids.select("id", self.bucket(F.col("id")).alias("bucket"))
        rows = self.part("rows").join(F.broadcast(ids), ["bucket", "id"])
        return in_page_order(rows.select(*LISTED, "no_link", "scraped_at"))

    def total(self, page_size: int = 20, **filters) -> DataFrame:
        """Number of matches and of pages, from postings alone."""
        return self.matches(**filters).agg(F.count(F.lit(1)).alias("total")).select(
            "total", F.ceil(F.col("total") / page_size).alias("pages"))

