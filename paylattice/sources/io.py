"""Readers and writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import JOBS, LISTING
from . import quoted_csv
from .published import BUCKET, Published

BAD_ROW = "_bad_row"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, breaks: bool = True, bad_rows: bool = False) -> DataFrame:
    """Quoted CSV with a header; the schema is given, never inferred.

    Files are split over many tasks and records keep line breaks inside quoted fields,
    for which lines are read twice.  ``breaks=False`` is the plain reader, for files
    known to have none: there every line is a record.  ``bad_rows`` adds ``_bad_row``,
    the text of a record that does not fit the schema; ``count_bad_rows`` counts them.
    """
    names = schema.names
    if bad_rows:
        schema = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    options = {"escape": '"', "columnNameOfCorruptRecord": BAD_ROW}
    if breaks:
        return quoted_csv.parse(quoted_csv.records(spark, path, names), schema, options | {"multiLine": "true"})
    return spark.read.schema(schema).options(header=True, enforceSchema=False, **options).csv(path)


def count_bad_rows(spark: SparkSession, path: str, schema: T.StructType, breaks: bool = True) -> DataFrame:
    """One row: records read, records that do not fit the schema, and a checksum of the fields."""
    rows = scan_csv(spark, path, schema, breaks, bad_rows=True)
    # the checksum needs every field; else the parser would skip them and find nothing wrong
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(BAD_ROW).alias("bad_rows"),
                    F.bit_xor(F.xxhash64(*schema.names)).alias("checksum"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Quoted CSV with a header; spaces and line breaks at the ends of texts stay."""
    df.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                compression=compression).csv(path)


def is_absent(error: AnalysisException) -> bool:
    """Whether nothing is stored there yet; any other failure to read is an error."""
    return error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scan_jobs(spark: SparkSession, path: str | None = None, table: str | None = None,
              jdbc: dict[str, str] | None = None, one_task: bool = False) -> DataFrame:
    """The whole jobs table from files, the catalog or a database; absent means empty.

    For a database give ``partitionColumn``, bounds and ``numPartitions`` in
    ``jdbc``, so that the scan is split over the key; without them the whole table would
    come through one task, which takes ``one_task=True``.
    """
    bounds = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}
    if jdbc and not one_task and not bounds <= set(jdbc):
        raise ValueError(f"give {', '.join(sorted(bounds))} or one_task=True")
    try:
        if jdbc:
            return spark.read.format("jdbc").options(**jdbc).load()
        return spark.read.table(table) if table else spark.read.parquet(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return spark.createDataFrame([], JOBS)


def conform(df: DataFrame, schema: T.StructType = LISTING) -> DataFrame:
    """Canonical columns first and typed, extras kept, rows without a title dropped."""
    known = [
        (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema
    ]
    extras = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*known, *extras).where(F.coalesce("job_title", F.lit("")) != "")


def ordered_columns(df: DataFrame, schema: T.StructType = LISTING) -> DataFrame:
    first = [c for c in schema.fieldNames() if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def snapshot_export(df: DataFrame, path: str, stamp: str) -> dict[str, str]:
    """CSV and JSON copy of one run below ``run_ts=<stamp>``, both compressed.

    The rows are computed once, into a table that goes when both copies are there.
    """
    spark, rows = df.sparkSession, f"{path}/rows/run_ts={stamp}"
    ordered_columns(df).write.option("compression", "zstd").parquet(rows)
    out = spark.read.schema(ordered_columns(df).schema).parquet(rows)
    paths = {kind: f"{path}/{kind}/run_ts={stamp}" for kind in ("csv", "json")}
    write_csv(out, paths["csv"], compression="gzip")
    out.write.option("compression", "gzip").json(paths["json"])
    delete(spark, rows)
    return paths


def append_master(df: DataFrame, path: str, run: str | None = None) -> bool:
    """Append one run's rows; readers see all of them or none.

    A ``run`` that is stored already is left alone (False), so a job can be repeated after
    a failure; without a name every call is a run of its own.  Postings with an
    ``identity`` are stored by buckets of it.
    """
    key = "identity" if "identity" in df.columns else None
    return Published(df.sparkSession, path, key, label="run").add(df, run or uuid.uuid4().hex)


def read_master(spark: SparkSession, path: str, among: DataFrame | None = None) -> DataFrame | None:
    """Rows of all appended runs, or None; ``among`` opens only the buckets of its identities."""
    key = None if among is None else "identity"
    rows = Published(spark, path, key, label="run").read(among=among)
    return None if rows is None else rows.drop("run", BUCKET)


def export_features(cleaned: DataFrame, featurize: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Store the cleaned table, then the feature table computed from the stored copy.

    Cleaning shuffles, and features read their input several times, so they start
    from the written table.  Returns that table.
    """
    cleaned.write.mode("overwrite").parquet(f"{path}/cleaned")
    stored = cleaned.sparkSession.read.schema(cleaned.schema).parquet(f"{path}/cleaned")
    featurize(stored).write.mode("overwrite").parquet(f"{path}/features")
    return stored
