"""Tables whose folders become visible all at once.

Rows are written to a folder that no reader looks at yet; then one small file that names all
valid folders is put in place by a rename.  Readers take the newest such list.  A job that
dies before the rename has changed nothing, one that dies after it has finished; leftover
folders are removed by the next ``replace``.  Two writers cannot both put the same list in place.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = "_published"
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer has published in between."""


class Pointer:
    """The newest list of valid folders below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.root.getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def entries(self, *parts: str) -> list[str]:
        """Names below a folder; none if it is absent."""
        folder = self._path(*parts)
        return [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []

    def number(self) -> int:
        """How many lists were published."""
        return max((int(n) for n in self.entries(LISTS) if n.isdigit()), default=0)

    def read(self, number: int | None = None) -> list[str]:
        number = self.number() if number is None else number
        if not number:
            return []
        opened = self.files.open(self._path(LISTS, str(number)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def swap(self, folders: list[str], after: int) -> None:
        """Publish a list in place of number ``after``; a Conflict if another one came first."""
        draft, final = self._path(LISTS, f"_draft-{uuid.uuid4().hex}"), self._path(LISTS, str(after + 1))
        out = self.files.create(draft, False)
        out.write(json.dumps(folders).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        rename = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, rename)  # refuses to replace a list
        except Py4JJavaError as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName() or self.files.exists(final):
                raise Conflict(f"list {after + 1} of {self.path} exists") from error
            raise

    def remove_unlisted(self, prefix: str) -> None:
        """Delete folders with this prefix that neither the newest list nor the one before it names."""
        number = self.number()
        valid = {*self.read(number), *self.read(max(number - 1, 0))}
        for name in self.entries():
            if name.startswith(prefix) and name not in valid:
                self.files.delete(self._path(name), True)


def bucket_of(key: str, rows: DataFrame, buckets: int) -> Column:
    """Bucket of a row by its key; rows without one are spread, as they never meet any other."""
    spread = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    return F.pmod(F.when(F.col(key).isNull(), spread).otherwise(F.xxhash64(key)), F.lit(buckets)).cast("int")


class Published:
    """A table of named folders ``<label>=<name>``, each split into buckets of the key if there is one.

    A name is stored once: adding it again changes nothing, so a repeated batch does no
    harm.  ``read(among=...)`` opens only the buckets that hold keys of another table.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = "identity", buckets: int = 256, label: str = "batch"):
        self.spark, self.path, self.key, self.buckets, self.label = spark, path, key, buckets, label
        self.pointer = Pointer(spark, path)

    def names(self) -> list[str]:
        return [f.removeprefix(f"{self.label}=") for f in self.pointer.read()]

    def _write(self, rows: DataFrame, folder: str) -> None:
        path = f"{self.path}/{folder}"
        if self.key is None:
            rows.write.mode("overwrite").parquet(path)
            return
        # every bucket comes from as many tasks as its size asks for; keys stand in order, so that files can skip row groups
        placed = rows.withColumn(BUCKET, bucket_of(self.key, rows, self.buckets)).hint("rebalance", BUCKET)
        placed.sortWithinPartitions(BUCKET, self.key).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def add(self, rows: DataFrame, name: str) -> bool:
        """Store rows under a name; False if that name is stored already."""
        folder = f"{self.label}={name}"
        if folder in self.pointer.read():
            return False
        self._write(rows, folder)
        while True:
            number = self.pointer.number()
            try:
                self.pointer.swap([*self.pointer.read(number), folder], number)
                return True
            except Conflict:
                continue  # another name was added meanwhile

    def add_next(self, rows: DataFrame, name: str) -> bool:
        """Store rows under a name that must be new; False if another writer was first with any name."""
        number = self.pointer.number()
        folders, folder = self.pointer.read(number), f"{self.label}={name}"
        if any(f.partition(".")[0] == folder for f in folders):
            return False
        own = f"{folder}.{uuid.uuid4().hex}"  # another writer may be writing the same name
        self._write(rows, own)
        try:
            self.pointer.swap([*folders, own], number)
            return True
        except Conflict:
            return False

    def replace(self, rows: DataFrame, name: str) -> None:
        """Make these rows the whole table, under a new name; a Conflict if the table has changed since it was read."""
        number = self.pointer.number()
        folder = f"{self.label}={name}"
        if folder in self.pointer.read(number):
            raise ValueError(f"{folder} is a part of the table")
        self._write(rows, folder)
        self.pointer.swap([folder], number)

    def read(self, schema=None, among: DataFrame | None = None, names: list[str] | None = None) -> DataFrame | None:
        """All published rows, or None; ``among`` (a table with the key column) opens its buckets only.

        The numbers of buckets that ``among`` meets are collected, 256 at most.
        """
        folders = [f"{self.path}/{self.label}={n}" for n in (self.names() if names is None else names)]
        if not folders:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.option("basePath", self.path).parquet(*folders)
        if among is None or self.key is None:
            return rows
        met = among.where(F.col(self.key).isNotNull()).select(bucket_of(self.key, among.select(self.key), self.buckets).alias("b")).distinct()
        return rows.where(F.col(BUCKET).isin([r.b for r in met.collect()]))
