"""Quoted CSV with line breaks inside fields, read by many tasks a file.

A task that starts in the middle of a file cannot know whether its first line begins a
record or stands inside a quoted field.  Pass one therefore runs both cases over every
byte range and notes how each of them ends.  Running over the ranges of a file, these
notes say for each range where it begins.  Pass two cuts the lines into records; a
record that crosses ranges comes in pieces, and only those pieces are shuffled.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line begins a record, or goes on inside a quoted field.
OUTSIDE, INSIDE = 0, 1
_IN_QUOTES = r'(?:[^"]++|"")*+'
#: From the start of a field: whole fields, then one that opens a quote and does not close it.
_LEFT_OPEN = re.compile(rf'(?:(?:"{_IN_QUOTES}"[^,]*+|[^",][^,]*+|),)*+"{_IN_QUOTES}', re.DOTALL)
_REST_OF_FIELD = re.compile(_IN_QUOTES, re.DOTALL)
PIECE = "file long, first long, place long, header boolean, text string"


def ends(line: str, state: int) -> int:
    """State after a line that was begun in ``state``.

    A quote opens a field only as its first character; elsewhere it is text.
    """
    if state == INSIDE:
        closing = _REST_OF_FIELD.match(line).end()
        if closing == len(line):
            return INSIDE
        comma = line.find(",", closing)
        if comma < 0:
            return OUTSIDE
        line = line[comma + 1 :]
    return INSIDE if '"' in line and _LEFT_OPEN.fullmatch(line) else OUTSIDE


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, at, value): lines of all files, in order inside each byte range ``at`` of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Parts of a batch that lie in one byte range."""
    file, at = batch["file"].to_numpy(), batch["at"].to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (at[1:] != at[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)], strict=True):
        if a < b:
            yield (int(file[a]), int(at[a])), batch.slice(a, b - a)


def range_notes(lines: DataFrame) -> DataFrame:
    """(file, at, from_outside, from_inside, begins_outside, begins_inside) of every byte range.

    For either state at its start: the state at its end, and whether a record begins in it.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, begins = None, [OUTSIDE, INSIDE], [False, False]

        def note() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "at": key[1], "from_outside": states[0], "from_inside": states[1],
                                                "begins_outside": begins[0], "begins_inside": begins[1]}], schema=schema)

        schema = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("from_outside", pa.int32()), ("from_inside", pa.int32()),
                            ("begins_outside", pa.bool_()), ("begins_inside", pa.bool_())])
        for batch in batches:
            for place, part in _runs(batch):
                if place != key:
                    if key is not None:
                        yield note()
                    key, states, begins = place, [OUTSIDE, INSIDE], [False, False]
                quoted = pc.match_substring(part["value"], '"').to_numpy(zero_copy_only=False)
                done = 0
                for i in np.flatnonzero(quoted).tolist():  # other lines leave both states as they are
                    begins = [b or s == OUTSIDE for b, s in zip(begins, states, strict=True)] if i >= done else begins
                    line = part["value"][i].as_py()
                    states = [ends(line, s) for s in states]
                    done = i + 1
                if done < part.num_rows:
                    begins = [b or s == OUTSIDE for b, s in zip(begins, states, strict=True)]
        if key is not None:
            yield note()

    return lines.mapInArrow(job, "file long, at long, from_outside int, from_inside int, begins_outside boolean, begins_inside boolean")


def range_starts(notes: DataFrame) -> DataFrame:
    """(file, at, inside, owner): the state each byte range starts in, and the range in which a record open there began.

    A range keeps, flips or fixes the state.  The state is that of the last range that
    fixes it, flipped by those since.  Windows run over the ranges of a file, not over rows.
    """
    in_file = Window.partitionBy("file").orderBy("at")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    flips = (F.col("from_outside") == INSIDE) & (F.col("from_inside") == OUTSIDE)
    fixed = F.col("from_outside") == F.col("from_inside")
    counted = notes.withColumn("flips", F.sum(F.when(flips, 1).otherwise(0)).over(in_file))
    last = F.last(F.when(fixed, F.struct("from_outside", "flips")), ignorenulls=True).over(before)
    counted = counted.withColumn("last", last).withColumn("flipped", F.coalesce(F.lag("flips").over(in_file), F.lit(0)))
    since = F.pmod(F.col("flipped") - F.coalesce("last.flips", F.lit(0)), F.lit(2))
    state = F.coalesce("last.from_outside", F.lit(OUTSIDE)).bitwiseXOR(since)
    placed = counted.withColumn("inside", state == INSIDE)
    begins = F.when(F.col("inside"), F.col("begins_inside")).otherwise(F.col("begins_outside"))
    owner = F.last(F.when(begins, F.col("at")), ignorenulls=True).over(before)
    return placed.select("file", "at", "inside", F.when(F.col("inside"), owner).alias("owner"))


def records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One column ``text``: every record of the CSV files below ``path``, without headers.

    Records end with a line feed, or carriage return and line feed, outside quotes; blank
    lines between them are skipped.  Each file has a header with these names.  A quote
    that is never closed makes the rest of its file one record.
    """
    lines = physical_lines(spark, path)
    starts = {(r.file, r.at): (r.inside, r.owner) for r in range_starts(range_notes(lines)).collect()}  # a row for each 128 MB of input
    shared = spark.sparkContext.broadcast(starts)
    wanted = [n.lower() for n in names]

    def check_header(text: str) -> None:
        found = [n.strip().lower() for n in next(csv.reader([text.lstrip("﻿").rstrip("\r")], strict=False), [])]
        if found != wanted:
            raise ValueError(f"the header {found} is not {wanted}")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first, open_lines, is_header = None, OUTSIDE, None, [], False
        out: list[tuple] = []

        def emit(whole: bool) -> None:
            """A record, or a piece of one that crosses byte ranges."""
            text = "\n".join(open_lines)
            if whole and is_header:
                check_header(text)
            elif not whole or text.strip("\r \t"):
                out.append((key[0], None if whole else first, None if whole else key[1], is_header, text if not whole else text.removesuffix("\r")))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "first", "place", "header", "text"])
            out.clear()
            return batch

        crosses = False
        for batch in batches:
            for place, part in _runs(batch):
                if place != key:
                    if open_lines:
                        emit(whole=False)
                    if place not in shared.value:
                        raise RuntimeError("byte ranges changed between two passes over a file; read it again")
                    key, open_lines = place, []
                    crosses, owner = shared.value[place]
                    state = INSIDE if crosses else OUTSIDE
                    first, is_header = (owner, owner == 0 and not crosses) if crosses else (place[1], place[1] == 0)
                quoted = pc.match_substring(part["value"], '"').to_numpy(zero_copy_only=False)
                for line, has_quote in zip(part["value"].to_pylist(), quoted.tolist(), strict=True):
                    open_lines.append(line)
                    state = ends(line, state) if has_quote else state
                    if state == OUTSIDE:
                        emit(whole=not crosses)
                        open_lines, crosses, first, is_header = [], False, place[1], False
                if len(out) > 20_000:
                    yield flush()
        if open_lines:
            emit(whole=False)
        yield flush()

    pieces = lines.mapInArrow(job, PIECE)
    whole = pieces.where("first is null").select("text")
    parts = F.array_sort(F.collect_list(F.struct("place", "header", "text")))
    joined = pieces.where("first is not null").groupBy("file", "first").agg(parts.alias("p"))
    joined = joined.select(F.exists("p", lambda x: x["header"]).alias("header"),
                           F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    ok = F.when(F.col("header"), F.raise_error(F.lit("the header of a file is longer than one byte range"))).otherwise(F.lit(True))
    crossed = joined.where(ok).select(F.regexp_replace("text", "\r$", "").alias("text"))
    return whole.unionByName(crossed)


def parse(texts: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Columns of records in the column ``text``, parsed on the JVM."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return texts.select(F.from_csv("text", ddl, options).alias("r")).select("r.*")
