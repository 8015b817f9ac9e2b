"""Quoted CSV read by several tasks a file, against Python's csv module."""

import csv
import io as text_io
import random

import pytest

from paylattice.sources import io, quoted_csv

SCHEMA = "id long, title string, body string"


def fields(rng: random.Random) -> str:
    parts = ["plain", 'say "hi"', "a,b", "one\ntwo", "\n\n", '"', '""', 'ends with "', "", "x" * rng.randrange(40), "line\r\nbreak", "é中\n,"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(4)))


def written(rows: list, end: str = "\n") -> str:
    out = text_io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "title", "body"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.fixture()
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "300b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_with_breaks_come_back_whole_from_many_tasks(spark, tmp_path, small_ranges, end):
    rng = random.Random(4)
    rows = [[i, fields(rng), fields(rng)] for i in range(400)]
    rows[100][2] = "long\n" * 500  # spans many byte ranges
    rows[101][1] = '"\n' * 300
    for part in range(2):
        (tmp_path / f"part-{part}.csv").write_bytes(written(rows[part::2], end).encode())
    schema = spark.createDataFrame([], SCHEMA).schema
    assert quoted_csv.physical_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = io.scan_csv(spark, str(tmp_path), schema).collect()
    assert sorted((r.id, r.title or "", r.body or "") for r in got) == [tuple(r) for r in rows]
    counted = io.count_bad_rows(spark, str(tmp_path), schema).first()
    assert (counted.rows, counted.bad_rows) == (400, 0)


def test_what_spark_writes_comes_back(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, fields(rng) or None, fields(rng) or None) for i in range(200)], SCHEMA)
    io.write_csv(df.repartition(3), str(tmp_path / "t"))
    back = io.scan_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_two_lines_in_a_field_do_not_become_two_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb,c"), (2, "plain")], "id long, body string")
    io.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, io.scan_csv(spark, str(tmp_path / "t"), df.schema).collect())) == [(1, "a\nb,c"), (2, "plain")]


def test_quotes_inside_plain_fields_are_text(spark, tmp_path, small_ranges):
    lines = ["id,title,body"] + [f'{i},5" pipe,"in {i}\n""out"""' if i % 3 else f'{i},a"b"c,x"' for i in range(100)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = io.scan_csv(spark, str(tmp_path / "a.csv"), spark.createDataFrame([], SCHEMA).schema)
    want = [(i, '5" pipe', f'in {i}\n"out"') if i % 3 else (i, 'a"b"c', 'x"') for i in range(100)]
    assert sorted(map(tuple, got.collect())) == want


def test_bad_records_headers_and_empty_files(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    (tmp_path / "bad.csv").write_text('id,title,body\n1,a,"b\nc"\nnot a number,x,y\n\n3,only two\n4,a,b,too many\n5,ok,"never closed\n6,a,b\n')
    counted = io.count_bad_rows(spark, str(tmp_path / "bad.csv"), schema).first()
    assert (counted.rows, counted.bad_rows) == (5, 3)
    bad = io.scan_csv(spark, str(tmp_path / "bad.csv"), schema, bad_rows=True).where("_bad_row is not null")
    assert sorted(r._bad_row for r in bad.collect()) == ["3,only two", "4,a,b,too many", "not a number,x,y"]
    (tmp_path / "head.csv").write_text("﻿id,title,body\r\n")
    assert io.scan_csv(spark, str(tmp_path / "head.csv"), schema).count() == 0
    (tmp_path / "none.csv").write_text("")
    assert io.scan_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0
    (tmp_path / "other.csv").write_text("id,name,body\n1,a,b\n")
    with pytest.raises(Exception, match="header"):
        io.scan_csv(spark, str(tmp_path / "other.csv"), schema).collect()


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", 0, 1), ('a,"b', 1, 0), ('"a","b"', 0, 0), ('x",y', 0, 0), ('x","y', 1, 1), ('""', 0, 1), ('"', 1, 0), ('a"b,c', 0, 0),
    ('"a""', 1, 0), (',"', 1, 0), ('"a" b,"c', 1, 0)])
def test_states(line, outside, inside):
    assert (quoted_csv.ends(line, 0), quoted_csv.ends(line, 1)) == (outside, inside)
