"""Run registered queries against their SQL in DuckDB and compare the contents."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """One spelling per value, whatever the engine's type."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def contents(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, job, sql: str | None):
    """(message or None, rows, seconds in Spark, seconds in DuckDB)"""
    t0 = time.time()
    df = job(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return (None if mine else "no rows"), len(mine), t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}", len(mine), t1 - t0, t2 - t1
    a, b = contents(df.columns, mine), contents(names, theirs)
    if a != b:
        diff = next(((x, y) for x, y in zip(a, b) if x != y), (a[len(b):][:1], b[len(a):][:1]))
        return f"{len(a)} rows against {len(b)}; {sorted(names)}\n  ours  {diff[0]}\n  check {diff[1]}", len(a), t1 - t0, t2 - t1
    return (None if a else "no rows"), len(a), t1 - t0, t2 - t1


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from paylattice.session import get_session

    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, jobs, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or jobs:
        try:
            message, rows, mine, theirs = compare(spark, con, sf_dir, jobs[name], sql.get(name))
        except Exception as e:  # report and go on
            message, rows, mine, theirs = f"{type(e).__name__}: {str(e)[:900]}", -1, 0.0, 0.0
        bad += message is not None
        mark = "ok  " if message is None else "FAIL"
        print(f"{mark} {name:28s} rows={rows:<7d} spark={mine:6.2f}s duckdb={theirs:5.2f}s {'' if name in sql else '(no sql)'} {message or ''}",
              flush=True)
    print(f"{bad} of {len(names or jobs)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
