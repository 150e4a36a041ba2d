"""Run registered queries next to their SQL and compare all rows and column types."""

from __future__ import annotations

import datetime
import glob
import math
import os
import time

import duckdb

FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "hugeint": "int",
    "integer": "int", "double": "float", "float": "float", "string": "text", "varchar": "text",
    "boolean": "bool", "date": "date",
}


def cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, value)
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}" if math.isfinite(value) else str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return (3, str(value)[:10])
    return (4, str(value))


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, name, function, sql):
    """None when both agree, else what differs; and both times. A query without SQL fails."""
    start = time.time()
    frame = function(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    spark_sec = time.time() - start
    if sql is None:
        return "no SQL to compare with", spark_sec, 0.0, len(got)
    start = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    duck_sec = time.time() - start
    types = {r[0]: r[1].lower() for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    problem = None
    if sorted(names) != sorted(frame.columns):
        problem = f"columns {sorted(frame.columns)} against {sorted(names)}"
    else:
        for column, kind in frame.dtypes:
            if FAMILY.get(kind, kind) != FAMILY.get(types[column], types[column]):
                problem = f"type of {column}: {kind} against {types[column]}"
        left, right = table(got, frame.columns), table(want, names)
        if left != right:
            only_left = [r for r in left if r not in set(right)][:3]
            only_right = [r for r in right if r not in set(left)][:3]
            problem = f"{len(left)} against {len(right)} rows; only Spark {only_left}; only SQL {only_right}"
    return problem, spark_sec, duck_sec, len(got)


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from payscope.session import local_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session(), connect(where), []
    for query in wanted:
        try:
            problem, a, b, n = compare(
                spark, con, where, query, entry.queries()[query], entry.oracle_sql().get(query)
            )
        except Exception as error:  # report and go on with the next query
            problem, a, b, n = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        print(f"{'FAIL' if problem else 'ok':5}{query:28}{n:8} rows {a:7.2f}s spark {b:6.2f}s sql  {problem or ''}", flush=True)
        bad += [query] if problem else []
    print(len(wanted), "queries,", len(bad), "bad:", bad)
