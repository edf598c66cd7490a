"""Compare every registered query with its SQL: python -m tests.check_queries [folder] [names...]"""

import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from tidemark.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(columns, cur.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        problems.append(f"rows {len(got)} vs {len(want)}: {str(only)[:800]}")
    return len(got), problems


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    session, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, problems = compare(session, con, folder, name)
        except Exception as e:  # report and go on
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
        state = "rows only" if problems is None else "ok" if not problems else "DIFFERS"
        bad += state == "DIFFERS"
        print(f"{name:40} {state:9} {n:7} {time.time() - start:6.1f}s", *(problems or []), sep="  ", flush=True)
    print("differing:", bad)
