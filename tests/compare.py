"""Run registered queries next to their SQL text in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def compare(spark, con, fn, sql: str, folder: str):
    """None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    cols = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: spark only {set(cols) - set(names)}, sql only {set(names) - set(cols)}"
    at = [names.index(c) for c in cols]
    want = [tuple(canon(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}"
    for i, c in enumerate(cols):
        a = {type(r[i]).__name__ for r in got if r[i] is not None}
        b = {type(r[i]).__name__ for r in want if r[i] is not None}
        if a != b:
            return f"type of {c}: spark {a} sql {b}"
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
            head = [(c, x) for c, x, y in zip(cols, a, b) if x == y][:6]
            return f"values differ: {bad[:6]} at {head}"
    return None


def main(folder: str, prefixes: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from granary.session import build_session
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, fn in queries.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if key in sqls:
                diff = compare(spark, con, fn, sqls[key], folder)
            else:
                diff = None if fn(spark, folder).count() > 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {key} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
