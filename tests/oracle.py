"""Run bound queries beside their SQL twins and compare all rows.

    python -m tests.oracle [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from tallyscope import bindings, session
from tallyscope.bindings.base import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def kind(v) -> str:
    if isinstance(v, bool):
        return "b"
    if isinstance(v, int):
        return "i"
    if isinstance(v, float):
        return "f"
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(r[i] for i in order))
    return [names[i] for i in order], out


def key(row):
    return tuple((v is None, kind(v), f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and kind(a) == kind(b)


def compare(df, con, sql):
    """(problem text or '', number of rows)."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    gn, got = rows_of(df.columns, got)
    wn, want = rows_of(names, want)
    if gn != wn:
        return f"columns {gn} != {wn}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {sorted(got, key=key)[:2]} / {sorted(want, key=key)[:2]}", len(got)
    loose = 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if a != b:
            if len(a) == len(b) and all(close(x, y) for x, y in zip(a, b)):
                loose += 1
                continue
            return f"row {a} != {b}", len(got)
        if [kind(x) for x in a] != [kind(x) for x in b]:
            return f"types {a} != {b}", len(got)
    return (f"LOOSE {loose}" if loose else ""), len(got)


def main(argv):
    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = session.build(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    tables = bindings.Tables(spark, folder)
    bad = 0
    for name, q in bindings.load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = q.run(tables)
            if q.oracle:
                problem, n = compare(df, con, q.oracle)
            else:
                problem, n = "", len(df.collect())
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
            if "-v" in prefixes:
                traceback.print_exc()
        bad += bool(problem)
        flag = "ok " if not problem else "BAD"
        print(f"{flag} {name:38s} rows={n:<8d} {time.time() - t0:6.2f}s {'' if q.oracle else '[no sql]'} {problem}", flush=True)
    print("problems:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
