"""Run registered queries beside their checking SQL: python -m tests.compare [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    try:
        f = float(v)
        return int(f) if f == int(f) else float(f"{f:.9g}")
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def compare(spark, con, folder, name, fn, sql):
    began = time.time()
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return ("rows-only", len(got), took, "")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return ("COLUMNS", len(got), took, f"{sorted(df.columns)} != {sorted(names)}")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return ("MISMATCH", len(got), took, f"spark={len(got)} sql={len(want)} only-spark={sorted(a - b)[:3]} only-sql={sorted(b - a)[:3]}")
    return ("ok" if got else "ok-empty", len(got), took, "")


def main():
    import __spark_entry__ as entry
    from strandwork.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = entry.oracle_sql(), 0
    picked = sys.argv[2:]
    for name, fn in entry.queries().items():
        if picked and not any(name == p or name.startswith(p) for p in picked):
            continue
        try:
            status, n, took, note = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            status, n, took, note = "ERROR", 0, 0.0, str(e)[:600]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {name:44s} rows={n:<8d} {took:6.1f}s {note}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
