"""Run queries and their SQL counterparts side by side and compare rows.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return took, f"rows only ({len(ours[1])})", bool(ours[1])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return took, f"COLUMNS {ours[0]} {theirs[0]}", False
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return took, f"ROWS {len(ours[1])} {len(theirs[1])} ours={sorted(a - b)[:3]} theirs={sorted(b - a)[:3]}", False
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall() for d in [d]}
    return took, f"ok {len(ours[1])} rows; {dict(df.dtypes)} {types}" if "-t" in sys.argv else f"ok {len(ours[1])} rows", True


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    from bindings import ORACLES, QUERIES
    from gridsmith.session import local_session

    args = [a for a in sys.argv[1:] if a != "-t"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = []
    for name in names:
        try:
            took, text, ok = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            took, text, ok = 0.0, f"ERROR {str(error)[:600]}", False
        print(f"{'  ' if ok else '!!'} {name:28s} {took:6.2f}s {text}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
