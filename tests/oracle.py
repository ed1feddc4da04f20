"""Compare registered queries with their DuckDB SQL: ``python tests/oracle.py [names or prefixes] [--sf 0.01]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{d}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, d, fn, sql):
    df = fn(spark, d)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, sum(got.values()), got, Counter(), df.dtypes, []
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    kinds = [(c[0], str(c[1])) for c in rel.description]
    want = bag(cols, rel.fetchall())
    return got == want and sorted(df.columns) == sorted(cols), sum(got.values()), got, want, df.dtypes, kinds


FITS = {"bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}}


def main(argv):
    from tickloom.plans.registry import load
    from tickloom.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    d = f"/root/testdata/sf{sf}"
    spark, con = local_session(cores="8"), connect(d)
    bad = []
    for name, (fn, sql) in load().items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) or fn.__module__.endswith(a) for a in argv):
            continue
        t0 = time.time()
        try:
            ok, n, got, want, dt, kinds = compare(spark, con, d, fn, sql)
        except Exception as e:  # report and go on with the next query
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        odd = [(c, t, dict(kinds).get(c)) for c, t in dt if sql and {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, "?") != dict(kinds).get(c)]
        print(f"{'ok  ' if ok else ('rows' if ok is None else 'BAD ')} {name} rows={n} {time.time()-t0:.1f}s {'types ' + str(odd) if odd else ''}", flush=True)
        if ok is False:
            bad.append(name)
            print("   columns", sorted(c for c, _ in dt), sorted(c for c, _ in kinds))
            print("   spark only", list((got - want).items())[:3])
            print("   duck only ", list((want - got).items())[:3], sum((got - want).values()), sum((want - got).values()))
    print("FAILED", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
