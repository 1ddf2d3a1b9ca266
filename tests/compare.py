"""Run queries against their SQL: python tests/compare.py [sf dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        if f == 0 and math.copysign(1, f) < 0:
            return "-0"
        return repr(round(f, 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    a, acols = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    b, bcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if acols != bcols:
        return f"columns {acols} != {bcols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, cols {acols}: {bad[:3]}"
    return None if a else "no rows"


def main():
    from tests.conftest import session
    import __spark_entry__ as E
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark, con = session(), connect(sf)
    queries, sqls = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                err = compare(spark, con, sf, fn, sqls[name])
            else:
                err = None if fn(spark, sf).count() else "no rows"
        except Exception as e:  # report and go on
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += err is not None
        print(f"\n{'FAIL' if err else 'ok  '} {name} {time.time() - t0:.2f}s {err or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
