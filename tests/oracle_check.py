"""Run registered queries in Spark and their oracle SQL in DuckDB and compare (like the driver does).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str, list[str]]:
    cols = sorted(df.columns)
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return len(df), cols, hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from staffwise.session import get_spark
    spark = get_spark("local[8]")
    qs, ora = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ora:
            print(f"{name}: rows={len(sdf)} (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.execute(ora[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name}: DUCKDB ERROR {str(e)[:600]}")
            bad += 1
            continue
        a, b = digest(sdf), digest(odf)
        ok = a[0] == b[0] and a[1] == b[1] and a[2] == b[2]
        print(f"{name}: {'OK' if ok else 'MISMATCH'} rows {a[0]}/{b[0]} {ts:.1f}s")
        if not ok:
            bad += 1
            if a[1] != b[1]:
                print("  cols spark:", a[1], "\n  cols duck: ", b[1])
            else:
                sa, sb = set(a[3]), set(b[3])
                for r in sorted(sa - sb)[:3]:
                    print("  spark only:", r[:400])
                for r in sorted(sb - sa)[:3]:
                    print("  duck only: ", r[:400])
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
