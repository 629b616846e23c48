"""Compare a Spark query with its DuckDB oracle, the way the driver does (row count, column names,
order-insensitive values). Usage: python tests/oracle_check.py [key ...] [--sf 0.01]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from chorus.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


EXACT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple((k, _norm(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def _rows_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def _rows_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(row[i]) for i in idx) for row in data]


def compare(spark, key, sf_dir, queries, sqls, verbose=True):
    t0 = time.time()
    sdf = queries[key](spark, sf_dir)
    scols, srows = _rows_spark(sdf)
    t1 = time.time()
    if key not in sqls:
        return {"key": key, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    con = duck(sf_dir)
    dcols, drows = _rows_duck(con, sqls[key])
    ok_cols = scols == dcols
    key_fn = lambda r: tuple((x is None, str(x)) for x in r)
    srows.sort(key=key_fn)
    drows.sort(key=key_fn)
    ok_rows = len(srows) == len(drows)
    ok_vals = ok_rows and srows == drows
    res = {"key": key, "ok": ok_cols and ok_vals, "cols": ok_cols, "rows": (len(srows), len(drows)),
           "spark_s": round(t1 - t0, 2)}
    if verbose and not res["ok"]:
        if not ok_cols:
            print("  spark cols", scols, "\n  duck cols ", dcols)
        else:
            n = 0
            for a, b in zip(srows, drows):
                if a != b:
                    print("  spark", a[:8], "\n  duck ", b[:8])
                    n += 1
                    if n > 3:
                        break
    return res


if __name__ == "__main__":
    import argparse

    from chorus.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--exact", action="store_true", help="compare floats bit for bit")
    a = ap.parse_args()
    EXACT = a.exact
    import __spark_entry__ as E

    spark = local_session(8, 8)
    qs, sq = E.queries(), E.oracle_sql()
    keys = a.keys or list(qs)
    bad = []
    for k in keys:
        try:
            r = compare(spark, k, f"/root/testdata/sf{a.sf}", qs, sq)
        except Exception as ex:  # report and continue
            r = {"key": k, "ok": False, "error": str(ex)[:400]}
        print(r, flush=True)
        if r.get("ok") is False:
            bad.append(k)
    print("FAILED:", bad)
