"""Spark-vs-DuckDB comparison in the driver's spirit: row count, column names, value hash."""
from __future__ import annotations

import hashlib
import math
import os
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, name, fn, sql, sf_dir, con):
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    hs, ls = digest(s_cols, s_rows)
    hd, ld = digest(d_cols, d_rows)
    detail = ""
    if not (ok_cols and hs == hd):
        if not ok_cols:
            detail = f"cols spark={sorted(s_cols)} duck={sorted(d_cols)}"
        else:
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            detail = f"spark-only={diff_s} duck-only={diff_d}"
    return {"name": name, "rows": (len(s_rows), len(d_rows)), "cols_ok": ok_cols,
            "hash_ok": hs == hd, "detail": detail}


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from riskweave.session import get_session
    import __spark_entry__ as E
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = set(sys.argv[1:])
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    else:
        spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in oracle:
            try:
                n = fn(spark, sf_dir).count()
                print(f"ROWS  {name}: {n} rows (no oracle)")
            except Exception as exc:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:300]}")
            continue
        try:
            r = compare(spark, name, fn, oracle[name], sf_dir, con)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:400]}")
            continue
        status = "OK   " if r["cols_ok"] and r["hash_ok"] and r["rows"][0] == r["rows"][1] else "FAIL "
        bad += status != "OK   "
        print(f"{status} {name}: rows={r['rows']} {r['detail']}")
    print(f"done, {bad} not ok")
