"""Local stand-in for the driver's correctness gate: run a registered
Spark query and its DuckDB oracle on the same parquet and compare
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys

import duckdb

sys.path.insert(0, "/root/repo")

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, key: str, sf_dir: str, con=None, verbose=True):
    sys.path.insert(0, "/root/repo")
    from kirana.plans.catalog import all_queries
    q = all_queries()[key]
    sdf = q.build(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    if not q.sql:
        return {"key": key, "rows": len(srows), "oracle": None}
    con = con or duck(sf_dir)
    res = con.execute(q.sql)
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    sh, sl = digest(scols, srows)
    dh, dl = digest(dcols, drows)
    out = {"key": key, "rows": len(srows), "oracle_rows": len(drows),
           "cols_match": sorted(scols) == sorted(dcols), "hash_match": sh == dh}
    if verbose and not (out["cols_match"] and out["hash_match"] and len(srows) == len(drows)):
        out["spark_cols"] = sorted(scols)
        out["oracle_cols"] = sorted(dcols)
        a, b = set(sl), set(dl)
        out["only_spark"] = sorted(a - b)[:3]
        out["only_oracle"] = sorted(b - a)[:3]
    return out


if __name__ == "__main__":
    import json
    import time
    from kirana.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    from kirana.plans.catalog import all_queries
    con = duck(sf)
    keys = keys or list(all_queries())
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "error": repr(e)[:600]}
        r["sec"] = round(time.time() - t0, 2)
        if "error" in r:
            ok = False
        elif "oracle" in r:
            ok = True
        else:
            ok = bool(r.get("cols_match") and r.get("hash_match") and r.get("rows") == r.get("oracle_rows"))
        bad += not ok
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
