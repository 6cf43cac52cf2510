"""Run registered queries against their SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, float):
            if math.isnan(v):
                return None
            return v + 0.0 if v != 0 else 0.0
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
            return cell(v) if isinstance(v, float) else v if not isinstance(v, list) else tuple(v)
        return v

    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v).__name__ if v is not None else ""), v if v is not None else 0) for v in r))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.toPandas()
    sec = time.time() - t
    out = {"name": name, "sec": round(sec, 2), "rows": len(got), "ok": True, "why": ""}
    if sql is None:
        return out
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return {**out, "ok": False, "why": f"columns {sorted(got.columns)} vs {sorted(want.columns)}"}
    if len(got) != len(want):
        return {**out, "ok": False, "why": f"rows {len(got)} vs {len(want)}"}
    a, b = _norm(got), _norm(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return {**out, "ok": False, "why": f"{len(bad)} rows differ, e.g. {bad[0]} {sorted(got.columns)}"}
    ka, kb = kinds(got), kinds(want)
    # Values with missing ones among them come as floats or objects from one side and in nullable types from the other.
    nullable = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "boolean": "boolean"}
    ka |= {c: nullable[t] for c, t in df.dtypes if t in nullable and kb[c] in nullable.values()}
    diff = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    if diff:
        return {**out, "ok": False, "why": f"dtypes {diff}"}
    if not len(got):
        out["why"] += " EMPTY"
    return out


if __name__ == "__main__":
    from firnline.catalog import oracle_sql, queries
    from firnline.session import local_session

    sf = sys.argv[1]
    pick = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, orc = queries(), oracle_sql()
    fails = 0
    for n, fn in qs.items():
        if pick and not any(n.startswith(p) for p in pick):
            continue
        try:
            r = compare(spark, con, n, fn, orc.get(n), sf)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "sec": -1, "rows": -1, "ok": False, "why": f"{type(e).__name__}: {str(e)[:600]}"}
        fails += not r["ok"]
        print("ok  " if r["ok"] else "FAIL", n, r["sec"], r["rows"], "R" if n not in orc else "", r["why"], flush=True)
    print("failures", fails)
