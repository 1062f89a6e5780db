"""Run registered queries in Spark and their oracles in DuckDB; compare results.

    python -m marktext.plans.verify [--sf DIR] [--only a,b] [--master local[8]]

Comparison: row count, column names, and the multiset of rows (floats to 9 places).
"""

from __future__ import annotations

import argparse
import json
import math
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


def duckdb_conn(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names=None) -> dict:
    from .oracle import ORACLE
    from .queries import QUERIES
    con = duckdb_conn(sf_dir)
    report = {}
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        entry = {}
        t0 = time.time()
        try:
            sdf = q(spark, sf_dir)
            srows = [r.asDict(recursive=True) for r in sdf.collect()]
            scols = sorted(sdf.columns)
            entry["spark_sec"] = round(time.time() - t0, 2)
            entry["rows"] = len(srows)
        except Exception as exc:  # noqa: BLE001
            entry["error"] = f"spark: {type(exc).__name__}: {str(exc)[:400]}"
            report[name] = entry
            print(name, entry, flush=True)
            continue
        sql = ORACLE.get(name)
        if sql is None:
            entry["oracle"] = "rows-only"
        else:
            try:
                t1 = time.time()
                res = con.execute(sql)
                ocols_raw = [d[0] for d in res.description]
                orecs = [dict(zip(ocols_raw, row)) for row in res.fetchall()]
                entry["duck_sec"] = round(time.time() - t1, 2)
                ocols = sorted(ocols_raw)
                entry["cols_match"] = scols == ocols
                entry["rows_match"] = len(orecs) == len(srows)
                if scols == ocols:
                    a, b = _rows(srows, scols), _rows(orecs, ocols)
                    entry["values_match"] = a == b
                    if a != b:
                        diff = [x for x in a if x not in set(b)][:3]
                        entry["sample_spark_only"] = repr(diff)[:600]
                        entry["sample_duck_only"] = repr([x for x in b if x not in set(a)][:3])[:600]
                else:
                    entry["spark_cols"], entry["duck_cols"] = scols, ocols
            except Exception as exc:  # noqa: BLE001
                entry["error"] = f"duckdb: {type(exc).__name__}: {str(exc)[:400]}"
        report[name] = entry
        print(name, json.dumps(entry, ensure_ascii=False, default=str), flush=True)
    return report


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--master", default="local[8]")
    args = ap.parse_args(argv)
    from ..session import get_spark
    spark = get_spark(args.master, 8)
    names = set(filter(None, args.only.split(",")))
    rep = compare(spark, args.sf, names or None)
    bad = [k for k, v in rep.items() if "error" in v or v.get("values_match") is False
           or v.get("cols_match") is False]
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
