"""Run registered queries and compare them with their SQL in DuckDB.

    python tests/check.py [folder] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime):
        return v.date().isoformat() if v.time().isoformat() == "00:00:00" else v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, (list, tuple)):
        return str(v)
    if hasattr(v, "is_finite"):
        return plain(float(v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def differences(key, spark, con, folder) -> list[str]:
    from fieldspark.plans import ORACLE, QUERIES
    df = QUERIES[key](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if key not in ORACLE:
        return [] if got else ["no rows"]
    cur = con.execute(ORACLE[key])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if not want:
        return ["oracle gives no rows"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}", str(got[:2]), str(want[:2])]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ in {sorted(names)}"] + [f"{g} != {w}" for g, w in bad[:2]] if bad else []


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    from fieldspark.plans import ORACLE, QUERIES
    keys = [k for k in QUERIES if not args or any(a == k or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]
    spark, con = session(), database(folder)
    failed = []
    for k in keys:
        start = time.time()
        try:
            diff = differences(k, spark, con, folder)
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:900]}"]
        note = "" if k in ORACLE else " (rows only)"
        print(f"{'FAIL' if diff else 'ok'} {k}{note} {time.time() - start:.1f}s", flush=True)
        for d in diff:
            print("    " + d[:1000], flush=True)
        failed += [k] if diff else []
    print(f"{len(keys) - len(failed)} of {len(keys)} ok; failed: {failed}")
