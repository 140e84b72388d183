"""Run registered queries and compare them with their SQL twins in DuckDB.

usage: python tools/check_oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from trialweave.plans.registry import load_all  # noqa: E402
from trialweave.session import local_session  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def sort_key(row):
    return tuple((v is None, str(type(v).__name__), v if not isinstance(v, float) else round(v, 5)) if v is not None else (True, "", 0) for v in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: [str(x) for x in r])


def compare(spark_df, con, sql: str) -> str:
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    a_cols, a = rows_of(scols, srows)
    b_cols, b = rows_of(dcols, drows)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "EMPTY"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)}/{len(a)} rows differ, first {diff[0]}"
    types = [(c, type(x).__name__, type(y).__name__) for c, x, y in zip(a_cols, a[0], b[0]) if type(x) is not type(y) and x is not None and y is not None]
    return f"ok rows={len(a)}" + (f" TYPES {types}" if types else "")


def main() -> int:
    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    bad = 0
    for name, q in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf)
            if q.sql:
                msg = compare(df, con, q.sql)
            else:
                msg = f"ok rows-only rows={len(df.collect())}"
        except Exception as exc:  # report and go on with the next query
            msg = f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "" if msg.startswith("ok") and "TYPES" not in msg else "  <<<<"
        bad += bool(flag)
        print(f"{name:34s} {time.time() - start:6.2f}s {msg}{flag}", flush=True)
    print(f"not ok: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
