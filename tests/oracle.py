"""Run named queries against their SQL in DuckDB: ``python tests/oracle.py [-d sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def canonical(rows: list[tuple], columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(f"{k}:{cell(x)}" for k, x in v.items()) + "}"
        if hasattr(v, "asDict"):
            return cell(v.asDict())
        return str(v)

    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def check(spark, con, q, sf_dir: str) -> tuple[str, float, float]:
    t0 = time.time()
    df = q.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if not q.sql:
        return f"rows={len(rows)}", t1 - t0, 0.0
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}", t1 - t0, t2 - t1
    spark_types = dict(df.dtypes)
    odd = [
        (d[0], str(d[1]), spark_types[d[0]]) for d in cur.description
        if "DECIMAL" in str(d[1]) or "HUGEINT" in str(d[1]) or spark_types[d[0]].startswith("decimal")
    ]
    a, b = canonical(rows, df.columns), canonical(want, names)
    if a == b:
        return (f"ok rows={len(a)}" if a else "EMPTY") + (f" TYPES {odd}" if odd else ""), t1 - t0, t2 - t1
    sa, sb = set(a), set(b)
    return (f"DIFF rows {len(a)} vs {len(b)}; cols {sorted(names)}\n   spark {list(sa - sb)[:2]}\n   sql   {list(sb - sa)[:2]}",
            t1 - t0, t2 - t1)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if "-d" in args:
        i = args.index("-d")
        sf_dir = args[i + 1]
        del args[i:i + 2]
    from maskwright.catalog import load
    from maskwright.session import local_session

    reg = load()
    names = [n for n in reg if not args or any(n == a or n.startswith(a) for a in args)]
    spark, con, bad = local_session(), connect(sf_dir), 0
    for n in names:
        try:
            msg, ts, td = check(spark, con, reg[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, ts, td = "ERROR " + "".join(traceback.format_exception_only(e))[:1500], 0, 0
        if not (msg.startswith("ok") or msg.startswith("rows=")):
            bad += 1
        print(f"{n:38s} spark {ts:6.2f}s sql {td:5.2f}s  {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    pd.set_option("display.width", 200)
    sys.exit(1 if main() else 0)
