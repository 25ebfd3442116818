"""Compare registered queries with their SQL in DuckDB. CLI: python tests/oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.sources.views import RAW  # noqa: E402


def connect(sf_dir):
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v, digits=None):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        v = v + 0.0
        return repr(v) if digits is None else f"{v:.{digits}g}"
    return f"{type(v).__name__}:{v}"


def rows_of(cols, data, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(norm(r[i], digits)) for i in order) for r in data)


def compare(spark, con, sf_dir, fn, sql):
    """(ok, message): same columns, same rows; exact first, then to 9 digits."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, f"exact, {len(got)} rows"
    a, b = rows_of(df.columns, got, 9), rows_of(cols, want, 9)
    if a == b:
        return True, f"APPROX, {len(got)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"{len(bad)} of {len(got)} rows differ {sorted(cols)}: spark {bad[0][0]} sql {bad[0][1]}"


def main():
    from tablewright.plans import load
    from tablewright.plans.registry import MODULE_OF
    from tablewright.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = load()
    failed, mods = 0, {n: m for n, m in MODULE_OF.items()}
    for name, fn in queries.items():
        if names and name not in names and mods.get(name) not in names:
            continue
        t = time.time()
        try:
            if name in oracles:
                ok, msg = compare(spark, con, sf_dir, fn, oracles[name])
            else:
                ok, msg = True, f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"failed {failed}")


if __name__ == "__main__":
    main()
