"""Compare registered queries with their SQL on the same Parquet tables.

usage: python tools/check_oracle.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")),
                  round(v, 6) if isinstance(v, float) else v if isinstance(v, int) else str(v))
                 for v in row)


def kind(values):
    names = {type(v).__name__ for v in values if v is not None}
    return names.pop() if len(names) == 1 else "/".join(sorted(names)) or "none"


def compare(cols_a, rows_a, cols_b, rows_b):
    """'' when identical, 'float~' when only float digits differ, else the first difference."""
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} != {sorted(cols_b)}"
    names = sorted(cols_a)
    ia, ib = [cols_a.index(c) for c in names], [cols_b.index(c) for c in names]
    a = sorted((tuple(norm(r[i]) for i in ia) for r in rows_a), key=sort_key)
    b = sorted((tuple(norm(r[i]) for i in ib) for r in rows_b), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {a[:2]} | {b[:2]}"
    for i, c in enumerate(names):
        ka, kb = kind([r[i] for r in a]), kind([r[i] for r in b])
        if ka != kb and "none" not in (ka, kb):
            return f"type of {c}: {ka} != {kb}"
    near = False
    for x, y in zip(a, b):
        for c, u, v in zip(names, x, y):
            if u == v:
                continue
            if isinstance(u, float) and isinstance(v, float) and math.isclose(
                    u, v, rel_tol=1e-9, abs_tol=1e-9):
                near = True
                continue
            return f"{c}: {u!r} != {v!r} in {dict(zip(names, x))} | {dict(zip(names, y))}"[:900]
    return "float~" if near else ""


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import importlib
    entry = importlib.import_module("__spark_entry__")
    from tidegauge.session import get_session
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = ok = 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(p) for p in args):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name not in sqls:
                print(f"rows   {name:40s} {len(rows):7d} {took:6.2f}s {str(rows[:1])[:150]}", flush=True)
                continue
            res = con.execute(sqls[name])
            cols = [d[0] for d in res.description]
            verdict = compare(df.columns, rows, cols, res.fetchall())
        except Exception as e:  # report and go on with the next query
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
            took, rows = time.time() - t, []
        if verdict in ("", "float~"):
            ok += 1
        else:
            bad += 1
        print(f"{'FAIL ' if verdict not in ('', 'float~') else 'near ' if verdict else 'same '} "
              f"{name:40s} {len(rows):7d} {took:6.2f}s {verdict}", flush=True)
    print(f"{ok} match, {bad} differ")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
