"""Run registered queries and compare them with their SQL oracles in DuckDB.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tallybridge import catalog  # noqa: E402
from tallybridge.session import local_session  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    catalog.load()
    spark = local_session("check")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            got_cols, got = df.columns, [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in catalog.ORACLES:
                print(f"rows  {name:34s} {len(got):8d} rows  spark {t1 - t0:5.1f}s")
                continue
            cur = con.execute(catalog.ORACLES[name])
            exp_cols, exp = [d[0] for d in cur.description], cur.fetchall()
            t2 = time.time()
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(exc)[:700]}")
            continue
        if sorted(got_cols) != sorted(exp_cols):
            bad += 1
            print(f"COLS  {name}: {sorted(got_cols)} vs {sorted(exp_cols)}")
            continue
        a, e = rows_of(got_cols, got), rows_of(exp_cols, exp)
        verdict = "ok" if a == e else "DIFF"
        if not a:
            verdict += " (empty)"
        bad += a != e
        print(f"{verdict:5s} {name:34s} {len(a):8d} rows  spark {t1 - t0:5.1f}s duckdb {t2 - t1:5.1f}s")
        if a != e:
            sa, se = set(map(repr, a)), set(map(repr, e))
            print("   columns", sorted(got_cols), "expected rows", len(e))
            for x in sorted(sa - se)[:4]:
                print("   spark ", x[:400])
            for x in sorted(se - sa)[:4]:
                print("   duckdb", x[:400])
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
