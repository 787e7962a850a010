"""Compare registered queries with their SQL checks: python tools/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from marketgrid.plans import MODULES, registry  # noqa: E402
from marketgrid.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(str(norm(r[i])) for i in order) for r in data))


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    wanted = args[1:]
    base = f"/root/testdata/sf{sf}"
    for m in MODULES:
        if (Path(__file__).resolve().parents[1] / f"marketgrid/plans/{m}.py").exists():
            importlib.import_module(f"marketgrid.plans.{m}")
    spark = local_session()
    con = duckdb.connect()
    for f in sorted(Path(base).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    sqls = registry.oracle_sql()
    bad = 0
    for name, fn in registry.QUERIES.items():
        mod = fn.__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1]
        if wanted and not any(name.startswith(w) or mod == w for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, base)
            cols = df.columns
            data = [tuple(r) for r in df.collect()]
            dt = time.time() - t0
            if name not in sqls:
                print(f"ROWS {name} {len(data)} rows {dt:.1f}s {data[:1]}", flush=True)
                if not data:
                    bad += 1
                continue
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            odata = cur.fetchall()
            a, b = rows(cols, data), rows(ocols, odata)
            if sorted(cols) != sorted(ocols):
                print(f"BAD  {name} columns {sorted(cols)} vs {sorted(ocols)}", flush=True)
                bad += 1
            elif a != b:
                sa, sb = set(a), set(b)
                print(f"BAD  {name} {len(a)} vs {len(b)} rows; {len(sa - sb)} differ {sorted(cols)}", flush=True)
                for x in sorted(sa - sb)[:3]:
                    print("   spark ", x)
                for x in sorted(sb - sa)[:3]:
                    print("   duck  ", x)
                bad += 1
            else:
                allnull = [cols[i] for i in range(len(cols)) if data and all(r[i] is None for r in data)]
                print(f"ok   {name} {len(a)} rows {dt:.1f}s{' NULLCOLS ' + str(allnull) if allnull else ''}{' EMPTY' if not data else ''}", flush=True)
        except Exception as e:
            bad += 1
            print(f"ERR  {name} {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
