"""Runs queries beside their SQL and compares the rows. python tests/compare.py SF NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    return c


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return int(f) if f == int(f) and abs(f) < 2**53 else round(f, 6)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """'' if the same."""
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = rows_of(names, cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if a[1] == b[1]:
        return ""
    only = [r for r in a[1] if r not in set(b[1])][:3], [r for r in b[1] if r not in set(a[1])][:3]
    return f"{len(a[1])} rows against {len(b[1])}; ours only {only[0]}; theirs only {only[1]}"[:1500]


def main(args):
    from tests.session import session

    import __spark_entry__ as e

    sf = f"/root/testdata/{args[0]}"
    spark, con = session(), duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    for name in args[1:] or qs:
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, name, qs[name], sqls[name], sf) or "same"
            else:
                said = f"rows {len(qs[name](spark, sf).collect())}"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        print(f"{name}: {said} [{time.time() - t:.1f} s]", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
