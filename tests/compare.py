"""Run registered queries against their SQL twins: ``python tests/compare.py [sf_dir] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

try:
    import duckdb
except ImportError:
    sys.path.append("/opt/oracle")
    import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, int):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return float(value) if hasattr(value, "as_tuple") else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    got = fn(spark, sf_dir)
    names, mine = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = con.execute(sql)
    their_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != their_names:
        return f"columns {names} != {their_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b and not (len(a) == len(b) and all(x == y and type(x) is type(y) or _close(x, y) for x, y in zip(a, b))):
            return "first difference " + "; ".join(_gap(n, x, y) for n, x, y in zip(names, a, b) if x != y) + f" in {str(a)[:300]}"
    return None


def _gap(name, x, y):
    x, y = repr(x), repr(y)
    at = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
    return f"{name}@{at}: {x[max(0, at - 40):at + 80]} <> {y[max(0, at - 40):at + 80]}"


def _close(x, y):
    if isinstance(x, bool) != isinstance(y, bool):
        return False
    return isinstance(x, (int, float)) and isinstance(y, (int, float)) and x == y


def main() -> int:
    from deskweave.session import local_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                n = fn(spark, sf_dir).count()
                verdict = f"rows only: {n}"
            else:
                problem = compare(spark, con, sf_dir, fn, sql)
                verdict = problem or "ok"
                bad += problem is not None
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            bad += 1
        print(f"{name:28s} {time.time() - started:6.1f}s  {verdict}", flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
