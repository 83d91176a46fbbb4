"""Compare registered queries with their oracle SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lamella.sources.derived import BASE  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


TYPES = {
    "SMALLINT": "smallint",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "FLOAT": "float",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def rows_of_spark(df):
    names = sorted(df.columns)
    ordered = df.select(*[f"`{n}`" for n in names])
    return ordered.dtypes, [tuple(r) for r in ordered.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    raw = [(d[0], TYPES.get(str(d[1]), str(d[1]))) for d in cur.description]
    order = sorted(range(len(raw)), key=lambda i: raw[i])
    return [raw[i] for i in order], [tuple(r[i] for i in order) for r in cur.fetchall()]


def diff(spark_side, duck_side) -> str | None:
    (n1, r1), (n2, r2) = spark_side, duck_side
    if n1 != n2:
        return f"columns {sorted(set(n1) - set(n2))} != {sorted(set(n2) - set(n1))}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    s1 = sorted(tuple(plain(v) for v in r) for r in r1)
    s2 = sorted(tuple(plain(v) for v in r) for r in r2)
    bad = [(a, b) for a, b in zip(s1, s2) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from tests.conftest import make_session
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0") else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(folder)
    q, o = queries(), oracle_sql()
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = []
    for name in names:
        t0 = time.time()
        try:
            got = rows_of_spark(q[name](spark, folder))
            t1 = time.time()
            note = "rows only"
            if name in o:
                why = diff(got, rows_of_duck(con, o[name]))
                note = why or "ok"
                if why:
                    failed.append(name)
            print(f"{name:32s} {len(got[1]):8d} rows spark {t1 - t0:6.2f}s duck {time.time() - t1:6.2f}s  {note[:900]}", flush=True)
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"{name:32s} ERROR {str(e)[:1500]}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
