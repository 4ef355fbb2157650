"""Runs registered queries next to their SQL and compares the values."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(root: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, (str(t) for t in rel.types)))
    ours = dict(df.dtypes)
    if set(theirs) != set(ours):
        return f"columns {sorted(ours)} / {sorted(theirs)}"
    off = {c: (ours[c], theirs[c]) for c in ours if KINDS.get(ours[c], ours[c]) != theirs[c]}
    cols = sorted(ours)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())
    order = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)} only ours {sorted(set(a) - set(b))[:2]} only theirs {sorted(set(b) - set(a))[:2]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ: {bad[0]}"
    if off:
        return f"types {off}"
    return "" if a else "EMPTY"


def main() -> int:
    import __spark_entry__ as entry
    from corpusflow.session import local_session
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--explain", action="store_true")
    args = p.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            df = fn(spark, args.sf)
            if args.explain:
                df.explain("formatted")
            if name in sqls:
                said = compare(df, con, sqls[name])
            else:
                said = "" if (n := df.count()) else "EMPTY"
                said = said or f"(rows only: {n})"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:700]
        ok = said == "" or said.startswith("(")
        failed += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:34s} {time.time() - t:6.2f}s {said}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
