"""Run registered queries against their oracle SQL: same columns, types, rows and values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def bag(rows, columns, order):
    at = [columns.index(c) for c in order]
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def compare(spark, con, query, folder: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if query.oracle is None:
        return None if rows else "no rows"
    rel = con.sql(query.oracle)
    order = sorted(df.columns)
    if order != sorted(rel.columns):
        return f"columns {order} != {sorted(rel.columns)}"
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if KINDS.get(kind) != theirs[name]:
            return f"type of {name}: {kind} != {theirs[name]}"
    want_rows = rel.fetchall()
    ours, want = bag(rows, df.columns, order), bag(want_rows, rel.columns, order)
    if not want_rows:
        return "oracle gives no rows"
    if ours != want:
        extra, missing = list((ours - want).items())[:2], list((want - ours).items())[:2]
        return f"{len(rows)} vs {len(want_rows)} rows; columns {order}\n   ours  {str(extra)[:1200]}\n   theirs {str(missing)[:1200]}"
    return None


def main(argv):
    from vacantia.plans import load
    from vacantia.session import local_session

    folder = f"/root/testdata/sf{argv[0]}" if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, query in load().items():
        if wanted and not any(w in (name, query.plan.__module__.split(".")[-1]) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, folder)
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = "ERROR " + str(exc).split("JVM stacktrace")[0][:900]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
