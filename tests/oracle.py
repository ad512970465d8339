"""Runs a query and its SQL side by side and reports the first difference.

``python tests/oracle.py [folder] [name ...]`` checks the named queries, or all of them.
"""

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP",
}


def compare(spark, con, folder, fn, sql):
    """None when both agree, else what differs."""
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if not sql:
        return None if rows else "no rows"
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    for f in df.schema.fields:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != want_types[f.name]:
            return f"type of {f.name}: {kind} != {want_types[f.name]}"
    names, got = _table(df.columns, rows)
    _, want = _table(want_names, want)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]
            return f"{bad} in {a}"
    return None if got else "both empty"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from cohortlens.session import local_session

    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con = connect(folder)
    failed = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, fn, entry.oracle_sql().get(name))
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{time.time() - start:6.1f}s {kind} {name}: {problem or 'ok'}", flush=True)
    print(f"{failed} problems", flush=True)
