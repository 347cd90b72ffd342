"""Run registered queries next to their SQL twins and report differences.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from heatgrid.session import clear_scratch, get_session  # noqa: E402


def canonical(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [canonical(x) for x in v]
    if isinstance(v, dict):
        return {k: canonical(x) for k, x in v.items()}
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(str(canonical(r[i])) for i in order) for r in records]
    return sorted(out)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "int", "long", "smallint", "hugeint", "tinyint")):
        return "int"
    return {"varchar": "string"}.get(t, t)


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} rows {t1 - t0:.1f}s", True
    rel = con.sql(sql)
    want = rel.fetchall()
    t2 = time.time()
    types = {c: kind(t) for c, t in df.dtypes}
    other = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    note = ""
    simple = {"int", "string", "double", "boolean", "date"}
    diff = {c: (types.get(c), other.get(c)) for c in set(types) | set(other) if types.get(c) != other.get(c)}
    if any(v[0] is None or v[1] is None or v[0] in simple or v[1] in simple for v in diff.values()):
        note = f" TYPES {diff}"
    if sorted(df.columns) != sorted(rel.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(rel.columns)}", False
    a, b = rows_of(df.columns, got), rows_of(list(rel.columns), want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFF {len(a)} vs {len(b)} rows; cols {sorted(df.columns)}; first {bad}{note}", False
    return f"ok {len(a)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s{note}", not note


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = get_session(
        "check", f"local[{os.cpu_count()}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if args and not any(a in name for a in args):
            continue
        try:
            msg, good = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:
            msg, good = f"ERROR {type(e).__name__}: {str(e)[:600]}", False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not good:
            failed.append(name)
        print(f"{name}: {msg}", flush=True)
    clear_scratch(spark)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
