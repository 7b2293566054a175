"""Run registered queries beside their DuckDB twins and compare the whole results.

Usage: python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sievewatch.session import build_session  # noqa: E402
from sievewatch.workloads import catalog  # noqa: E402
from sievewatch.workloads.inputs import BASE  # noqa: E402


def kind(dtype: str) -> str:
    d = dtype.lower()
    if "[" in d or d.startswith("array"):
        return "list"
    for name, words in {
        "float": ["double", "float"],
        "int": ["int", "long", "short", "byte"],
        "time": ["timestamp"],
        "date": ["date"],
        "text": ["varchar", "string"],
        "bool": ["bool"],
        "decimal": ["decimal"],
    }.items():
        if any(w in d for w in words):
            return "huge" if "hugeint" in d else name
    return d


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(repr([plain(r[i]) for i in order]) for r in rows)


def duck(folder: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder: str, name: str) -> tuple[bool, str]:
    """(equal, note); a query without a twin only has to give rows."""
    df = catalog.jobs()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no twin"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        return False, (
            f"{len(got)} vs {len(want)} rows; only here {list((a - b).items())[:2]}; "
            f"only there {list((b - a).items())[:2]}"
        )
    note = f"{len(got)} rows" if got else "0 rows (empty)"
    diff = {c: (ours[c], types[c]) for c in cols if ours[c] != types[c]}
    return not diff, note + (f" TYPES {diff}" if diff else "")


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    bad = 0
    for name in catalog.jobs():
        if not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            ok, note = check(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
