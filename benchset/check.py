"""Compare registered queries with their SQL: ``python -m benchset.check [sf_dir] [query ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

from tillflow.session import get_session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def main(sf_dir: str, names: list[str]) -> int:
    from benchset.oracle import ORACLE
    from benchset.queries import QUERIES

    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = QUERIES[name](spark, sf_dir)
            columns, ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows   {name:26s} {sum(ours.values())} {took:.1f}s", flush=True)
                continue
            start = time.time()
            cursor = db.execute(ORACLE[name])
            theirs_columns, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            sql = time.time() - start
            ok = columns == theirs_columns and ours == theirs
            print(f"{'ok    ' if ok else 'DIFFER'} {name:26s} {sum(ours.values())} {took:.1f}s sql {sql:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   ", columns, "" if columns == theirs_columns else theirs_columns, sum(theirs.values()))
                for label, extra in (("ours", ours - theirs), ("sql ", theirs - ours)):
                    for row in sorted(extra, key=str)[:3]:
                        print("   ", label, sum(extra.values()), row, flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAILED {name:26s} {time.time() - start:.1f}s {str(error).splitlines()[0][:400]}", flush=True)
    print("not equal:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
