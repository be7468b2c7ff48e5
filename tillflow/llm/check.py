"""Compare the queries of this folder with their SQL: ``python -m tillflow.llm.check [sf_dir] [query ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from benchset.check import rows_of
from tillflow.llm.queries import ORACLE, QUERIES
from tillflow.session import get_session


def main(sf_dir: str, names: list[str]) -> int:
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        found = QUERIES[name](spark, sf_dir)
        columns, ours = rows_of(found.columns, [tuple(r) for r in found.collect()])
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows   {name:24s} {sum(ours.values())} {took:.1f}s", flush=True)
            continue
        start = time.time()
        cursor = db.execute(ORACLE[name])
        theirs_columns, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        ok = columns == theirs_columns and ours == theirs
        bad += not ok
        print(f"{'ok    ' if ok else 'DIFFER'} {name:24s} {sum(ours.values())} {took:.1f}s sql {time.time() - start:.1f}s", flush=True)
        if not ok:
            print(columns, theirs_columns, list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
