"""Run queries against DuckDB: ``python -m workload.check [sf_dir] [name ...]``."""

import sys
import time

import duckdb

from tablewright.plans.lineage import clear_steps
from tablewright.plans.session import build_session
from workload import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(got_cols, got, want_cols, want):
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    order = sorted(got_cols)
    pick = lambda cols, rows: sorted(
        (tuple(row[cols.index(c)] for c in order) for row in rows), key=lambda x: tuple((v is None, str(v)) for v in x)
    )
    a, b = pick(list(got_cols), got), pick(list(want_cols), want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    def kind(v):
        return "int" if type(v) is int else type(v).__name__

    for i, c in enumerate(order):
        kinds = {kind(row[i]) for row in a + b if row[i] is not None}
        if len(kinds) > 1:
            return f"column {c} has types {kinds}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else ""


def main(folder, names):
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            rows = [tuple(x) for x in df.collect()]
            took = time.time() - start
            if name in ORACLES:
                res = con.execute(ORACLES[name])
                cols = [c[0] for c in res.description]
                diff = compare(df.columns, rows, cols, res.fetchall())
            else:
                diff = ""
            kind = "sql" if name in ORACLES else "rows"
            print(f"{'FAIL' if diff else 'ok'} {name} [{kind}] rows={len(rows)} spark={took:.1f}s total={time.time() - start:.1f}s {diff}", flush=True)
        except Exception as e:  # report and go on
            diff = str(e)
            print(f"FAIL {name} {time.time() - start:.1f}s {diff[:900]}", flush=True)
        clear_steps(spark)
        if diff:
            failed.append(name)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, sys.argv[2:]) else 0)
