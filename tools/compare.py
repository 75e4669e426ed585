"""Run registered queries against their SQL twins in DuckDB and compare all rows."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from claimweave.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


DIGITS = 17


def normal(value):
    if isinstance(value, float):
        return f"{value:.{DIGITS}g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value) if isinstance(value, str) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, function, sql):
    start = time.perf_counter()
    df = function(spark, sf_dir)
    got, columns = rows_of(df.columns, df.collect())
    spent = time.perf_counter() - start
    if sql is None:
        return f"rows-only {len(got)} rows {spent:.1f}s"
    start = time.perf_counter()
    result = con.execute(sql)
    want, names = rows_of([d[0] for d in result.description], result.fetchall())
    took = time.perf_counter() - start
    if columns != names:
        return f"COLUMNS differ {columns} / {names}"
    if got != want:
        only_got = [r for r in got[:200000] if r not in set(want)][:3]
        only_want = [r for r in want[:200000] if r not in set(got)][:3]
        return f"ROWS differ {len(got)} / {len(want)}\n   spark {only_got}\n   sql   {only_want}"
    return f"ok {len(got)} rows spark {spent:.1f}s sql {took:.1f}s"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--module")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    if options.module:
        import importlib

        importlib.import_module(f"claimweave.plans.{options.module}")
        from claimweave.plans.registry import ORACLES, QUERIES
    else:
        from claimweave.plans import ORACLES, QUERIES
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{options.dir}/{name}.parquet'")
    bad = 0
    for name in options.names or QUERIES:
        try:
            verdict = compare(spark, con, options.dir, name, QUERIES[name], ORACLES.get(name))
        except Exception as fault:  # report and go on with the next query
            verdict = f"FAILED {type(fault).__name__}: {str(fault)[:1500]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:28s} {verdict}", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
