"""Run registered queries beside their DuckDB SQL and compare whole results.

usage: python check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from tarifflow import session
from tarifflow.plans.catalogue import ORACLES, QUERIES


def local_session() -> SparkSession:
    return session.build(
        "check",
        **{
            "spark.master": "local[*]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
            "spark.log.level": "ERROR",
        },
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    total = sum(got.values())
    if name not in ORACLES:
        return f"rows-only ({total})" if total else "EMPTY"
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"COLUMNS {cols} <> {sorted(names)}"
    at = [names.index(c) for c in cols]
    rows = res.fetchall()
    want = Counter(tuple(r[i] for i in at) for r in rows)
    if got != want:
        extra, missing = got - want, want - got
        return f"DIFF rows {total}/{len(rows)}; only spark {list(extra.items())[:2]}; only sql {list(missing.items())[:2]}"
    types = {d[0]: str(d[1]) for d in res.description}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema.fields if f.dataType.simpleString() in ("int", "double")]
    return f"ok ({total})" + (f" {odd}" if odd else "") + ("" if total else " EMPTY")


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name)
        except Exception as problem:  # report and go on with the rest
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:26s} {time.time() - start:6.2f}s {verdict[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
