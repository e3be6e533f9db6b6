"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_RUNS    runs of each query (default 3); the median counts
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

from tarifflow import session
from tarifflow.plans.catalogue import QUERIES

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
RUN_SECONDS = 20

# Headline queries and the table each reads.
HEADLINE = {
    "clean_content": "pages",
    "build_snapshots": "pages",
    "content_changed": "lineitem",
    "line_diff_net": "documents",
    "line_diff": "documents",
    "pricing_changes": "lineitem",
    "pricing_changes_ordered": "lineitem",
    "history_report": "lineitem",
    "dedup_urls": "events",
    "cache_replay": "events",
    "robots_filter": "events",
    "throttle_schedule": "events",
    "plan_collection": "events",
    "resolve_provider": "pages",
    "extract_info": "pages",
    "plan_defaults": "lineitem",
    "recent_plans": "lineitem",
    "cheapest_plans": "lineitem",
    "assemble_answers": "conversations",
    "stage_stats": "events",
}


def timed(spark, name: str, sf_dir: str) -> list[float]:
    """Seconds of up to RUNS runs; a slow query is not run again beyond RUN_SECONDS."""
    out: list[float] = []
    while len(out) < RUNS and sum(out) < RUN_SECONDS:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = sys.argv[1:] or HEADLINE
    spark = session.build(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.log.level": "ERROR",
        },
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times, first, speed = {}, {}, {}
    for name in names:
        runs = timed(spark, name, sf_dir)
        times[name], first[name] = round(median(runs), 3), round(runs[0], 3)
        if name in HEADLINE:
            path = Path(sf_dir, f"{HEADLINE[name]}.parquet")
            size = sum(f.stat().st_size for f in path.rglob("*.parquet")) if path.is_dir() else path.stat().st_size
            speed[name] = round(size / 1e6 / times[name], 2)
        print(name, times[name], len(runs), file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "events", "documents", "pages")}
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "first_run": first,
        "mb_per_s": speed,
        "runs": RUNS,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cores": int(cpus),
        "spark": spark.version,
        "rows": rows,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
