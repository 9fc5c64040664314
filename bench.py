"""Benchmark: every registered report at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is timed cold: the cache is cleared first, so the time covers the
warehouse scan, the five-way join into the ballot grain and the report, i.e.
what one report costs when run on its own. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from psephos.plans.registry import FLAGSHIP, QUERIES  # noqa: E402
from psephos.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", cpus, {"spark.driver.memory": "16g"})
    # JVM warm-up (class loading, JIT, codegen caches), one query per code
    # path: checkpointed grain, pivot, windows, pre-poll. Not timed.
    for name in (FLAGSHIP, "tcp_by_place", "senate_quotas_candidate", "prepoll_state_rate"):
        QUERIES[name](spark, sf_dir).collect()
    timings: dict[str, float] = {}
    rows: dict[str, int] = {}
    errors: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        try:
            rows[name] = len(fn(spark, sf_dir).collect())
        except Exception as e:  # noqa: BLE001 - report it, keep timing the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {errors[name]}", file=sys.stderr)
            continue
        timings[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {timings[name]}s rows={rows[name]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_report_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "spark_version": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "timing": "each query cold (cache cleared) after a four-query JVM warm-up",
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
