"""Headline-query benchmark: prints one JSON line.

Runs the headline queries at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]``; each query is materialised with the ``noop`` sink
(the full plan runs, nothing is collected), one warm-up then the median of
``$BENCH_REPEAT`` (default 3) timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "poll_run",
    "run_summary",
    "index_top100",
    "breaker_state",
    "escalation_state",
    "highlights_ranked",
    "near_dup_pairs",
    "digest_items",
    "push_queue",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from vigil.plans import registry
    from vigil.session import build_session

    spark = build_session(f"local[{cpus}]", app="vigil-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", cpus)),
                          extra={"spark.driver.memory": "16g"})
    registry.load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
             if n in registry.QUERIES]
    times: dict[str, float] = {}
    for name in names:
        fn = registry.QUERIES[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus),
                      "repeat": repeat}))


if __name__ == "__main__":
    main()
