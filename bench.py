"""Benchmark the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is executed into
Spark's ``noop`` sink (the full plan runs, nothing is collected to the
driver).  Each query runs ``BENCH_RUNS`` times (default 3); the first, cold
run is discarded and the best warm run is reported (the test VM is noisy).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "effective_permission",
    "entitlement_matrix",
    "folder_access_summary",
    "grants_listing",
    "volumes_with_folders",
    "csv_import",
    "bundle_manifest",
    "session_groups_asof",
    "removal_exposure",
]


def run_once(spark, job, sf_dir: str) -> float:
    t0 = time.perf_counter()
    job(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(2, int(os.environ.get("BENCH_RUNS", "3")))
    names = sys.argv[1:] or HEADLINE
    from permgrid.plans.catalog import all_queries
    from permgrid.session import build_session
    # spark.checkpoint.dir: the configured one, else checkpoint_root() makes a private local one
    spark = build_session(f"local[{cpus}]", app="permgrid-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * int(cpus)))))
    qs = all_queries()
    times: dict[str, float] = {}
    for n in names:
        t = [run_once(spark, qs[n], sf_dir) for _ in range(runs)]
        times[n] = round(min(t[1:]), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
