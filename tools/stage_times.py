"""Per-stage wall time of one registered query, from Spark's event log.

Usage: [STAGE_CONF=key=value,...] python tools/stage_times.py <query> [sf_dir]
The event log goes to a fresh scratch folder; the Spark UI stays off.
STAGE_CONF adds session settings for an experiment.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="evlog-")
    from permgrid.plans.catalog import all_queries
    from permgrid.session import build_session
    extra_conf = dict(kv.split("=", 1) for kv in os.environ.get("STAGE_CONF", "").split(",") if kv)
    spark = build_session("local[8]", shuffle_partitions=16, extra={**extra_conf,
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    job = all_queries()[name]
    for run in range(2):
        t0 = time.time()
        job(spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"run {run}: {time.time() - t0:.2f}s")
    spark.stop()
    stages = {}
    tasks: dict[int, list[float]] = {}
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        for line in open(path):
            ev = json.loads(line)
            if ev.get("Event") == "SparkListenerTaskEnd":
                ti = ev["Task Info"]
                tasks.setdefault(ev["Stage ID"], []).append((ti["Finish Time"] - ti["Launch Time"]) / 1000)
            if ev.get("Event") == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                stages[info["Stage ID"]] = (info["Completion Time"] - info["Submission Time"],
                                            info["Number of Tasks"], info["Stage Name"][:60])
    ids = sorted(stages)
    for sid in ids:
        d, n, nm = stages[sid]
        if d > 100:
            ts = sorted(tasks.get(sid, [0]))
            print(f"stage {sid:4d} {d / 1000:6.2f}s tasks={n:4d} max={ts[-1]:.2f}s "
                  f"median={ts[len(ts) // 2]:.2f}s {nm}")


if __name__ == "__main__":
    main()
