"""Per-task load of the exact quantile operator on skewed data, from Spark's event log.

    python tools/task_skew.py K

Builds the sf0.1 tables replicated xK with one place holding a third of all
customers (tools/scale_check.py --hot), runs the place-year price profile
(exact quantiles) with the event log written to a fresh /tmp folder, and
reports for every stage: tasks, the largest task's records read (input +
shuffle) and its share of all market sales, and the slowest task's time.
Prints one JSON line.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from brickyard.config import TEST  # noqa: E402
from brickyard.plans.market import place_year_profile  # noqa: E402
from brickyard.session import ensure_checkpoint_dir  # noqa: E402
from brickyard.sources import synthetic as S  # noqa: E402
from scale_check import build  # noqa: E402


def main():
    k = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    scratch = tempfile.mkdtemp(prefix="brickyard-skew-", dir="/tmp")
    logs = os.path.join(scratch, "events")
    os.makedirs(logs)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logs}")
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    data = os.path.join(scratch, "data")
    build(spark, k, True, data)
    ms = S.market_sales(spark, data, TEST)
    n = ms.count()
    hot = ms.where("county = 'NATION_0'").count()
    spark.sparkContext.setJobGroup("profile", "exact place-year profile")
    place_year_profile(ms, TEST).collect()
    app = spark.sparkContext.applicationId
    spark.stop()

    (path,) = glob.glob(os.path.join(logs, f"*{app}*"))
    files = sorted(glob.glob(os.path.join(path, "events_*")),
                   key=lambda f: int(os.path.basename(f).split("_")[1])) if os.path.isdir(path) else [path]
    group_jobs, stage_of, stages = set(), {}, {}
    for line in (ln for f in files for ln in open(f)):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart" and (e.get("Properties") or {}).get("spark.jobGroup.id") == "profile":
            group_jobs.add(e["Job ID"])
            for sid in e.get("Stage IDs", []):
                stage_of[sid] = e["Job ID"]
        elif ev == "SparkListenerTaskEnd" and e.get("Stage ID") in stage_of:
            m = e.get("Task Metrics") or {}
            scan = m.get("Input Metrics", {}).get("Records Read", 0)
            shuffled = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
            st = stages.setdefault(e["Stage ID"], {"tasks": 0, "max_scan_records": 0, "max_shuffle_records": 0,
                                                   "sum_shuffle_records": 0, "max_ms": 0})
            st["tasks"] += 1
            st["sum_shuffle_records"] += shuffled
            st["max_scan_records"] = max(st["max_scan_records"], scan)
            st["max_shuffle_records"] = max(st["max_shuffle_records"], shuffled)
            st["max_ms"] = max(st["max_ms"], m.get("Executor Run Time", 0))
    for st in stages.values():
        mean = st["sum_shuffle_records"] / st["tasks"]
        st["shuffle_max_over_mean"] = round(st["max_shuffle_records"] / mean, 2) if mean else None
    multi = [st for st in stages.values() if st["tasks"] > 1 and st["shuffle_max_over_mean"]]
    worst_ratio = max((st["shuffle_max_over_mean"] for st in multi), default=None)
    worst_scan = max(s["max_scan_records"] for s in stages.values())
    worst_shuffle = max(s["max_shuffle_records"] for s in stages.values())
    # scan tasks are file splits (sized by spark.sql.files.maxPartitionBytes, not by any key);
    # skew would show as one post-shuffle task reading the hot place's rows
    print(json.dumps({"replication": k, "market_sales": n, "hot_place_sales": hot,
                      "hot_place_share": round(hot / n, 3), "stages": len(stages),
                      "largest_scan_split_records": worst_scan,
                      "largest_shuffle_read_records": worst_shuffle,
                      "largest_shuffle_read_vs_hot_place": round(worst_shuffle / hot, 4),
                      "worst_shuffle_max_over_mean": worst_ratio,
                      "per_stage": {str(s): v for s, v in sorted(stages.items())}}))


if __name__ == "__main__":
    main()
