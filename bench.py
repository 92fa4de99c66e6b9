"""Benchmark: the full pipeline on $BENCH_SF_DIR with local[$BENCH_CPUS].

As in production, the canonical tables are loaded once (``load_canonical``:
transactions partitioned by year plus the two place-year dimensions, written
to a fresh scratch folder) and then every registered job runs off them and is
sf0.001, then each job timed $BENCH_REPEAT times (default 3), median kept.
Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf", ...}.
``--derived`` instead times each job deriving its inputs from the driver tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tempfile  # noqa: E402

from brickyard.config import TEST  # noqa: E402
from brickyard.plans import catalog  # noqa: E402
from brickyard.session import ensure_checkpoint_dir, get_session  # noqa: E402
from brickyard.sources.tables import materialize  # noqa: E402


#: What a job reads in load-once mode, where it isn't only stored aggregates and dimensions.
READS = {"clean_transactions": "all sales", "load_profile": "all sales", "new_premium_avg": "all market sales", "register_cleaning": "customers"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = get_session(f"local[{cpus}]", int(cpus))
    ensure_checkpoint_dir(spark)
    qs = catalog.queries(TEST, load_once=False)
    if only:
        qs = {k: v for k, v in qs.items() if k in only}

    scratch = os.environ.get("BENCH_SCRATCH", "/tmp")
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):  # every job once, over its own kind of source
        small = catalog.jobs_on(materialize(spark, warm, tempfile.mkdtemp(prefix="brickyard-warm-", dir=scratch), TEST), TEST)
        for name, fn in qs.items():
            (fn(spark, warm) if "--derived" in sys.argv else small[name]()).collect()

    times, rows = {}, {}
    if "--derived" in sys.argv:
        run = {name: (lambda fn=fn: fn(spark, sf_dir)) for name, fn in qs.items()}
    else:
        store = tempfile.mkdtemp(prefix="brickyard-bench-", dir=scratch)
        t0 = time.perf_counter()
        src = materialize(spark, sf_dir, store, TEST)
        times["load_canonical"] = round(time.perf_counter() - t0, 3)
        rows["load_canonical"] = 0
        bound = catalog.jobs_on(src, TEST)
        run = {name: bound[name] for name in qs}
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    for name, fn in run.items():
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            out = fn().collect()
            runs.append(time.perf_counter() - t0)
        times[name] = round(sorted(runs)[len(runs) // 2], 3)
        rows[name] = len(out)
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    n_orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(json.dumps({"metric": "total_job_seconds", "value": total, "unit": "sec", "queries": times,
                      "rows": rows, "reads": {name: READS.get(name, "stored aggregates") for name in qs}, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
                      "input_sales": n_orders,
                      "mode": "derived" if "--derived" in sys.argv else "load_once", "repeat": repeat,
                      "load_sales_per_sec": round(n_orders / times["load_canonical"], 1) if "load_canonical" in times else None}))
    spark.stop()


if __name__ == "__main__":
    main()
