"""Command line: load registers, run every job, write one result directory per job.

    python -m brickyard load --register DIR --years 2020-2024 --out CLEAN_TABLE
    python -m brickyard sync --register DIR --years 2020-2024 --affordability A.csv --supply S.csv --store DIR
    python -m brickyard run  --store DIR --out DIR                            # the store's latest version
    python -m brickyard run  --transactions CLEAN_TABLE --affordability A.csv --supply S.csv --out DIR
    python -m brickyard run  --sf-dir /root/testdata/sf0.1 --out DIR          # the driver's tables
    python -m brickyard stream --landing DIR --out CLEAN_TABLE --checkpoint-location DIR [--continuous]

On a cluster, submit with spark-submit and set spark.checkpoint.dir to a shared folder.
"""

from __future__ import annotations

import argparse
import sys

from .config import Config, TEST
from .plans import catalog
from .operators.scalars import require_unique
from .session import ensure_checkpoint_dir, get_session
from .sources.register import load_manifest, read_register
from .sources.sinks import write_clean_table, write_result
from .sources.store import Store
from .sources.tables import DerivedSources, RegisterSources, StoredSources, sync_registers


def _years(text: str) -> list[int]:
    if "-" in text:
        a, b = text.split("-")
        return list(range(int(a), int(b) + 1))
    return [int(y) for y in text.split(",")]


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="brickyard")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="raw yearly registers -> clean transactions table")
    ld.add_argument("--register", required=True)
    ld.add_argument("--years", default="2020-2024")
    ld.add_argument("--out", required=True)
    sy = sub.add_parser("sync", help="bring a versioned store up to a folder of registers and the dimension files")
    sy.add_argument("--register", required=True)
    sy.add_argument("--years", default="2020-2024")
    sy.add_argument("--affordability", required=True)
    sy.add_argument("--supply", required=True)
    sy.add_argument("--investment-scores")
    sy.add_argument("--store", required=True)
    sy.add_argument("--keep", type=int, default=2, help="versions that stay")
    rn = sub.add_parser("run", help="run jobs and write their results")
    rn.add_argument("--sf-dir")
    rn.add_argument("--store", help="a store that sync keeps")
    rn.add_argument("--transactions")
    rn.add_argument("--affordability")
    rn.add_argument("--supply")
    rn.add_argument("--investment-scores", help="stored scores and tiers (CSV); default: derived")
    rn.add_argument("--out", required=True)
    rn.add_argument("--format", default="csv", choices=["csv", "parquet"])
    rn.add_argument("--jobs", default="", help="comma-separated job names (default: all)")
    sm = sub.add_parser("stream", help="incremental loader: register files landing in a folder -> clean table")
    sm.add_argument("--landing", required=True)
    sm.add_argument("--out", required=True)
    sm.add_argument("--checkpoint-location", required=True)
    sm.add_argument("--continuous", action="store_true", help="keep polling (default: process what is there, stop)")
    rn.add_argument("--approx-quantiles", action="store_true",
                    help="one-pass quantile sketches instead of exact PERCENTILE_CONT (explicit opt-in)")
    for p in (ld, rn, sm, sy):
        p.add_argument("--master")
        p.add_argument("--base-year", type=int)
        p.add_argument("--latest-year", type=int)
        p.add_argument("--focus-place")
        p.add_argument("--commuter-places", help="comma-separated")
    a = ap.parse_args(argv)

    def configured(cfg: Config) -> Config:
        over = {k: v for k, v in (("base_year", a.base_year), ("latest_year", a.latest_year),
                                  ("focus_place", a.focus_place)) if v is not None}
        if getattr(a, "approx_quantiles", False):
            over["exact_quantiles"] = False
        if a.commuter_places:
            over["commuter_places"] = tuple(x.strip() for x in a.commuter_places.split(","))
        return cfg.with_(**over)

    spark = get_session(a.master)
    ensure_checkpoint_dir(spark)
    if a.cmd == "stream":
        from .streaming.register_stream import rejects, start_register_stream
        q = start_register_stream(spark, a.landing, a.out, a.checkpoint_location, cfg=configured(Config.register()),
                                  available_now=not a.continuous)
        q.awaitTermination()
        for reason, n in rejects(q).items():
            print(f"{n} {reason}", file=sys.stderr)
        return 0
    if a.cmd == "load":
        cfg = configured(Config.register())
        write_clean_table(read_register(spark, a.register, _years(a.years), cfg), a.out)
        for r in load_manifest(spark, a.register, _years(a.years), cfg).orderBy("file_year").collect():  # a row per file
            print(", ".join(f"{k} {v}" for k, v in r.asDict().items() if v is not None and v != 0), file=sys.stderr)
        return 0
    if a.cmd == "sync":
        src = sync_registers(spark, a.register, _years(a.years), a.affordability, a.supply, a.store, configured(Config.register()), a.investment_scores, a.keep)
        print(f"version {src.manifest['version']}: {sum(v['rows'] for v in src.manifest['slices'].values())} sales in {len(src.manifest['slices'])} files", file=sys.stderr)
        return 0
    if a.sf_dir:
        cfg = configured(TEST)
        src = DerivedSources(spark, a.sf_dir, cfg)
    elif a.store:
        cfg = configured(Config.register())
        src = StoredSources(Store(spark, a.store, cfg))
        if src.manifest is None or src.manifest["config"] != src.store.config_key():
            ap.error(f"{a.store} holds no version for these parameters; run sync")
    else:
        cfg = configured(Config.register())
        src = RegisterSources(spark, a.transactions, a.affordability, a.supply, cfg, a.investment_scores)
        require_unique(src.aff(), ["county", "year"], a.affordability)
        require_unique(src.sd(), ["county", "year"], a.supply)
        if a.investment_scores:
            require_unique(src.scores(), ["county"], a.investment_scores)
    jobs = catalog.jobs_on(src, cfg)
    names = [n for n in a.jobs.split(",") if n] or [n for n in jobs if a.sf_dir or n not in catalog.UNSTORED]
    for name in names:
        write_result(catalog.ordered(name, jobs[name]()), f"{a.out.rstrip('/')}/{name}", a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
