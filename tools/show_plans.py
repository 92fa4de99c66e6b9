"""Write the final (AQE) physical plans of chosen jobs to docs/plans/<job>.txt.

    python tools/show_plans.py [sf_dir] [job ...]

Jobs run over canonical tables stored once (the production flow), are
collected, and their executed plans are written with ``explain("formatted")``.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brickyard.config import TEST  # noqa: E402
from brickyard.plans import catalog  # noqa: E402
from brickyard.session import ensure_checkpoint_dir, get_session  # noqa: E402
from brickyard.plans import profiles as P  # noqa: E402
from brickyard.sources.tables import materialize  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or ["profiles", "market_pulse", "focus_vs_rest", "heat_index",
                             "commuter_belt"]
    spark = get_session("local[8]", 8)
    ensure_checkpoint_dir(spark)
    src = materialize(spark, sf, tempfile.mkdtemp(prefix="brickyard-plans-", dir="/tmp"), TEST)
    jobs = catalog.jobs_on(src, TEST)
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    for name in names:
        if name == "profiles":       # all price profiles, from the stored histogram and one read of the sales
            df = P.profiles(src.tx(), TEST, src.histogram())
        else:
            df = jobs[name]()
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write(f"# {name} over stored canonical tables ({sf}), final adaptive plan\n\n")
            f.write(buf.getvalue())
        print(name, len(buf.getvalue()))


if __name__ == "__main__":
    main()
