"""Headline benchmark: gold metrics, pairs + cost model, top-5 and labels.

Prints one JSON line.  Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rxgrid.plans import pipeline  # noqa: E402
from rxgrid.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    out_dir = tempfile.mkdtemp(prefix="rxgrid-bench-", dir="/tmp")
    t0 = time.time()
    times = pipeline.run(spark, sf_dir, out_dir)
    total = time.time() - t0
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "pipeline_wall_clock",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
