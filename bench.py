"""Headline-query benchmark: prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
Each query is forced end-to-end with the no-op sink (full execution, no
driver collection).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans.queries import QUERIES  # noqa: E402
from riskloom.session import get_session  # noqa: E402

HEADLINE = [
    "split_stratified",
    "feature_build",
    "clip_caps",
    "drift_psi",
    "evaluate_all_splits",
    "threshold_sweep",
    "policy_select",
    "scorecard",
    "cv_summary",
    "bootstrap_ci",
    "permutation_importance",
    "risk_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up: JVM, parquet footers
    QUERIES["scan_parquet"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
