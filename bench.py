"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from netcohort import catalog  # noqa: E402
from netcohort.session import local_session  # noqa: E402

HEADLINE = [
    "T5_build_connectome", "G1_fixed_cost", "G7_binary_global_efficiency", "M1_session_metrics", "P2_exact_family",
    "P13_identification", "P14_identification_null_exact", "T2_segment_exclude", "V4_label_components", "S12_duplicate_payloads",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="netcohort-bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
