"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from epilattice.plans.catalog import QUERIES
from epilattice.session import local_session

HEADLINE = (
    "weekly_incidence",
    "clean_edges",
    "coupling_by_week",
    "lineage_shares",
    "vaccination_coverage",
    "poststratify",
    "immunity_share",
    "renewal_rt",
    "import_risk",
    "neighbor_pool",
    "spline_smooth",
    "granger_tests",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    # The first round compiles code and starts the Python workers; the second one counts.
    for _ in range(2):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
