"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = (
    "alarm_by_interval",
    "union_segments",
    "first_production_after",
    "adjust_overlay",
    "reconcile_outer",
    "impute_energy",
    "signal_join",
    "epot_cascade",
    "low_wind",
    "scan_met",
    "nullify_met",
    "grouped_results",
    "weekly_kpi",
    "top_loss",
    "full_calculation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session("bench", cpus)
    # The session starts up on an untimed query.
    QUERIES["cascade"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
        )
    )


if __name__ == "__main__":
    main()
