"""Times the headline queries and prints one JSON line.

Each query is built and run once to warm up and then ``BENCH_RUNS`` times; the median counts.
The rows are consumed by a no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog import REGISTRY
from terracell.session import local_session

HEADLINE = [
    "target_by_cell",
    "target_expanded",
    "all_countries_one_job",
    "road_density",
    "towers_by_cell",
    "conflicts_by_cell",
    "first_row_per_cell",
    "weighted_neighbour_mean",
    "zone_cells",
    "points_in_zones",
    "speed_by_cell",
    "tiles_meeting_zones",
    "wealth_by_cell",
    "raster_to_cells",
    "raster_clip",
    "raster_resample",
    "terrain_slope",
    "image_windows",
    "image_monthly",
    "interval_folds",
    "spatial_folds",
    "group_features",
    "weighted_scores",
    "spearman",
    "prediction_intervals",
    "country_dataset",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "terracell-bench")
    took = {}
    for name in HEADLINE:
        run = REGISTRY[name].run
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            run(spark, d).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(d.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
