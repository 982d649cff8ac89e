"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from specloom.plans import catalog
from specloom.session import local_session

HEADLINE = [
    "within_group_auc", "average_precision", "best_threshold", "binary_summary", "three_state_label", "attach_clock",
    "event_interval", "incidence_profile", "collapse_views", "aggregate_scores_argmax", "latin_square_folds",
    "gaps_islands", "row_numbers", "snv", "savgol_deriv1", "eta_squared", "center_within", "pca_scores",
    "reference_median", "transmittance", "reflectance", "fill_bad_cells", "clamp_interpolate", "resample_shrink",
    "rle_decode", "overlap_assign", "pose_search", "leave_one_out_median", "pose_agreement", "white_percentile",
    "data_gate", "nested_cv_predictions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = catalog.queries()
    queries["three_state_label"](spark, folder).collect()  # start the engine once
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query reads what another kept
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
