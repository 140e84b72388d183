"""Time headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; print one JSON line.

Every query runs once to warm up code generation and is then timed writing all its rows to
the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialweave.plans.registry import load_all  # noqa: E402
from trialweave.session import local_session  # noqa: E402

HEADLINE = [
    "session_condition_means", "nearest_match", "clock_offset_search", "event_epochs", "baseline_correction",
    "behaviour_scan", "causal_lag_matrix", "smoother_bank", "true_runs", "band_pass_filter", "welch_spectrum",
    "channel_reasons", "null_percentiles", "spearman_by_group", "contextual_surprisal", "content_words",
    "fold_training_sums", "cca_tracking", "ridge_response", "shift_curves", "window_probe", "auc_permutation",
    "cluster_mass_test", "stratified_bootstrap_effect", "stream_trial_assembly", "stream_tumbling_windows",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="trialweave-bench")
    only = sys.argv[1:]
    registry = load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        run = registry[name].run
        for attempt in ("warm", "timed"):
            start = time.perf_counter()
            run(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
