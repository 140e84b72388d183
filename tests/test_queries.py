"""Every registered query with SQL agrees with DuckDB on the smoke tables.

The quick set runs by default; ``TRIALWEAVE_ALL=1`` runs all of them.
"""

import os

import pytest

from tools.check_oracle import compare, connect
from tools.coverage import table
from trialweave.plans.registry import load_all

REGISTRY = load_all()
QUICK = [
    "session_condition_means", "nearest_match", "clock_offset_search", "missing_edge_recovery", "event_epochs", "marker_scan",
    "header_scan", "behaviour_scan", "next_id_allocation", "fit_to_length", "row_thinning", "causal_lag_matrix", "true_runs",
    "spread_windows", "average_reference", "gap_interpolation", "channel_reasons", "marker_pivot", "document_auc", "roc_curve",
    "band_pass_filter", "welch_spectrum", "contextual_surprisal", "probe_choice", "mismatched_partners", "auc_permutation",
    "cluster_mass_test", "pooled_covariance", "roi_nested_selection", "roi_window_probe", "stream_tumbling_windows",
]
NAMES = [n for n, q in REGISTRY.items() if q.sql] if os.environ.get("TRIALWEAVE_ALL") else QUICK


@pytest.fixture(scope="session")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, duck, name):
    q = REGISTRY[name]
    message = compare(q.run(spark, sf), duck, q.sql)
    assert message.startswith("ok") and "TYPES" not in message, message


def test_every_inventory_id_has_a_query():
    assert [i for i, names in table().items() if not names] == []


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["user_id", "n_trials", "mean_click", "mean_error", "diff"]


def test_partial_marks_are_in_the_coverage_list():
    from pathlib import Path

    from tools.coverage import PARTIAL

    lines = Path(__file__).parents[1].joinpath("COVERAGE.md").read_text().splitlines()
    for i, name in PARTIAL:
        assert name in table()[i] and any(x.startswith(f"| {i} |") and f"{name} (partial)" in x.replace("*", "") for x in lines)
        # another query of the id does the rest
        assert any((i, other) not in PARTIAL for other in table()[i])
