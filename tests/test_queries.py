"""Every registered query that has an SQL statement gives the same values (a share per run of
the slow ones is covered by the driver at a larger size)."""

import pytest

import compare
from flightframe.catalog import QUERIES, SQL, load_all

load_all()
# View keys are unique from sf0.01 on; on the smallest tables one box repeats.
QUICK = (
    "landing_status", "landing_diagnostics", "iou_candidates", "motion_summary", "motion_confusion", "rank_auc", "group_statistics",
    "match_threshold_sensitivity", "timeout_sensitivity", "continuity", "motion_baseline", "trajectory", "gps_phase", "calibration_samples",
    "references_read", "frames_read", "dataset_issues", "active_references", "local_threshold_sweep", "cross_validation", "mutual_nearest",
    "global_motion", "vehicle_motion_residual", "threshold_sweep", "leaderboards", "profiles_selected", "pareto_frontier", "parameter_sensitivity",
    "scene_threshold_sweep_full", "names_canonical", "continuity_stream", "hull_coverage", "spatial_dedup", "rolling_calibration", "translation_estimated",
    "gps_loss_report", "patches_marked", "patch_regions", "ensemble_regions", "matrices_plausible", "planar_motion_fit", "match_distributions",
    "sessions_stream", "sessions_forgotten", "answers_committed", "annotations_read", "pair_truth_read", "descriptors_stored",
)


@pytest.fixture(scope="module")
def engine(sf):
    return compare.engine(sf)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, sf, engine, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert compare.differences(rows, engine.execute(SQL[name]).df()) is None


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 100
