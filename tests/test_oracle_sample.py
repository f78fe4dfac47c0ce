"""One query per operator family against its DuckDB oracle at sf0.001
(the full set runs at sf0.01 with ``python tools/oracle_check.py``)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
SAMPLE = ["priority_by_segment", "fit_thresholds_positional", "column_profile", "detect_id_like", "apply_mapping",
          "preprocess_report", "feasibility_tasks", "feature_matrix", "trend_ewma", "horizon_label",
          "split_stratified", "roc_curve", "average_precision", "model_comparison", "alert_messages",
          "cascade_delete", "attribution_linear", "scan_csv", "metrics_unpivot", "class_weights"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_sample_queries_match_oracle(spark):
    from oracle_check import check

    assert check(spark, SF, SAMPLE, verbose=False) == []
