"""The audit queries read every feature and target row; windows of one side only come from a fixture."""

import re

from tidemark import queries
from tidemark.operators import views


def test_registered_sql_leaves_no_window_out():
    assert not [n for n, sql in queries.ORACLE_SQL.items() if re.search(r"window_ms\s*//\s*\d+\s*%", sql)]


def test_windows_of_one_side_stay_with_their_reason(spark):
    features = spark.createDataFrame([("s", 1, True, "ok"), ("s", 2, True, "ok")], "series string, window_ms long, usable boolean, feature_flag string")
    targets = spark.createDataFrame([("s", 2, True, "UP"), ("s", 3, True, "UP")], "series string, window_ms long, target_valid boolean, label string")
    rows = {r["window_ms"]: r["eligibility_reason"] for r in views.audit_join(features, targets).collect()}
    assert rows == {1: "missing_target_row", 2: "eligible", 3: "missing_feature_row"}
