"""Feature view: lookbacks, late and duplicate klines, and no look into the future."""

from datetime import UTC, datetime, timedelta

import pytest

from tidemark.operators import asof, targets, views

BASE = datetime(2026, 7, 1, tzinfo=UTC)
D0 = int(BASE.timestamp() * 1000)
D5 = D0 + 300_000
SCHEMA = "series string, line_no long, start_ms long, end_ms long, close double, available_at timestamp"


def kline(n, start, close=100.0, received=None):
    end = start + 999
    at = datetime.fromtimestamp((received if received is not None else end) / 1000, UTC)
    return ("s", n, start, end, close, at)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def view(spark, rows, lookback=60):
    d = spark.createDataFrame([("s", D0), ("s", D5)], "series string, decision_ms long")
    found = asof.feature_view(frame(spark, rows), d, asof.Grid(lookback=lookback)).collect()
    return {r["window_ms"]: r for r in found}


def full(skip=(), close=lambda k: 100.0, first=61, last=1):
    return [kline(i, D5 - k * 1000, close(k)) for i, k in enumerate(range(first, last - 1, -1)) if k not in skip]


def test_full_lookback(spark):
    v = view(spark, full())
    assert not v[D0]["usable"] and v[D0]["short_flag"] == "missing_latest_kline"
    assert v[D5]["usable"] and v[D5]["feature_flag"] == "valid_all_initial_features" and v[D5]["volatility"] == 0


def test_a_hole_makes_the_lookback_invalid(spark):
    r = view(spark, full(skip={30}))[D5]
    assert r["short_valid"] and not r["long_valid"] and r["long_flag"] == "missing_kline" and r["feature_flag"] == "missing_kline"


def test_a_late_latest_kline_falls_back_one_second(spark):
    rows = full(first=62, last=2) + [kline(99, D5 - 1000, received=D5 + 100)]
    r = view(spark, rows)[D5]
    assert r["latest_start_ms"] == D5 - 2000 and r["usable"]


def test_net_return(spark):
    r = view(spark, full(close=lambda k: {1: 110.0, 2: 109.0}.get(k, 100.0)))[D5]
    assert r["return_short"] == pytest.approx(1 / 109) and r["return_long"] == pytest.approx(0.1)


def test_a_duplicate_poisons_a_start_even_if_it_comes_later(spark):
    r = view(spark, full() + [kline(999, D5 - 20_000, 1.0, received=D5 + 10_000_000)])[D5]
    assert not r["long_valid"] and r["long_flag"] == "duplicate_kline"


def test_reason_of_the_first_start_if_none_is_usable(spark):
    rows = [kline(0, D0 - 5000), kline(1, D0 - 5000), kline(2, D0 - 1000, received=D0 + 50)]
    assert view(spark, rows)[D0]["feature_flag"] == "duplicate_kline"


def test_features_do_not_change_with_the_future(spark):
    past = full(close=lambda k: 100.0 + k % 7)
    one = view(spark, past + [kline(500 + k, D5 + k * 1000, 101.0) for k in range(100)])[D5]
    other = view(spark, past + [kline(500 + k, D5 + k * 1000, 10_000.0) for k in range(50)])[D5]
    assert one == other


def target_rows(spark, rows):
    w = spark.createDataFrame([("s", D0), ("s", D5)], "series string, window_ms long")
    return targets.targets(frame(spark, rows), w)


def test_targets_keep_the_boundary_they_have(spark):
    r = {x["window_ms"]: x for x in target_rows(spark, [kline(0, D0 - 1000, 7.0, received=D0 + 9)]).collect()}
    assert r[D0]["target_flag"] == "missing_end_boundary" and r[D0]["start_price"] == 7.0 and r[D0]["label"] is None
    assert r[D5]["target_flag"] == "missing_start_boundary"


def test_late_start_equal_price_and_duplicate(spark):
    rows = [kline(0, D0 - 1000, 7.0, received=D0 + 9), kline(1, D5 - 1000, 7.0)]
    r = {x["window_ms"]: x for x in target_rows(spark, rows).collect()}
    assert r[D0]["target_flag"] == "valid_target_late_start_boundary" and r[D0]["label"] == "UP"
    r = {x["window_ms"]: x for x in target_rows(spark, rows + [kline(2, D5 - 1000, 8.0)]).collect()}
    assert r[D0]["target_flag"] == r[D5]["target_flag"] == "duplicate_boundary_observation"


def test_recovery_and_its_flags(spark):
    t = target_rows(spark, [kline(0, D0 - 1000, 7.0, received=D0 + 9)])
    at = BASE + timedelta(seconds=300)
    fix = spark.createDataFrame([(D5 - 1000, 8.0, at, "a")], "boundary_ms long, close double, available_at timestamp, source string")
    r = {x["window_ms"]: x for x in targets.recover(t, fix).collect()}
    assert r[D0]["label"] == "UP" and r[D0]["target_flag"] == targets.RECOVERED_LATE and r[D0]["start_source"] == "target_row_start"
    assert r[D5]["target_flag"] == "missing_start_boundary" and not r[D5]["needs_review"]


def test_recovery_borrows_the_end_of_the_row_before(spark):
    t = target_rows(spark, [kline(0, D0 - 1000, 7.0), kline(1, D5 - 1000, 9.0)])
    blank = t.selectExpr(
        "series", "window_ms", "window_end_ms",
        f"if(window_ms = {D5}, null, start_price) start_price", f"if(window_ms = {D5}, null, start_interval_ms) start_interval_ms",
        f"if(window_ms = {D5}, null, start_available_at) start_available_at",
        "end_price", "end_interval_ms", "end_available_at", "target_available_at", "label", "label_source", "label_definition", "target_valid", "target_flag",
    )
    fix = spark.createDataFrame([(D5 + 299_000, 8.0, BASE, "a")], "boundary_ms long, close double, available_at timestamp, source string")
    r = {x["window_ms"]: x for x in targets.recover(blank, fix).collect()}
    assert r[D5]["start_source"] == "previous_window_end" and r[D5]["start_price"] == 9.0 and r[D5]["label"] == "DOWN"


def test_audit_join_refuses_repeated_windows(spark):
    from tidemark.operators.checks import ConstraintError

    k = frame(spark, full())
    d = spark.createDataFrame([("s", D5)], "series string, decision_ms long")
    f = asof.feature_view(k, d)
    t = targets.targets(k, d.withColumnRenamed("decision_ms", "window_ms"))
    with pytest.raises(ConstraintError):
        views.audit_join(f.union(f), t)
    assert views.audit_join(f, t).first()["eligibility_reason"] == "invalid_target"
