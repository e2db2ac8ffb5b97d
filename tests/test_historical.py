"""Dataset rows against loops over a dict of bars, with holes, and no look into the future."""

import math
import random
import statistics

import pytest

from tidemark.operators import bars, historical

SCHEMA = "series string, t long, open double, high double, low double, close double, volume double"


def bar(t, i):
    p = 100 + 0.01 * i
    return ("m", t, p, p + 0.02, p - 0.02, p + 0.01, 100.0 + t % 7)


def by_hand(rows, d, plan):
    b = {r[1]: r for r in rows}
    c = lambda k: b[d - k][5]
    out = dict.fromkeys(plan.features)
    if all(d - k in b for k in range(1, plan.lookback + 1)):
        r = [c(k) / c(k + 1) - 1 for k in range(1, max(plan.volatilities) + 1)]
        for k in plan.returns:
            out[f"return_{k}"] = c(1) / c(1 + k) - 1
        for k in plan.volatilities:
            out[f"volatility_{k}"] = statistics.pstdev(r[:k])
        ma, old = statistics.fmean(c(k) for k in range(1, 16)), statistics.fmean(c(k) for k in range(6, 21))
        out["distance_ma_15"], out["ma_slope_15"] = c(1) / ma - 1, ma / old - 1
        gain, loss = statistics.fmean(max(x, 0) for x in r[:14]), statistics.fmean(max(-x, 0) for x in r[:14])
        out["rsi_14"] = 100 - 100 / (1 + gain / loss) if loss else 100.0 if gain else 50.0
    if all(d - k in b for k in range(1, 6)):
        out["candle_body_5"] = c(1) / b[d - 5][2] - 1
        out["high_low_range_5"] = (max(b[d - k][3] for k in range(1, 6)) - min(b[d - k][4] for k in range(1, 6))) / c(1)
    if all(d - k in b for k in range(1, 66)):
        vol = [sum(b[d - 5 * j - k][6] for k in range(1, 6)) for j in range(13)]
        out["volume_ratio_5"] = vol[0] / statistics.median(vol[1:])
    return out


@pytest.mark.parametrize("plan", [historical.Plan((1, 5, 15, 30), (5, 15), 15, False, block=50), historical.Plan((1, 5, 15, 30, 60), (5, 15, 60), 60, True, block=33)])
def test_rows_equal_loops(spark, plan):
    rnd = random.Random(3)
    rows = [("m", t, *(rnd.uniform(90, 110) for _ in range(4)), rnd.uniform(1, 9)) for t in range(1000, 1300) if t not in (1150, 1151, 1290)]
    found = historical.dataset(spark.createDataFrame(rows, SCHEMA), plan).collect()
    assert len(found) == len({r["decision"] for r in found})
    for r in found:
        for name, want in by_hand(rows, r["decision"], plan).items():
            got = r[name]
            assert (got is None) == (want is None) and (want is None or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)), (r["decision"], name)


def test_future_changes_targets_alone(spark):
    d, plan = 5000, historical.QUARTER_HOUR
    d -= d % 15
    past = [bar(t, t - d + 65) for t in range(d - 65, d)]
    one = past + [bar(t, t - d + 65) for t in range(d, d + 15)]
    other = past + [(*bar(t, 0)[:5], 10_000.0, 1.0) for t in range(d, d + 15)]
    rows = [historical.dataset(spark.createDataFrame(x, SCHEMA), plan).where(f"decision = {d}").first().asDict() for x in (one, other)]
    assert rows[0]["eligible"] and rows[0]["label"] == "UP"
    assert all(rows[0][f] == rows[1][f] for f in plan.features) and rows[0]["target_end_price"] != rows[1]["target_end_price"]
    cut = historical.dataset(spark.createDataFrame(one[:-1], SCHEMA), plan).where(f"decision = {d}").first()
    assert cut["feature_row_usable"] and cut["target_flag"] == "missing_end_boundary" and not cut["eligible"]


def test_hourly_names_both_missing_boundaries(spark):
    r = historical.dataset(spark.createDataFrame([bar(600, 0)], SCHEMA), historical.HOURLY).where("decision = 660").first()
    assert r["target_flag"] == "missing_start_boundary;missing_end_boundary"
    assert r["feature_flag"] == "missing_minute_lookback;missing_5m_candle;missing_volume_history;missing_feature_values"


def test_incomplete_blocks_have_no_values(spark):
    x = spark.createDataFrame([bar(t, 0) for t in (0, 1, 2, 3, 4, 6)], SCHEMA)
    r = {b["b"]: b for b in bars.blocks(x, 4).collect()}
    assert r[0]["high"] is not None and r[1]["high"] is None and r[1]["bars"] == 2
