"""Captures, tables, paging, manifests and sinks on small files."""

import gzip
import json
import zipfile
from datetime import date

import pytest

from tidemark import cli
from tidemark.operators import asof, audit, model
from tidemark.plans import manifest, sinks
from tidemark.sources import raw_events, rest, tables

T0 = 1_782_691_200_000


def event(start, close="100", received=None, closed=True, stream="btcusdt@kline_1s"):
    at = received or "2026-06-29T00:00:10.000001Z"
    return json.dumps({"received_at_utc": at, "stream": stream, "raw_event": {"k": {"t": start, "T": start + 999, "c": close, "x": closed}}})


@pytest.fixture
def capture(tmp_path):
    lines = [event(T0), event(T0 + 1000), "{bad", "[1]", "", event(T0 + 3000, closed="true"), event(T0, closed=True), json.dumps({"received_at_utc": "2026-06-29T00:00:11Z"})]
    raw = gzip.compress("\n".join(lines).encode())
    plain = tmp_path / "binance_raw_events_2026-06-29.jsonl.gz"
    plain.write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.writestr(plain.name, raw)
        z.writestr("other.txt", b"x")
    return tmp_path, plain


@pytest.mark.parametrize("name", ["binance_raw_events_2026-06-29.jsonl.gz", "day.zip"])
def test_scan_counts_are_the_same_for_gzip_and_zip(spark, capture, name):
    folder, _ = capture
    rows = raw_events.events(raw_events.read_lines(spark, str(folder / name)))
    r = audit.scan_counts(rows, "btcusdt@kline_1s", T0, T0 + 2000).first()
    assert (r["malformed"], r["records_scanned"], r["kline_records"], r["closed_klines"], r["in_window"]) == (2, 5, 4, 3, 3)
    c = audit.coverage(raw_events.closed_klines(rows, "btcusdt@kline_1s"), T0, T0 + 2000).first()
    assert (c["distinct_starts"], c["missing_starts"], c["duplicates"], c["backward_starts"]) == (2, 0, 1, 0)
    assert {x["stream"]: x["records"] for x in audit.stream_counts(rows).collect()}["<missing>"] == 1


def test_member_choice():
    assert raw_events.choose_member(["a/binance_raw_events_1.jsonl.gz", "b"]) == "a/binance_raw_events_1.jsonl.gz"
    for names, member in ((["x"], None), (["binance_raw_events_1.jsonl.gz", "binance_raw_events_2.jsonl.gz"], None), (["x"], "y")):
        with pytest.raises(ValueError):
            raw_events.choose_member(names, member)


def test_a_closed_kline_without_close_stops(spark, tmp_path):
    p = tmp_path / "a.jsonl.gz"
    p.write_bytes(gzip.compress(b'{"received_at_utc":"2026-06-29T00:00:11Z","stream":"s","raw_event":{"k":{"t":1,"T":2,"x":true}}}'))
    with pytest.raises(Exception, match="without a value"):
        raw_events.closed_klines(raw_events.events(raw_events.read_lines(spark, str(p))), "s").collect()


def test_paging_advances_and_refuses_errors():
    day = date(2026, 6, 29)
    row = lambda m: [T0 + m * 60_000, "1", "2", "0.5", "1.5", "9", T0 + m * 60_000 + 59_999, "1", 3, "1", "1", "0"]
    pages = [[row(m) for m in range(1000)], [row(m) for m in range(1000, 1440)]]
    asked = []

    def opener(url):
        asked.append(url)
        return json.dumps(pages[len(asked) - 1]).encode()

    out = rest.normalised(rest.fetch_day("http://x", "S", day, opener), day)
    assert len(out) == 1440 and len(asked) == 2 and "limit=1000" in asked[0] and len(out[0]) == 11
    with pytest.raises(ValueError):
        list(rest.fetch_day("http://x", "S", day, lambda u: b'{"code": 1}'))
    with pytest.raises(ValueError):
        rest.normalised(iter([row(0), row(0)]), day)


def test_manifest_groups_files_by_day_and_role(spark, capture):
    folder, plain = capture
    (folder / "recorder.log.2026-06-29.gz").write_bytes(b"x")
    m = manifest.records(tables.file_identity(spark, str(folder)))
    r = m.first()
    assert m.count() == 1 and sorted(r["inputs"]) == ["binance_raw", "recorder_log"] and r["missing_input_roles"] == ["polymarket_raw"]
    cover = spark.createDataFrame([(plain.name, "2026-06-29T00:00:00Z")], "alias string, start_utc string")
    assert manifest.runnable(manifest.with_coverage(m, cover)).count() == 1
    assert manifest.find(m, "2026-06-29").count() == 1
    with pytest.raises(ValueError):
        manifest.find(m, "nothing")
    clash = spark.createDataFrame([(plain.name, "2026-06-29T00:00:00Z"), ("group-2026-06-29", "2026-06-28T00:00:00Z")], "alias string, start_utc string")
    with pytest.raises(Exception, match="conflicting"):
        manifest.with_coverage(m, clash).collect()


def test_sinks_write_whole_files_once(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    x = spark.createDataFrame([(2, 0.5, True, None), (1, 0.125, False, "a")], "k int, v double, b boolean, s string")
    sinks.write_csv(x, path, ["k"])
    assert open(path).read().split() == ["k,v,b,s", "1,0.125,false,a", "2,0.5,true,"]
    with pytest.raises(FileExistsError):
        sinks.write_csv(x, path, ["k"], overwrite=False)
    sinks.write_json(spark, {"a": 1}, str(tmp_path / "o.json"))
    assert tables.read_document(spark, str(tmp_path / "o.json")) == {"a": 1}
    assert sinks.versioned_name("a b", "0" * 64, "v1").startswith("a-b_000000000000_v1_")


def test_coverage_map_begins_at_midnight(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"g": "2026-06-29T00:00:01Z"}')
    with pytest.raises(ValueError, match="midnight"):
        tables.coverage_map(spark, str(p))


def test_commands(spark, capture, tmp_path):
    _, plain = capture
    out = str(tmp_path / "audit.json")
    base = ["day-audit", str(plain), "--start", "2026-06-29T00:00:00Z", "--duration-seconds", "2"]
    assert cli.main([*base, "--output", out], spark) == 0
    assert json.load(open(out))["archives"][0]["missing_starts"] == 0
    assert cli.main([*base, "--output", out], spark) == 2
    assert cli.main(["nothing"], spark) == 2 and len(cli.COMMANDS) == 17
    view = str(tmp_path / "view")
    k = ["--start", "2026-06-29T00:00:00Z", "--duration-seconds", "600"]
    assert cli.main(["feature-view", str(plain), *k, "--output", view], spark) == 0
    assert cli.main(["proxy-targets", str(plain), *k, "--output", view + "t"], spark) == 0
    joined = ["--audit", view + "a", "--model", view + "m", "--report", view + ".json"]
    assert cli.main(["proxy-join", "--features", view, "--targets", view + "t", *joined], spark) == 0
    assert json.load(open(view + ".json"))["counters"]["audit_rows"] == 2


def test_historical_command_resumes(spark, tmp_path):
    from datetime import UTC, datetime, timedelta

    folder = tmp_path / "bars"
    folder.mkdir()
    for d in range(4):
        lines = [",".join(tables.MINUTE_BARS.names)]
        for m in range(1440):
            at = datetime(2026, 6, 1 + d, tzinfo=UTC) + timedelta(minutes=m)
            p = 100 + (m % 17) / 10
            stamp = at.strftime("%Y-%m-%dT%H:%M:%S.000Z")
            lines.append(f"{stamp},{p},{p + 1},{p - 1},{p + 0.5},{5 + m % 3},{stamp},1,1,1,1")
        (folder / f"2026-06-0{1 + d}.csv").write_text("\n".join(lines) + "\n")
    a = ["historical-15m", str(folder), "--audit", str(tmp_path / "a"), "--model", str(tmp_path / "m"), "--report", str(tmp_path / "l.json"), "--csv", str(tmp_path / "csv"), "--train-days", "1", "--validation-days", "1"]
    assert cli.main(a, spark) == 0
    assert spark.read.parquet(str(tmp_path / "a")).count() == 288
    parts = {r["part"]: r["count"] for r in spark.read.parquet(str(tmp_path / "m")).groupBy("part").count().collect()}
    assert parts == {"train": 96, "validation": 96, "test": 96}
    one = tmp_path / "csv" / "days" / "2026-06-03.csv"
    assert len(one.read_text().splitlines()) == 97 and len((tmp_path / "csv" / "dataset-audit-v1.csv").read_text().splitlines()) == 289
    made = one.stat().st_mtime_ns
    assert cli.main(a, spark) == 0 and one.stat().st_mtime_ns == made
    one.write_text("damaged")
    assert cli.main(a, spark) == 0 and len(one.read_text().splitlines()) == 97
    (folder / "2026-06-04.csv").write_text((folder / "2026-06-04.csv").read_text().replace("\n2026-06-04T00:01", "\n2026-06-04T00:00"))
    assert cli.main(a, spark) == 2 and json.load(open(tmp_path / "l.json"))["status"] == "failed"


def test_exact_logistic_optimum(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 2)) * [1, 5] + [3, 0]
    y = (x[:, 0] + 0.1 * x[:, 1] + rnd.normal(size=300) > 3).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    m = model.fit(rows, ["a", "b"])
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(300)])
    beta = np.array([*m.weight, m.intercept])
    p = 1 / (1 + np.exp(-z @ beta))
    assert np.abs(z.T @ (p - y) + beta).max() < 1e-6


def test_snapshot_needs_consecutive_arrivals(spark):
    rows = [("s", i, T0 + i * 1000, T0 + i * 1000 + 999, 100.0 + i) for i in range(5)]
    x = spark.createDataFrame(rows, "series string, line_no long, start_ms long, end_ms long, close double").selectExpr("*", "timestamp_millis(end_ms) available_at")
    r = audit.snapshot(x, T0 + 5000, asof.Grid(lookback=4)).first()
    assert r["snapshot_usable"] and r["return_long"] == pytest.approx(0.04)
    r = audit.snapshot(x.where("line_no != 2"), T0 + 5000, asof.Grid(lookback=3)).first()
    assert r["long_flag"] == "nonconsecutive_lookback" and r["short_flag"] == "valid_consecutive_kline"


def test_live_bars(spark, tmp_path):
    from tidemark.streaming import live

    src, out = str(tmp_path / "in"), "live_bars_test"
    rows = [("s", f"2026-06-01 0{h}:{m}0:00", h * 10 + m, float(m)) for h in range(4) for m in range(6)]
    spark.createDataFrame(rows, "series string, ts string, event_id long, value double").selectExpr("series", "timestamp(ts) ts", "event_id", "value").write.parquet(src)
    stream = spark.readStream.schema("series string, ts timestamp, event_id long, value double").parquet(src)
    q = live.live_bars(stream).writeStream.format("memory").queryName(out).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r["open"], r["close"], r["volume"]) for r in spark.table(out).collect()] == [(0.0, 5.0, 15.0)] * 3
