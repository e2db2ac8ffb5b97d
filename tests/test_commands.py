"""Stages are taken up again, refuse what was changed, and leave files that others read."""

import csv
import gzip
import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from test_sources import T0, event
from tidemark import cli
from tidemark.operators import model, targets
from tidemark.plans import manifest, sinks, stages
from tidemark.sources import tables

DAY = 86_400_000
STEP = 300_000


def run(spark, *args):
    return cli.main([str(a) for a in args], spark)


def read(path):
    return json.load(open(path))


def proxies(spark, days=3, each=8, first=T0):
    """Feature and target rows of some windows a day, with labels that follow the long return."""
    features, labels = [], []
    for d in range(days):
        for i in range(each):
            w, r = first + d * DAY + i * STEP, ((i * 7 + d * 3) % 11 - 5) / 1000
            features.append(("s", w, r / 2, r, abs(r) / 3 + 1e-6, True, "valid_all_initial_features"))
            up = "UP" if r >= 0 or i == 1 else "DOWN"
            labels.append(("s", w, w + STEP, up, targets.SOURCE, targets.DEFINITION, True, "valid_proxy_target"))
    f = spark.createDataFrame(features, "series string, window_ms long, return_short double, return_long double, volatility double, usable boolean, feature_flag string")
    t = spark.createDataFrame(labels, "series string, window_ms long, window_end_ms long, label string, label_source string, label_definition string, target_valid boolean, target_flag string")
    return f, t


def test_stages_from_join_to_predictions(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    f, t = proxies(spark)
    f.write.parquet(at("f")), t.write.parquet(at("t"))
    join = ["proxy-join", "--features", at("f"), "--targets", at("t"), "--audit", at("a"), "--model", at("m"), "--report", at("j.json"), "--csv", at("days"), "--final", at("final")]
    assert run(spark, *join) == 0
    report = read(at("j.json"))
    assert report["status"] == "completed" and report["totals"] == {"days": 3, "rows": 24, "eligible": 24, "missing_feature": 0, "missing_target": 0}
    assert sorted(p.name for p in (tmp_path / "days").glob("*.csv")) == [f"{datetime.fromtimestamp(T0 / 1000 + d * 86400, UTC):%Y-%m-%d}.csv" for d in range(3)]
    assert len(list(csv.DictReader(open(tmp_path / "final" / "model.csv")))) == 24
    review = ["proxy-review", "--audit", at("a"), "--model", at("m"), "--excluded", at("x"), "--report", at("r.json"), "--join-report", at("j.json")]
    assert run(spark, *review) == 0 and read(at("r.json"))["model_rows"] == 24
    split = ["proxy-split", "--model", at("m"), "--train-days", "2", "--review-report", at("r.json"), "--output", at("s"), "--report", at("s.json"), "--csv", at("parts")]
    assert run(spark, *split) == 0
    assert read(at("s.json"))["verification"]["rows"]["evaluation"]["rows"] == 8 and len(list((tmp_path / "parts" / "train").glob("*.csv"))) == 2
    base = ["proxy-baseline", "--split", at("s"), "--predictions", at("p"), "--report", at("b.json"), "--csv", at("p.csv"), "--artifact", at("fit.json"), "--split-report", at("s.json")]
    assert run(spark, *base) == 0
    rows = list(csv.DictReader(open(at("p.csv"))))
    assert len(rows) == 24 and list(rows[0]) == ["series", "window_ms", "part", "label", "predicted_label", "p_up", "correct"] and len(rows[0]["p_up"].strip("0.")) <= 12
    assert model.Scaled.of(read(at("fit.json"))).document() == read(at("b.json"))["model"]
    assert run(spark, "proxy-predict", at("m"), "--artifact", at("fit.json"), "--output", at("again")) == 0
    mine = {r["window_ms"]: r["p_up"] for r in spark.read.parquet(at("again")).collect()}
    assert all(mine[r["window_ms"]] == pytest.approx(r["p_up"]) for r in spark.read.parquet(at("p")).collect())
    # nothing changed: nothing is built again
    before = (tmp_path / "p.csv").stat().st_mtime_ns
    assert run(spark, *base) == 0 and (tmp_path / "p.csv").stat().st_mtime_ns == before
    # a damaged output is built again
    (tmp_path / "p.csv").write_text("x")
    assert run(spark, *base) == 0 and len(list(csv.DictReader(open(at("p.csv"))))) == 24
    # an input that is not the one its report names is refused
    f.limit(1).selectExpr("series", "window_ms + 1 window_ms", "return_short", "return_long", "volatility", "'UP' label", f"'{targets.SOURCE}' label_source", f"'{targets.DEFINITION}' label_definition").write.mode("append").parquet(at("m"))
    assert run(spark, *review) == 2 and read(at("r.json"))["status"] == "failed"
    assert run(spark, *split) == 2


def test_join_reports_rows_of_one_side_and_excluded_days(spark, tmp_path):
    f, t = proxies(spark, 2, 3)
    at = lambda name: str(tmp_path / name)
    f.where(f"window_ms != {T0}").write.parquet(at("f")), t.write.parquet(at("t"))
    join = ["proxy-join", "--features", at("f"), "--targets", at("t"), "--audit", at("a"), "--model", at("m"), "--report", at("j.json")]
    assert run(spark, *join) == 1 and read(at("j.json"))["status"] == "review" and read(at("j.json"))["totals"]["missing_feature"] == 1
    day = f"{datetime.fromtimestamp(T0 / 1000, UTC):%Y-%m-%d}"
    assert run(spark, *join[:-1], at("k.json"), "--exclude-days", day) == 0 and read(at("k.json"))["totals"]["rows"] == 3


def target(w, flag="valid_proxy_target", start=(100.0, True), end=(101.0, True)):
    seen = datetime(2026, 6, 29, tzinfo=UTC)
    side = lambda x, ms: (x[0], ms, seen) if x and x[1] else (None, None, None)
    good = flag.startswith("valid")
    return ("s", w, w + STEP, *side(start, w - 1000), *side(end, w + STEP - 1000), seen if good else None, "UP" if good else None, targets.SOURCE, targets.DEFINITION, good, flag)


TARGET = (
    "series string, window_ms long, window_end_ms long, start_price double, start_interval_ms long, start_available_at timestamp, end_price double, end_interval_ms long, "
    "end_available_at timestamp, target_available_at timestamp, label string, label_source string, label_definition string, target_valid boolean, target_flag string"
)


def overrides(spark, *rows):
    seen = datetime(2026, 6, 30, tzinfo=UTC)
    return spark.createDataFrame([(ms, day, close, seen, "g/f") for ms, day, close in rows], "boundary_ms long, target_day string, close double, available_at timestamp, source string")


def test_a_repaired_end_starts_the_next_window(spark):
    w = [T0 + i * STEP for i in range(5)]
    lack = dict(flag="missing_end_boundary", end=None)
    rows = [target(w[0]), target(w[1], start=None, **lack), target(w[2], start=None, **lack), target(w[3], start=None, **lack), target(w[4], start=None, **lack)]
    x = spark.createDataFrame(rows, TARGET)
    fix = overrides(spark, (w[1] + STEP - 1000, "2026-06-29", 102.0), (w[2] + STEP - 1000, "2026-06-29", 99.0), (w[4] + STEP - 1000, "2026-06-29", 98.0))
    r = {y["window_ms"]: y for y in targets.recover(x, fix).collect()}
    assert [r[i]["start_source"] for i in w] == [None, "previous_window_end", "previous_window_end", None, None]
    assert (r[w[1]]["start_price"], r[w[1]]["label"], r[w[2]]["start_price"], r[w[2]]["label"]) == (101.0, "UP", 102.0, "DOWN")
    assert r[w[4]]["needs_review"] and not r[w[3]]["needs_review"] and r[w[2]]["start_interval_ms"] == w[2] - 1000
    counts = targets.recovery_counters(targets.recover(x, fix)).first()
    assert (counts["rows"], counts["recovered_rows"], counts["review_rows"]) == (5, 2, 1)
    # the day before lends nothing, and a boundary of another day stops
    late = [target(T0 + DAY - STEP), target(T0 + DAY, start=None, **lack)]
    fix = overrides(spark, (T0 + DAY + STEP - 1000, "2026-06-30", 99.0))
    assert [y["needs_review"] for y in targets.recover(spark.createDataFrame(late, TARGET), fix).orderBy("window_ms").collect()] == [False, True]
    with pytest.raises(Exception, match="a boundary is of"):
        targets.recover(x, overrides(spark, (w[1] + STEP - 1000, "2026-06-28", 102.0))).collect()


def test_recover_command_reviews_ambiguous_and_unused_boundaries(spark, tmp_path):
    rows = [target(T0 + i * STEP) for i in range(287)] + [target(T0 + 287 * STEP, flag="missing_end_boundary", end=None)]
    spark.createDataFrame(rows, TARGET).write.parquet(str(tmp_path / "t"))
    entry = lambda ms, n: {"target_day": "2026-06-29", "boundary_start_ms": ms, "recoverable": n > 0, "sources": [{"source_group": "g", "source_file": str(i), "close": "99.5", "received_at_utc": "2026-06-30T00:00:00Z"} for i in range(n)]}
    last = T0 + DAY - 1000
    a = ["proxy-recover", "--targets", tmp_path / "t", "--boundaries", tmp_path / "b.json", "--output", tmp_path / "o", "--report", tmp_path / "r.json"]
    (tmp_path / "b.json").write_text(json.dumps([entry(last, 1)]))
    assert run(spark, *a) == 0 and read(tmp_path / "r.json")["totals"] == {"days": 1, "rows": 288, "recovered_rows": 1, "review_rows": 0, "unused_boundaries": 0}
    (tmp_path / "b.json").write_text(json.dumps([entry(last, 2)]))
    assert run(spark, *a) == 1 and len(read(tmp_path / "r.json")["boundaries"]["ambiguous"]) == 1
    (tmp_path / "b.json").write_text(json.dumps([entry(last, 1), entry(T0 + 999, 1)]))
    assert run(spark, *a) == 1 and read(tmp_path / "r.json")["unused"] == [T0 + 999]
    spark.createDataFrame(rows[1:], TARGET).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert run(spark, *a) == 2  # a day without its 288 rows


def test_batch_locks_retries_and_recovers(spark, tmp_path):
    root, m = tmp_path / "in", str(tmp_path / "m")
    root.mkdir()
    (root / "binance_raw_events_2026-06-29.jsonl.gz").write_bytes(gzip.compress(event(T0).encode()))
    assert run(spark, "manifest", root, "--output", m) == 0
    (tmp_path / "c.json").write_text(json.dumps({"2026-06-29": "2026-06-29T00:00:00Z"}))
    a = ["batch", "--manifest", m, "--coverage", tmp_path / "c.json", "--output", tmp_path / "o"]
    (tmp_path / "m.lock").write_text("")
    assert run(spark, *a) == 2
    (tmp_path / "m.lock").unlink()
    put = lambda status: sinks.replace_table(manifest.with_status(spark.read.parquet(m), {"group-2026-06-29": (status, None)}), m)
    state = lambda: spark.read.parquet(m).first()["status"]
    put("failed")
    assert run(spark, *a, "--skip-failed") == 0 and state() == "failed"
    put("running")
    assert run(spark, *a) == 2 and run(spark, *a, "--recover-running") == 0 and state() == "completed"
    assert not (tmp_path / "m.lock").exists()


def test_audit_names_its_own_file(spark, tmp_path):
    p = tmp_path / "binance_raw_events_2026-06-29.jsonl.gz"
    p.write_bytes(gzip.compress(event(T0).encode()))
    a = ["audit", p, "--start", "2026-06-29T00:00:00Z", "--duration-seconds", "2"]
    assert run(spark, *a, "--output-dir", tmp_path / "out") == 0 and run(spark, *a) == 2
    assert [x.name.startswith("audit_") for x in (tmp_path / "out").glob("*.json")] == [True]


class Exchange(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        first, end = int(q["startTime"]), int(q["endTime"])
        self.asked.append(first)
        rows = [[t, "100.1", "101", "99", "100.5", "7", t + 59_999, "1", 3, "1", "1", "0"] for t in range(first, min(end + 1, first + 60_000 * int(q["limit"])), 60_000)]
        body = json.dumps(rows).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_downloads_go_on_and_feed_the_dataset(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Exchange)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        a = ["historical-download", "--url", f"http://127.0.0.1:{server.server_port}/k", "--symbol", "X", "--start", "2026-06-01", "--output", tmp_path / "bars", "--report", tmp_path / "d.json"]
        assert run(spark, *a, "--end", "2026-06-02") == 0
        n = len(Exchange.asked)
        assert run(spark, *a, "--end", "2026-06-05") == 0 and len(Exchange.asked) > n and min(Exchange.asked[n:]) >= 1_780_358_400_000
        n = len(Exchange.asked)
        assert run(spark, *a, "--end", "2026-06-05") == 0 and len(Exchange.asked) == n
    finally:
        server.shutdown()
    assert [d["rows"] for d in read(tmp_path / "d.json")["days"]] == [1440] * 4
    b = ["historical-15m", tmp_path / "bars", "--audit", tmp_path / "a", "--model", tmp_path / "m", "--train-days", 1, "--validation-days", 1, "--download-report", tmp_path / "d.json", "--report", tmp_path / "h.json"]
    assert run(spark, *b) == 0 and read(tmp_path / "h.json")["totals"] == {"rows": 288, "eligible": 288}
    one = tmp_path / "bars" / "2026-06-02.csv"
    one.write_text(one.read_text().replace("100.5", "100.6", 1))
    assert run(spark, *b) == 2


def test_identities_and_reports(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("1")
    first = stages.identity(spark, str(tmp_path / "x"))
    (tmp_path / "x" / "a.csv").write_text("2")
    assert first != stages.identity(spark, str(tmp_path / "x")) and stages.identity(spark, str(tmp_path / "none")) is None
    (tmp_path / "r.json").write_text("{broken")
    assert stages.report_of(spark, str(tmp_path / "r.json")) is None
    with pytest.raises(ValueError):
        stages.gate(spark, str(tmp_path / "r.json"), "s", "o", str(tmp_path / "x"))


def test_group_identity_is_that_of_a_document(spark):
    files = spark.createDataFrame([("d/binance_raw_events_2026-06-29.jsonl.gz", "binance_raw_events_2026-06-29.jsonl.gz", 5, "ab")], "path string, name string, size_bytes long, sha256 string")
    r = manifest.records(files).first()
    assert r["identity"] == sinks.document_identity({"binance_raw": {"relative_path": "d/binance_raw_events_2026-06-29.jsonl.gz", "size_bytes": 5, "sha256": "ab"}})
    assert {x["status"]: x["records"] for x in manifest.status_counts(manifest.records(files)).collect()} == {"pending": 1}


def test_minutes_of_a_file_must_ascend(spark, tmp_path):
    head = ",".join(tables.MINUTE_BARS.names)
    row = lambda m: f"2026-06-01T00:0{m}:00.000Z,1,1,1,1,1,2026-06-01T00:0{m}:59.999Z,1,1,1,1"
    (tmp_path / "2026-06-01.csv").write_text("\n".join([head, row(1), row(0)]))
    with pytest.raises(ValueError, match="do not ascend"):
        tables.minute_bars(spark, str(tmp_path))
