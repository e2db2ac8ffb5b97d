"""Batch audits cover every due record, check inputs against the manifest and leave statuses behind."""

import gzip
import json
import zipfile

import pytest

from test_sources import T0, event
from tidemark import cli
from tidemark.operators import audit

DAY = "2026-06-29"


def statuses(spark, path):
    return {r["group_id"]: r["status"] for r in spark.read.parquet(path).collect()}


def cover(tmp_path, **days):
    p = tmp_path / "cover.json"
    p.write_text(json.dumps(days))
    return str(p)


def test_batch_covers_outages_and_rejects_replaced_files(spark, tmp_path):
    root, m, out = tmp_path / "in", str(tmp_path / "m"), str(tmp_path / "out")
    root.mkdir()
    file = lambda d: root / f"binance_raw_events_2026-06-{d}.jsonl.gz"
    file(29).write_bytes(gzip.compress("\n".join([event(T0), event(T0 + 1000), "{bad"]).encode()))
    file(30).write_bytes(gzip.compress(event(T0).encode()))  # nothing inside its day
    file(28).write_bytes(gzip.compress(event(T0 - 86_400_000).encode()))
    assert cli.main(["manifest", str(root), "--output", m], spark) == 0
    whole = file(28).read_bytes()
    file(28).write_bytes(whole + b"x")
    a = ["batch", "--manifest", m, "--coverage", cover(tmp_path, **{f"2026-06-{d}": f"2026-06-{d}T00:00:00Z" for d in (28, 29, 30)}), "--output", out]
    assert cli.main(a, spark) == 1
    assert statuses(spark, m) == {"group-2026-06-28": "failed", "group-2026-06-29": "completed", "group-2026-06-30": "completed"}
    rows = {r["group_id"]: r for r in spark.read.parquet(out).collect()}
    assert {g: r["missing_starts"] for g, r in rows.items()} == {"group-2026-06-29": 86_398, "group-2026-06-30": 86_400}
    assert rows["group-2026-06-29"]["malformed"] == 1 and rows["group-2026-06-30"]["closed_klines"] == 1
    file(28).write_bytes(whole)
    assert cli.main(a, spark) == 0 and set(statuses(spark, m).values()) == {"completed"}
    assert spark.read.parquet(out).count() == 3


def test_zip_archives_are_records(spark, tmp_path):
    root, m, out = tmp_path / "in", str(tmp_path / "m"), str(tmp_path / "out")
    root.mkdir()
    with zipfile.ZipFile(root / "day.zip", "w") as z:
        z.writestr(f"binance_raw_events_{DAY}.jsonl.gz", gzip.compress(event(T0).encode()))
    assert cli.main(["manifest", str(root), "--output", m], spark) == 0
    a = ["batch", "--manifest", m, "--coverage", cover(tmp_path, **{"day.zip": f"{DAY}T00:00:00Z"}), "--output", out]
    assert cli.main(a, spark) == 0 and spark.read.parquet(out).first()["missing_starts"] == 86_399
    (root / f"binance_raw_events_{DAY}.jsonl.gz").write_bytes(b"x")
    assert cli.main(["manifest", str(root), "--output", m + "2"], spark) == 2


def test_coverage_keeps_archives_without_klines_inside(spark):
    x = spark.createDataFrame([("a", 1, 5000)], "series string, line_no long, start_ms long")
    r = audit.coverage(x, 0, 3000).first()
    assert (r["series"], r["in_window"], r["missing_starts"], r["largest_gap_ms"]) == ("a", 0, 3, 0)
    assert audit.coverage_totals(audit.coverage(x, 0, 3000)).first()["missing_starts"] == 3
