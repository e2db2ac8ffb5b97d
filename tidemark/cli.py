"""Commands over files: each reads tables, applies operators and writes results that appear whole.

Exit codes: 0 done, 1 results need review, 2 unknown command or bad input, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import epoch_us, from_ms, parse_utc
from .operators import asof, audit, checks, historical, metrics, model, review, split, targets, views
from .plans import manifest, sinks, stages
from .sources import raw_events, rest, tables

STREAM = "btcusdt@kline_1s"  # fixed value: the captured stream
FEATURE_TIMES = ["window_ms", "latest_start_ms", "latest_end_ms"]
VERSION = "1"


def _millis(text: str) -> int:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"timestamp without a zone: {text}")
    return int(at.timestamp() * 1000)


def _klines(spark: SparkSession, a) -> DataFrame:
    return raw_events.closed_klines(raw_events.events(raw_events.read_lines(spark, a.source, a.member)), a.stream)


def _windows(spark: SparkSession, a, klines: DataFrame, name: str) -> DataFrame:
    start, stop, step = _millis(a.start), _millis(a.start) + a.duration_seconds * 1000, a.window_seconds * 1000
    if a.duration_seconds % a.window_seconds or start % step:
        raise ValueError("the interval does not hold whole windows")
    return klines.select("series").distinct().withColumn(name, F.explode(F.sequence(F.lit(start), F.lit(stop - step), F.lit(step))))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_with_day = views.with_day


def _day_counts(rows: DataFrame, **counts) -> list[dict]:
    """Counters of each day; a row for each day comes to the driver."""
    return [r.asDict() for r in views.day_counters(rows, **counts).orderBy("day").collect()]


def _totals(days: list[dict]) -> dict:
    return {"days": len(days)} | {k: sum(d[k] for d in days) for k in (days[0] if days else {}) if k != "day"}


def _stage(spark: SparkSession, a, name: str, inputs: dict[str, str], outputs: dict[str, str | None], build: Callable[[], tuple[bool, dict]], version: str = VERSION) -> int:
    return stages.run(spark, a.report, name, version, inputs, {k: v for k, v in outputs.items() if v}, build)


def _csv(spark: SparkSession, path: str | None, rows: DataFrame, *order: str) -> None:
    if path:
        sinks.write_day_csvs(_with_day(rows), path, "day", list(order) or ["series", "window_ms"])


def _without_days(rows: DataFrame, days: str | None) -> DataFrame:
    """Rows whose UTC day is not on a list of days, divided by commas."""
    return views.without_days(rows, [d.strip() for d in days.split(",")] if days else [])


def do_manifest(spark: SparkSession, a) -> int:
    if sinks.exists(spark, a.output):
        raise FileExistsError(a.output)
    files = tables.file_identity(spark, a.root, recursive=a.recursive)
    made = manifest.zip_records(files) if manifest.layout(files, a.layout) == "zip" else manifest.records(files)
    if made.isEmpty():
        raise ValueError(f"no recognized inputs in {a.root}")
    made.write.mode("errorifexists").parquet(a.output)
    return 0


def do_audit(spark: SparkSession, a) -> int:
    rows = raw_events.events(raw_events.read_lines(spark, a.source, a.member))
    start, stop = _millis(a.start), _millis(a.start) + a.duration_seconds * 1000
    read = spark.read.format("binaryFile").load(a.source).select(F.col("_metadata.file_name").alias("series"))  # contents are not read
    cover = audit.coverage(raw_events.closed_klines(rows, a.stream), start, stop, archives=read)
    found = audit.archive_audit(audit.scan_counts(rows, a.stream, start, stop), cover, read)
    out = found.withColumns({c: epoch_us(F.col(c)) for c in ("first_received", "last_received")}).collect()
    document = {"archives": [r.asDict() for r in out]}
    if (a.output is None) == (a.output_dir is None):
        raise ValueError("name an output or a folder for it")
    target = a.output or f"{a.output_dir}/{sinks.versioned_name('audit', sinks.document_identity(document), VERSION)}.json"
    sinks.write_json(spark, document, target, overwrite=False)
    return 0


def _damaged(spark: SparkSession, records: list) -> dict[str, str]:
    """Groups whose file is not there or not the one of the manifest, with what is wrong."""
    wrong = {r["group_id"]: f"input is missing: {r['path']}" for r in records if not sinks.exists(spark, r["path"])}
    there = [r for r in records if r["group_id"] not in wrong]
    found = {f["path"]: (f["size_bytes"], f["sha256"]) for f in tables.file_identity(spark, [r["path"] for r in there]).collect()} if there else {}
    for r in there:
        if found.get(r["path"]) != (r["size_bytes"], r["sha256"]):
            wrong[r["group_id"]] = f"identity mismatch: expected {(r['size_bytes'], r['sha256'])}, found {found.get(r['path'])}"
    return wrong


def _audit_days(spark: SparkSession, a, records: list) -> None:
    """Audits of whole days, one folder for each group; those of other groups stay as they are."""
    due = spark.createDataFrame([(r["group_id"], r["name"], r["day_ms"]) for r in records], "group_id string, series string, day_ms long")
    rows = raw_events.events(raw_events.read_lines(spark, [r["path"] for r in records])).join(due, "series")
    counts = audit.scan_counts(rows, a.stream, F.col("day_ms"), F.col("day_ms") + 86_400_000)
    klines = raw_events.closed_klines(rows, a.stream).join(due, "series")
    cover = audit.coverage(klines.withColumn("start_ms", F.col("start_ms") - F.col("day_ms")), 0, 86_400_000, archives=due)
    sinks.write_days(audit.archive_audit(counts, cover, due), a.output, "group_id")


def do_batch(spark: SparkSession, a) -> int:
    with sinks.locked(spark, a.manifest):
        done = _batch(spark, a)
    counts = {r["status"]: r["records"] for r in manifest.status_counts(_read(spark, a.manifest)).collect()}
    print(json.dumps({"statuses": counts}, sort_keys=True))
    return done


def _batch(spark: SparkSession, a) -> int:
    """Audits every record that is due in one job over all their files; if that fails, each in one of its own, unless it is to stop.

    Inputs must be those of the manifest before and after. Statuses are written back, so a later run goes on.
    """
    cover = spark.createDataFrame(list(tables.coverage_map(spark, a.coverage).items()), "alias string, start_utc string")
    due = manifest.runnable(manifest.with_coverage(_read(spark, a.manifest), cover), a.force, not a.skip_failed, a.recover_running)
    item = F.coalesce(F.col("inputs")[manifest.CAPTURE], F.col("inputs")[manifest.ZIP])
    day = (epoch_us(parse_utc(F.col("start_utc"))) / 1000).cast("long").alias("day_ms")
    records = due.select("group_id", item["relative_path"].alias("path"), item["name"].alias("name"), item["size_bytes"].alias("size_bytes"), item["sha256"].alias("sha256"), day).collect()
    failed = {r["group_id"]: "no audit input" for r in records if r["path"] is None}
    given = [r for r in records if r["path"] is not None]
    if len({r["name"] for r in given}) < len(given):
        raise ValueError("two due inputs have one name")
    put = lambda states: sinks.replace_table(manifest.with_status(_read(spark, a.manifest), states), a.manifest)
    failed |= _damaged(spark, given)
    work = [r for r in given if r["group_id"] not in failed]
    if not records:
        return 0
    put({r["group_id"]: ("failed", failed[r["group_id"]]) if r["group_id"] in failed else ("running", None) for r in records})
    done: list[str] = []
    try:
        try:
            if work:
                _audit_days(spark, a, work)
        except Exception:  # one bad archive must not stop the others
            if a.stop_on_error:
                raise
            for r in work:
                try:
                    _audit_days(spark, a, [r])
                except Exception as e:
                    failed[r["group_id"]] = str(e)[:500]
        failed |= _damaged(spark, [r for r in work if r["group_id"] not in failed])
        done = [r["group_id"] for r in work if r["group_id"] not in failed]
    finally:
        left = {r["group_id"]: ("interrupted", None) for r in work}
        put(left | {g: ("failed", e) for g, e in failed.items()} | {g: ("completed", None) for g in done})
    for group, error in failed.items():
        print(f"failed {group}: {error}", file=sys.stderr)
    return 1 if failed else 0


def do_feature_view(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        k = _klines(spark, a)
        grid = asof.Grid(1000, a.window_seconds * 1000, a.lookback)
        asof.feature_view(k, _windows(spark, a, k, "decision_ms"), grid).write.mode("overwrite").parquet(a.output)
        made = _read(spark, a.output)
        _csv(spark, a.csv, made)
        days = _day_counts(made, usable=F.col("usable"))
        return True, {"days": days, "totals": _totals(days)}

    return _stage(spark, a, "feature-view", {"source": a.source}, {"output": a.output, "csv": a.csv}, build, f"{VERSION} {a.start} {a.duration_seconds} {a.window_seconds} {a.lookback}")


def do_targets(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        k = _klines(spark, a)
        windows = checks.aligned(_windows(spark, a, k, "window_ms"), "window_ms", a.window_seconds * 1000, "windows")
        targets.targets(k, windows, asof.Grid(1000, a.window_seconds * 1000)).write.mode("overwrite").parquet(a.output)
        made = _read(spark, a.output)
        _csv(spark, a.csv, made)
        flag = lambda name: F.col("target_flag") == name
        days = _day_counts(made, valid=F.col("target_valid"), missing_start=flag("missing_start_boundary"), missing_end=flag("missing_end_boundary"), late_start=flag("valid_target_late_start_boundary"), duplicate=flag("duplicate_boundary_observation"))
        lacking = [r.asDict() for r in review.missing_windows(made, views.KEY, 1000).collect()]
        return True, {"days": days, "totals": _totals(days), "first_missing": lacking}

    return _stage(spark, a, "proxy-targets", {"source": a.source}, {"output": a.output, "csv": a.csv}, build, f"{VERSION} {a.start} {a.duration_seconds} {a.window_seconds}")


def do_recover(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        rows = _read(spark, a.targets)
        fix, about = tables.boundary_report(spark, a.boundaries)
        first = rows.select((F.col("window_end_ms") - F.col("window_ms")).alias("length")).first()
        if first and not a.partial_days:
            checks.counted(_with_day(rows), ["series", "day"], 86_400_000 // first["length"], "target rows")
        targets.recover(rows, fix).write.mode("overwrite").parquet(a.output)
        made = _read(spark, a.output)
        _csv(spark, a.csv, made)
        days = [r.asDict() for r in targets.recovery_counters(made).orderBy("day").collect()]
        taken = made.where("start_source IS NOT NULL").select(F.col("end_interval_ms").alias("boundary_ms")).distinct()
        unused = [r["boundary_ms"] for r in fix.join(taken, "boundary_ms", "left_anti").orderBy("boundary_ms").collect()]
        totals = _totals(days) | {"unused_boundaries": len(unused)}
        good = not (totals.get("review_rows") or unused or about["ambiguous"])
        return good, {"days": days, "totals": totals, "boundaries": about, "unused": unused}

    return _stage(spark, a, "proxy-recover", {"targets": a.targets, "boundaries": a.boundaries}, {"output": a.output, "csv": a.csv}, build)


def do_join(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        features, labels = (_without_days(_read(spark, p), a.exclude_days) for p in (a.features, a.targets))
        views.audit_join(features, labels).write.mode("overwrite").parquet(a.audit)
        joined = _read(spark, a.audit)
        views.model_view(joined).write.mode("overwrite").parquet(a.model)
        kept = _read(spark, a.model)
        checks.in_domain(kept, {"label": ["UP", "DOWN"], "label_source": [targets.SOURCE], "label_definition": [targets.DEFINITION]}, "model rows")
        _csv(spark, a.csv, kept)
        counts = views.join_counters(joined).first().asDict()
        days = _day_counts(joined, eligible=F.col("eligible"), missing_feature=~F.col("feature_present"), missing_target=~F.col("target_present"))
        if a.final:
            sinks.write_whole_csv(joined, f"{a.final}/audit.csv", views.KEY)
            sinks.write_whole_csv(kept, f"{a.final}/model.csv", views.KEY)
        good = not (counts["missing_feature_rows"] or counts["missing_target_rows"])
        return good, {"counters": counts, "days": days, "totals": _totals(days)}

    return _stage(spark, a, "proxy-join", {"features": a.features, "targets": a.targets}, {"audit": a.audit, "model": a.model, "csv": a.csv, "final": a.final}, build)


def do_review(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        if a.join_report:
            stages.gate(spark, a.join_report, "proxy-join", "model", a.model)
        joined, kept = _read(spark, a.audit), _with_day(_read(spark, a.model))
        review.assert_reviewable(kept, "day", views.MODEL_FEATURES)
        checks.unique(kept, views.KEY, "model rows")
        differ = views.key_differences(joined, kept).count()
        lacking = [str(r["day"]) for r in _with_day(joined).select("day").distinct().join(kept.select("day").distinct(), "day", "left_anti").orderBy("day").collect()]
        views.excluded(joined).write.mode("overwrite").parquet(a.excluded)
        days = _day_counts(kept.drop("day"))
        report = {
            "model_rows": kept.count(),
            "keys_that_differ": differ,
            "days_without_rows": lacking,
            "days": days,
            "features": [r.asDict() for r in review.feature_profile(kept, views.MODEL_FEATURES).collect()],
            "labels": [r.asDict() for r in review.label_balance(kept).collect()],
        }
        return not (differ or lacking), report

    return _stage(spark, a, "proxy-review", {"audit": a.audit, "model": a.model}, {"excluded": a.excluded}, build)


def do_split(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        whole = _without_days(_read(spark, a.model), a.exclude_days)
        if a.review_report:
            seen = stages.report_of(spark, a.review_report) or {}
            if seen.get("status") != "completed" or seen.get("inputs", {}).get("model") != stages.identity(spark, a.model):
                raise ValueError(f"{a.review_report} is no completed review of {a.model}")
            if seen.get("model_rows") != _read(spark, a.model).count():
                raise ValueError("the review counts other model rows")
        x = split.by_day_count(_with_day(whole), "day", [a.train_days], ("train", "evaluation"))
        split.assert_disjoint(x, "window_ms")
        x.write.mode("overwrite").partitionBy("part").parquet(a.output)
        made = _read(spark, a.output)
        parts = split.summary(made, "window_ms")
        checks.reconciled(parts, whole.agg(F.count(F.lit(1)).alias("rows")), ["rows"], "parts of the split")
        if a.csv:
            for r in parts.collect():
                _csv(spark, f"{a.csv}/{r['part']}", made.where(F.col("part") == r["part"]).drop("part", "day"))
        days = made.groupBy("part").agg(F.count_distinct("day").alias("days")).collect()
        verified = {"overlap": 0, "rows": {r["part"]: r.asDict() for r in parts.collect()}, "days": {r["part"]: r["days"] for r in days}}
        return True, {"verification": verified}

    return _stage(spark, a, "proxy-split", {"model": a.model}, {"output": a.output, "csv": a.csv}, build, f"{VERSION} {a.train_days} {a.exclude_days}")


def do_baseline(spark: SparkSession, a) -> int:
    def build() -> tuple[bool, dict]:
        x = _read(spark, a.split).withColumn("y", (F.col("label") == "UP").cast("int"))
        if a.split_report:
            seen = stages.gate(spark, a.split_report, "proxy-split", "output", a.split)
            found = {r["part"]: r["rows"] for r in split.summary(x, "window_ms").collect()}
            if {p: r["rows"] for p, r in seen["verification"]["rows"].items()} != found:
                raise ValueError("the split has other rows than its report counts")
        checks.in_domain(x, {"part": ["train", "evaluation"], "label": ["UP", "DOWN"], "label_source": [targets.SOURCE], "label_definition": [targets.DEFINITION]}, "split rows")
        checks.finite(x, views.MODEL_FEATURES, "split rows")
        checks.unique(x, views.KEY, "split rows")
        split.assert_disjoint(x, "window_ms")
        train = x.where("part = 'train'")
        fitted = model.fit(train, views.MODEL_FEATURES)
        columns = [*views.KEY, "part", "label", "predicted_label", "p_up", "correct"]
        model.predict(x, fitted).select(columns).write.mode("overwrite").parquet(a.predictions)
        if a.csv:
            sinks.write_whole_csv(_read(spark, a.predictions).select(columns), a.csv, views.KEY)
        if a.artifact:
            sinks.write_json(spark, fitted.document(), a.artifact)
        scored = x.withColumn("p", fitted.probability())
        prior = train.agg(F.avg("y")).first()[0]
        report = {"model": fitted.document(), "prior": prior, "scaling_fit_on": "train"}
        for part in ("train", "evaluation"):
            rows = scored.where(F.col("part") == part)
            report[part] = metrics.probability_metrics(rows).first().asDict() | metrics.roc_auc(rows).first().asDict()
            report[f"{part}_majority"] = metrics.probability_metrics(rows.withColumn("p", F.lit(prior))).first().asDict()
            report[f"{part}_confusion"] = [r.asDict() for r in metrics.confusion(rows).collect()]
        return True, report

    return _stage(spark, a, "proxy-baseline", {"split": a.split}, {"predictions": a.predictions, "csv": a.csv, "artifact": a.artifact}, build)


def do_predict(spark: SparkSession, a) -> int:
    """Predictions of a stored model."""
    fitted = model.Scaled.of(tables.read_document(spark, a.artifact))
    rows = checks.finite(_read(spark, a.rows), fitted.features, "rows")
    model.predict(rows, fitted).write.mode("errorifexists").parquet(a.output)
    return 0


def do_snapshot(spark: SparkSession, a) -> int:
    k, at = _klines(spark, a), _millis(a.decision)
    out = audit.snapshot(k, at, asof.Grid(lookback=a.lookback)).collect()
    counts = asof.cutoff_cascade(k, at).first().asDict()
    sinks.write_json(spark, {"decision": a.decision, "rows": [r.asDict() for r in out], "counts": counts}, a.output)
    return 0


def do_inspect(spark: SparkSession, a) -> int:
    if a.limit < 1:
        raise ValueError("the limit is at least 1")
    sinks.texts(audit.inspect(_klines(spark, a), a.limit, model_only=a.model_only)).toPandas().to_csv(sys.stdout, index=False)
    return 0


def do_download(spark: SparkSession, a) -> int:
    """A CSV file for each day; days of an earlier run whose file is unchanged are not asked for again."""
    first, last = date.fromisoformat(a.start), date.fromisoformat(a.end)
    config = {"url": a.url, "symbol": a.symbol, "interval": "1m"}
    before = stages.report_of(spark, a.report) if a.report else None
    days = {d["day"]: d for d in before.get("days", [])} if before and before.get("config") == config else {}
    wanted = [(first + timedelta(n)).isoformat() for n in range((last - first).days)]
    due = [d for d in wanted if d not in days or not sinks.exists(spark, days[d]["path"]) or stages.identity(spark, days[d]["path"]) != days[d]["sha256"]]
    put = lambda status: sinks.write_json(spark, {"stage": "historical-download", "status": status, "config": config, "days": [days[d] for d in sorted(days)]}, a.report) if a.report else None
    spark.dataSource.register(rest.KlineSource)
    put("running")
    try:
        for d in due:  # a day is a page or two; each is put in place and reported before the next
            rows = spark.read.format("klines").options(url=a.url, symbol=a.symbol, start=d, end=(date.fromisoformat(d) + timedelta(1)).isoformat(), delay=a.delay).load()
            out = rest.as_minute_bars(rows).withColumn("day", F.lit(d))
            for path in sinks.write_day_csvs(out, a.output, "day", ["open_time_utc"]):
                days[d] = {"day": d, "path": path, "sha256": stages.identity(spark, path), "rows": spark.read.csv(path, header=True).count()}
            put("running")
    except KeyboardInterrupt:
        put("interrupted")
        raise
    except Exception:
        put("failed")
        raise
    put("completed" if all(d in days for d in wanted) else "review")
    return 0 if all(d in days for d in wanted) else 1


def _downloaded(spark: SparkSession, a) -> None:
    """The files must be those of a completed download."""
    seen = stages.report_of(spark, a.download_report) or {}
    if seen.get("status") != "completed" or seen.get("config", {}).get("interval") != "1m":
        raise ValueError(f"{a.download_report} is no report of a completed download of minutes")
    for d in seen["days"]:
        if stages.identity(spark, d["path"]) != d["sha256"]:
            raise ValueError(f"{d['path']} is not what was downloaded")


def _historical(spark: SparkSession, a, plan: historical.Plan, version: str) -> int:
    def build() -> tuple[bool, dict]:
        if a.download_report:
            _downloaded(spark, a)
        rows = historical.dataset(tables.minute_bars(spark, a.bars), plan)
        days = rows.withColumn("day", F.to_date(from_ms(F.col("decision") * 60_000)))
        first = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(a.bars).agg(F.min(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.csv$", 1))).first()[0]
        sinks.write_days(days.where(F.col("day") > F.lit(first).cast("date")), a.audit)  # the first day gives the others their history
        done = spark.read.parquet(a.audit)
        checks.counted(done, ["day"], 1440 // plan.step, "decisions")
        kept = historical.model_view(done.withColumn("series", F.lit("1m")), plan).join(done.select("decision", "day"), "decision")
        if plan is historical.QUARTER_HOUR:
            parts = split.by_day_count(kept, "day", [a.train_days, a.validation_days])
        else:
            parts = split.by_dates(kept, F.col("day"), a.train_end, a.validation_end)
        split.assert_disjoint(parts, "decision").write.mode("overwrite").partitionBy("part").parquet(a.model)
        made = spark.read.parquet(a.model)
        if a.csv:
            sinks.write_day_csvs(done, f"{a.csv}/days", "day", ["decision"])
            sinks.write_whole_csv(done.drop("day"), f"{a.csv}/dataset-audit-v1.csv", ["decision"])
            sinks.write_whole_csv(made.drop("day", "part"), f"{a.csv}/model-ready-v1.csv", ["decision"])
        counts = done.agg(F.count(F.lit(1)).alias("rows"), F.count_if("eligible").alias("eligible")).first().asDict()
        if made.count() != counts["eligible"]:
            raise checks.ConstraintError(f"{made.count()} model rows of {counts['eligible']} eligible ones")
        return True, {"totals": counts, "parts": [r.asDict() for r in split.summary(made, "decision").collect()]}

    return _stage(spark, a, a.command, {"bars": a.bars}, {"audit": a.audit, "model": a.model, "csv": a.csv}, build, f"{VERSION} {version}")


def do_quarter_hour(spark: SparkSession, a) -> int:
    return _historical(spark, a, historical.QUARTER_HOUR, f"{a.train_days} {a.validation_days}")


def do_hourly(spark: SparkSession, a) -> int:
    return _historical(spark, a, historical.HOURLY, f"{a.train_end} {a.validation_end}")


_SOURCE = [("source", {}), ("--member", {}), ("--stream", {"default": STREAM})]
_WINDOWS = [("--start", {"required": True}), ("--duration-seconds", {"type": int, "default": 86_400}), ("--window-seconds", {"type": int, "default": 300})]
_OUT = [("--output", {"required": True})]
_LOOK = [("--lookback", {"type": int, "default": 60})]
_RESUMED = [("--report", {}), ("--csv", {})]
_BARS = [("bars", {}), ("--audit", {"required": True}), ("--model", {"required": True}), ("--download-report", {}), *_RESUMED]
_ARCHIVE = [("--output", {}), ("--output-dir", {})]


def _needed(*names: str) -> list:
    return [(f"--{n}", {"required": True}) for n in names]


COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], int], list]] = {
    "manifest": (do_manifest, [("root", {}), ("--recursive", {"action": "store_true"}), ("--layout", {"choices": ["auto", "grouped-gzip", "zip"], "default": "auto"}), *_OUT]),
    "audit": (do_audit, [*_SOURCE, *_WINDOWS, *_ARCHIVE]),
    "batch": (
        do_batch,
        [*_needed("manifest", "coverage"), *[(f"--{f}", {"action": "store_true"}) for f in ("force", "skip-failed", "recover-running", "stop-on-error")], ("--stream", {"default": STREAM}), *_OUT],
    ),
    "feature-view": (do_feature_view, [*_SOURCE, *_WINDOWS, *_LOOK, *_OUT, *_RESUMED]),
    "day-audit": (do_audit, [*_SOURCE, *_WINDOWS, *_ARCHIVE]),
    "proxy-targets": (do_targets, [*_SOURCE, *_WINDOWS, *_OUT, *_RESUMED]),
    "proxy-recover": (do_recover, [*_needed("targets", "boundaries"), ("--partial-days", {"action": "store_true"}), *_OUT, *_RESUMED]),
    "proxy-join": (do_join, [*_needed("features", "targets", "audit", "model", "report"), ("--csv", {}), ("--final", {}), ("--exclude-days", {})]),
    "proxy-split": (do_split, [*_needed("model"), ("--train-days", {"type": int, "required": True}), ("--exclude-days", {}), ("--review-report", {}), *_OUT, *_RESUMED]),
    "proxy-baseline": (do_baseline, [*_needed("split", "predictions", "report"), ("--csv", {}), ("--artifact", {}), ("--split-report", {})]),
    "proxy-predict": (do_predict, [("rows", {}), *_needed("artifact"), *_OUT]),
    "proxy-review": (do_review, [*_needed("audit", "model", "excluded", "report"), ("--join-report", {})]),
    "snapshot": (do_snapshot, [*_SOURCE, *_needed("decision"), *_LOOK, *_OUT]),
    "inspect": (do_inspect, [*_SOURCE, ("--limit", {"type": int, "default": 10}), ("--model-only", {"action": "store_true"})]),
    "historical-download": (do_download, [*_needed("url", "symbol", "start", "end"), ("--delay", {"default": "0"}), ("--report", {}), *_OUT]),
    "historical-15m": (do_quarter_hour, [*_BARS, ("--train-days", {"type": int, "required": True}), ("--validation-days", {"type": int, "required": True})]),
    "historical-hourly": (do_hourly, [*_BARS, *_needed("train-end", "validation-end")]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        one = sub.add_parser(name)
        for flag, options in arguments:
            one.add_argument(flag, **options)
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return COMMANDS[a.command][0](spark, a)
    except KeyboardInterrupt:
        return 130
    except (ValueError, FileExistsError) as e:
        print(f"tidemark {a.command}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
