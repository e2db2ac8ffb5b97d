"""Registered queries over files: each writes the driver's tables as the files that a source reads, and reads them again."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from urllib.parse import parse_qs, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import events as ev
from .functions.time import epoch_us, iso_us
from .operators import audit, checks, model, review, split, views
from .plans import manifest, sinks
from .plans.scratch import scratch
from .queries import AUDIT, DAY0, DAYS30, FLAGS, TARGET, H, VIEW, _audit, _days, _features, _targets, micros, query, rounded
from .sources import raw_events, rest, tables

# --- captures ----------------------------------------------------------------------------

#: A line of every kind that a capture may hold, by the last digit of the id: cut off, no object, a flag that is a text, an open
#: kline, no stream, blank; the rest are closed klines.
RAW = """c0 AS (SELECT event_id, event_type AS file, event_id % 10 AS kind, epoch_us(ts) AS us, value FROM events WHERE event_id % 10 != 5),
raw AS (SELECT file AS series, row_number() OVER (PARTITION BY file ORDER BY event_id) AS nth, kind IN (0, 1) AS malformed,
  CASE WHEN kind NOT IN (0, 1, 4) THEN 'k@' || file END AS stream, CASE WHEN kind NOT IN (0, 1) THEN us END AS received_us, kind NOT IN (0, 1, 2, 3) AS closed,
  CASE WHEN kind NOT IN (0, 1) THEN us // 1000 END AS start_ms, CASE WHEN kind NOT IN (0, 1) THEN us // 1000 + 999 END AS end_ms, CASE WHEN kind NOT IN (0, 1) THEN value END AS close FROM c0)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured lines, read from a packed file for each event type."""
    e = ev.table(spark, sf_dir, "events")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 10
    start = F.floor(epoch_us(ts) / 1000).cast("string")
    stream = F.when(kind == 4, F.lit("")).otherwise(F.concat(F.lit('"stream": "k@'), F.col("event_type"), F.lit('", ')))
    closed = F.when(kind == 2, F.lit('"true"')).when(kind == 3, F.lit("false")).otherwise(F.lit("true"))
    parts = ['{', stream, '"received_at_utc": "', iso_us(ts), '", "raw_event": {"k": {"t": ', start, ', "T": ', (F.floor(epoch_us(ts) / 1000) + 999).cast("string"), ', "c": "', F.col("value").cast("string"), '", "x": ', closed, "}}}"]
    whole = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = F.when(kind == 0, F.substring(whole, 1, 20)).when(kind == 1, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 5, F.lit(" ")).otherwise(whole)
    paths = sinks.write_line_files(e.select(F.col("event_type").alias("name"), line.alias("line"), "event_id"), scratch(spark, "captures"), "name", "line", ["event_id"])
    return raw_events.read_lines(spark, paths)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = raw_events.events(_lines(spark, sf_dir))
    return x.withColumn("series", F.regexp_replace("series", r"\.jsonl\.gz$", ""))


@query(f"WITH {RAW} SELECT * FROM raw")
def captured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("series").orderBy("line_no"))
    return _raw(spark, sf_dir).select("series", nth.cast("long").alias("nth"), "malformed", "stream", epoch_us(F.col("received_at")).alias("received_us"), "closed", "start_ms", "end_ms", "close")


@query(
    f"""WITH {RAW} SELECT series, count(*) FILTER (malformed) AS malformed, count(*) FILTER (NOT malformed) AS records_scanned, count(*) FILTER (stream = 'k@click') AS kline_records,
    count(*) FILTER (stream = 'k@click' AND closed) AS closed_klines, count(*) FILTER (stream = 'k@click' AND closed AND start_ms >= {DAY0} AND start_ms < {DAYS30}) AS in_window,
    arg_min(received_us, nth) FILTER (NOT malformed) AS first_received, arg_max(received_us, nth) FILTER (NOT malformed) AS last_received FROM raw GROUP BY series"""
)
def captured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micros(audit.scan_counts(_raw(spark, sf_dir), "k@click", DAY0, DAYS30), "first_received", "last_received")


@query(f"WITH {RAW} SELECT coalesce(stream, '<missing>') AS stream, count(*) AS records FROM raw WHERE NOT malformed GROUP BY 1")
def captured_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stream_counts(_raw(spark, sf_dir))


@query(f"WITH {RAW} SELECT series, nth, start_ms, end_ms, close, received_us AS available_us FROM raw WHERE stream = 'k@view' AND closed")
def captured_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _raw(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("series").orderBy("line_no")).cast("long"))
    kept = raw_events.closed_klines(x, "k@view").join(x.select("series", "line_no", "nth"), ["series", "line_no"])
    return kept.select("series", "nth", "start_ms", "end_ms", "close", epoch_us(F.col("available_at")).alias("available_us"))


# --- tables in text ----------------------------------------------------------------------

MINUTES = """o AS (SELECT epoch_us(ts) // 60000000 AS t, arg_min(value, epoch_us(ts) * 128 + event_id % 128) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, epoch_us(ts) * 128 + event_id % 128) AS close, sum(value) AS volume, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"""


def _minute_files(spark: SparkSession, sf_dir: str) -> str:
    """A file of minutes for each day, in the columns of the exchange's minute table."""
    e = ev.table(spark, sf_dir, "events").where("value IS NOT NULL")
    us = epoch_us(F.col("ts"))
    at = us * 128 + F.col("event_id") % 128
    o = e.groupBy((F.floor(us / 60_000_000) * 60_000_000).alias("us")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("trade_count")
    )
    start = F.timestamp_micros("us")
    rows = o.withColumns({"open_time_utc": start, "close_time_utc": F.timestamp_micros(F.col("us") + 59_999_000), "quote_volume": F.lit(0.0), "taker_buy_base_volume": F.lit(0.0), "taker_buy_quote_volume": F.lit(0.0)})
    path = scratch(spark, "minutes")
    sinks.write_day_csvs(rows.select(F.to_date(start).alias("day"), *tables.MINUTE_BARS.names), path, "day", ["open_time_utc"])
    return path


@query(f"WITH {MINUTES} SELECT '1m' AS series, t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM o")
def minute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.minute_bars(spark, _minute_files(spark, sf_dir)), 6)


@query(f"WITH {MINUTES} SELECT strftime(make_timestamp(t * 60000000), '%Y-%m-%d') || '.csv' AS file, count(*) AS rows FROM o GROUP BY 1")
def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_exact(spark, _minute_files(spark, sf_dir), tables.MINUTE_BARS)
    return rows.groupBy(F.col("file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def superset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a whole table in one file that has more."""
    path = scratch(spark, "whole") + "/events.csv"
    sinks.write_whole_csv(ev.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value"), path, ["event_id"])
    return tables.read_superset(spark, path, ["event_id", "event_type"])


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(format('{:.12g}', value), '') AS value, CASE WHEN event_type = 'click' THEN 'true' ELSE 'false' END AS is_click,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts, '' AS nothing FROM events"""
)
def text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.table(spark, sf_dir, "events")
    return sinks.texts(e.select("event_id", "value", (F.col("event_type") == "click").alias("is_click"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("nothing")))


@query("SELECT event_type || '.txt' AS name, CAST(octet_length(encode(string_agg(event_id || chr(10), '' ORDER BY event_id))) AS BIGINT) AS size_bytes, sha256(string_agg(event_id || chr(10), '' ORDER BY event_id)) AS sha256 FROM events GROUP BY event_type")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "identity")
    e = ev.table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("string").alias("line"), "event_id")
    sinks.write_line_files(e, path, "event_type", "line", ["event_id"], ".txt")
    return tables.file_identity(spark, path, "*.txt").select("name", "size_bytes", "sha256")


@query("SELECT event_type AS stream, count(*) AS records FROM events GROUP BY 1")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that went through a report; a second report of the same name is refused."""
    path = scratch(spark, "report") + ".json"
    counts = audit.stream_counts(ev.table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.lit(False).alias("malformed")))
    sinks.write_json(spark, {r["stream"]: r["records"] for r in counts.collect()}, path)
    try:
        sinks.write_json(spark, {}, path, overwrite=False)
        raise AssertionError("a report was overwritten")
    except FileExistsError:
        pass
    return spark.createDataFrame(sorted(tables.read_document(spark, path).items()), "stream string, records long")


# --- pages of an exchange ----------------------------------------------------------------


def _page(url: str) -> bytes:
    """What an exchange would answer: a kline for every minute but each seventh, a thousand at most."""
    q = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items() if v[0].isdigit()}
    minutes = range(q["startTime"] // 60_000, q["endTime"] // 60_000 + 1)
    rows = [[m * 60_000, str(m % 97), str(m % 97 + 2), str(m % 97 - 1), str(m % 97 + 1), "5", m * 60_000 + 59_999, "1", m % 11, "1", "1", "0"] for m in minutes if m % 7]
    return json.dumps(rows[: q["limit"]]).encode()


@query(
    """WITH d AS (SELECT DISTINCT epoch_us(ts) // 86400000000 AS day FROM events), m AS (SELECT unnest(generate_series(day * 1440, day * 1440 + 1439)) AS m FROM d)
    SELECT m * 60000 AS open_ms, CAST(m % 97 AS VARCHAR) AS open, CAST(m % 97 + 2 AS VARCHAR) AS high, CAST(m % 97 - 1 AS VARCHAR) AS low, CAST(m % 97 + 1 AS VARCHAR) AS close, '5' AS volume,
    m * 60000 + 59999 AS close_ms, m % 11 AS trade_count FROM m WHERE m % 7 != 0"""
)
def exchange_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every day of the table, asked for one after another by address."""
    fields = rest.SCHEMA
    names = [f.split()[0] for f in fields.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                day = date(1970, 1, 1) + timedelta(n)
                rows = rest.normalised(rest.fetch_day("http://exchange/klines", "X", day, _page), day)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    days = ev.table(spark, sf_dir, "events").select(F.floor(epoch_us(F.col("ts")) / 86_400_000_000).alias("day")).distinct()
    return days.mapInArrow(work, fields).select("open_ms", "open", "high", "low", "close", "volume", "close_ms", "trade_count")


# --- manifests ---------------------------------------------------------------------------

#: Files as a capture folder would hold them: three roles, one of them lacking on every third day, and a file of no role.
FILES = """days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(epoch_us(ts) // 86400000000) AS number FROM events GROUP BY 1),
files AS (SELECT day, role, name, 'in/' || name AS path, n + k AS size_bytes, sha256(name) AS sha256 FROM (
  SELECT day, n, 1 AS k, 'binance_raw' AS role, 'binance_raw_events_' || day || '.jsonl.gz' AS name FROM days UNION ALL
  SELECT day, n, 2, 'polymarket_raw', 'polymarket_raw_events_' || day || '.jsonl.gz' FROM days WHERE number % 3 != 0 UNION ALL
  SELECT day, n, 3, 'recorder_log', 'recorder.log.' || day || '.gz' FROM days)),
records AS (SELECT day, 'group-' || day AS group_id, string_agg(role, ',' ORDER BY role) AS roles, CASE WHEN count(*) < 3 THEN 'polymarket_raw' ELSE '' END AS missing,
  sha256('{' || string_agg('"' || role || '":{"relative_path":"' || path || '","sha256":"' || sha256 || '","size_bytes":' || size_bytes || '}', ',' ORDER BY role) || '}') AS identity FROM files GROUP BY day)"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ev.table(spark, sf_dir, "events").groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.floor(epoch_us(F.col("ts")) / 86_400_000_000)).alias("number")
    )
    kinds = F.filter(
        F.array(
            F.struct(F.concat(F.lit("binance_raw_events_"), "day", F.lit(".jsonl.gz")).alias("name"), F.lit(1).alias("k")),
            F.when(F.col("number") % 3 != 0, F.struct(F.concat(F.lit("polymarket_raw_events_"), "day", F.lit(".jsonl.gz")).alias("name"), F.lit(2).alias("k"))),
            F.struct(F.concat(F.lit("recorder.log."), "day", F.lit(".gz")).alias("name"), F.lit(3).alias("k")),
            F.struct(F.concat(F.lit("binance_kline_1s_"), "day", F.lit(".csv.gz")).alias("name"), F.lit(4).alias("k")),
        ),
        lambda f: f.isNotNull(),
    )
    files = days.select("day", "n", F.explode(kinds).alias("f"))
    name = F.col("f.name")
    return manifest.records(files.select(F.concat(F.lit("in/"), name).alias("path"), name.alias("name"), (F.col("n") + F.col("f.k")).alias("size_bytes"), F.sha2(name, 256).alias("sha256")))


@query(f"WITH {FILES} SELECT day, group_id, roles, missing, identity, 'pending' AS status FROM records")
def manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    roles, missing = F.array_join(F.array_sort(F.map_keys("inputs")), ","), F.array_join(F.array_sort("missing_input_roles"), ",")
    return m.select("day", "group_id", roles.alias("roles"), missing.alias("missing"), "identity", "status")


@query(f"WITH {FILES} SELECT role, count(*) AS records FROM files GROUP BY 1")
def manifest_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.role_counts(_manifest(spark, sf_dir))


#: Starts of captures, named by the group, a file or the day in turn; every fifth day has none.
COVERED = f"""{FILES}, covered AS (SELECT r.*, d.number, CASE WHEN d.number % 5 != 0 THEN day || 'T00:00:00Z' END AS start_utc FROM records r JOIN days d USING (day))"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    number = F.unix_date(F.col("day").cast("date"))
    alias = F.when(number % 3 == 0, F.col("group_id")).when(number % 3 == 1, F.concat(F.lit("in/recorder.log."), "day", F.lit(".gz"))).otherwise(F.col("day"))
    starts = m.where(number % 5 != 0).select(alias.alias("alias"), F.concat("day", F.lit("T00:00:00Z")).alias("start_utc"))
    return manifest.with_coverage(m, starts)


@query(f"WITH {COVERED} SELECT day, start_utc FROM covered")
def manifest_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("day", "start_utc")


STATUS = "CASE number % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'interrupted' END"


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.unix_date(F.col("day").cast("date")) % 4
    status = F.when(number == 0, "pending").when(number == 1, "completed").when(number == 2, "failed").otherwise("interrupted")
    return _covered(spark, sf_dir).where("start_utc IS NOT NULL").withColumn("status", status)


@query(f"WITH {COVERED} SELECT day, {STATUS} AS status FROM covered WHERE start_utc IS NOT NULL AND number % 4 IN (0, 3)")
def manifest_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a batch works on which leaves failed ones alone."""
    return manifest.runnable(_stated(spark, sf_dir), retry_failed=False).select("day", "status")


@query(f"WITH {COVERED} SELECT {STATUS} AS status, count(*) AS records FROM covered WHERE start_utc IS NOT NULL GROUP BY 1")
def manifest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.status_counts(_stated(spark, sf_dir))


@query(f"WITH {FILES} SELECT day, roles FROM records WHERE day = (SELECT max(day) FROM days)")
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one record that has the last day's log."""
    m = _manifest(spark, sf_dir)
    last = m.agg(F.max("day")).first()[0]
    found = manifest.find(m, f"recorder.log.{last}.gz") if last else m
    return found.select("day", F.array_join(F.array_sort(F.map_keys("inputs")), ",").alias("roles"))


# --- reviews -----------------------------------------------------------------------------


@query(f"WITH {VIEW} SELECT series, window_ms, short_flag, long_flag, volatility_flag, feature_flag FROM features WHERE NOT usable")
def unusable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.unusable_rows(_features(spark, sf_dir), FLAGS, views.KEY)


@query(f"WITH {H}, {TARGET} SELECT target_flag, series, window_ms FROM targets WHERE NOT target_valid")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.missing_windows(_targets(spark, sf_dir), views.KEY)


@query("SELECT value FROM events WHERE value IS NOT NULL")
def value_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sorted_values(ev.table(spark, sf_dir, "events"), "value")


@query(
    f"""WITH {AUDIT} SELECT strftime(make_timestamp(window_ms * 1000), '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (eligibility_reason = 'eligible') AS eligible,
    count(*) FILTER (NOT feature_ok) AS invalid_feature, count(*) FILTER (NOT target_ok) AS invalid_target FROM audit GROUP BY 1"""
)
def join_day_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.day_counters(_audit(spark, sf_dir), eligible=F.col("eligible"), invalid_feature=~F.col("feature_ok"), invalid_target=~F.col("target_ok"))


@query(f"WITH {AUDIT} SELECT series, window_ms, label FROM audit WHERE eligibility_reason = 'eligible' AND window_ms // 86400000 NOT IN (19723 + 3, 19723 + 9)")
def without_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model view without two days that a list excludes."""
    return views.without_days(views.model_view(_audit(spark, sf_dir)), ["2024-01-04", "2024-01-10"]).select("series", "window_ms", "label")


@query(
    f"""WITH {AUDIT}, v AS (SELECT *, dense_rank() OVER (ORDER BY window_ms // 86400000) AS rank FROM audit WHERE eligibility_reason = 'eligible')
    SELECT round(avg(return_short), 9) AS m0, round(avg(return_long), 9) AS m1, round(avg(volatility), 9) AS m2, round(stddev_pop(return_short), 9) AS d0, round(stddev_pop(return_long), 9) AS d1,
    round(stddev_pop(volatility), 9) AS d2 FROM v WHERE rank <= 20"""
)
def train_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What features are scaled by: fitted to the training days alone."""
    x = split.by_day_count(_days(spark, sf_dir), "day", [20], ("train", "evaluation"))
    return rounded(model.scaling(x.where("part = 'train'"), views.MODEL_FEATURES))


@query(f"WITH {H}, {TARGET} SELECT series, window_ms, label FROM targets WHERE target_valid")
def checked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid targets that have passed every constraint of a model input: aligned, unique, in order, finite, of known labels."""
    x = _targets(spark, sf_dir).where("target_valid")
    checks.aligned(x, "window_ms", ev.GRID.window_ms)
    checks.unique(x, views.KEY)
    checks.ordered(x, "window_ms", "window_ms", ["series"], width=86_400_000)
    checks.finite(x, ["start_price", "end_price"])
    checks.in_domain(x, {"label": ["UP", "DOWN"], "label_source": ["kline_proxy"], "label_definition": ["end_price_gte_start_price"]})
    parts = x.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    checks.reconciled(parts, x.agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    return x.select("series", "window_ms", "label")
