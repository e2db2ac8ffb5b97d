"""Registered queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import events as ev
from .functions.time import canonical_key, epoch_ms, epoch_us, iso_ms, iso_plain, iso_us
from .operators import asof, audit, bars, checks, historical, metrics, model, review, sets, split, targets, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PLAN = historical.Plan((1, 5, 15, 30), (5, 15), 15, False, step=1, block=168)
LONG_PLAN = historical.Plan((1, 5, 15, 30, 60), (5, 15, 60), 60, True, step=1, block=168)
FLAGS = ["short_flag", "long_flag", "volatility_flag"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: epoch_us(F.col(c)) for c in columns})


# --- SQL building blocks -----------------------------------------------------------------

E = "e AS (SELECT event_id, event_type AS series, epoch_us(ts) AS us, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
M = f"""{E}, m AS (SELECT series, (us + k * 10000000) * 128 + event_id % 128 AS line_no, us // 60000000 * 60000 AS start_ms,
  us // 60000000 * 60000 + 59999 AS end_ms, value AS close, us + k * 10000000 AS avail FROM e)"""
B = f"""{E}, b AS (SELECT series, us // 3600000000 AS t, arg_min(value, us) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, us) AS close, sum(value) AS volume, count(*) AS n FROM e GROUP BY ALL)"""
H = f"""{E}, h0 AS (SELECT series, us // 3600000000 * 3600000 AS start_ms, arg_max(value, us) AS close, max(us) AS us, arg_max(k, us) AS k FROM e GROUP BY series, us // 3600000000),
h AS (SELECT series, start_ms, start_ms + 3599999 AS end_ms, close, us + k * 10000000 AS avail, (us + k * 10000000) * 2 + copy AS line_no
  FROM h0, (VALUES (1), (2)) c(copy) WHERE copy = 1 OR k = 7),
p AS (SELECT series, start_ms, any_value(end_ms) AS end_ms, any_value(close) AS close, any_value(avail) AS avail, count(*) AS copies FROM h GROUP BY series, start_ms),
d AS (SELECT series, unnest(generate_series(min(start_ms) // 14400000 * 14400000, max(start_ms), 14400000)) AS d FROM h GROUP BY series)"""
REASON = """CASE WHEN copies IS NULL THEN 'missing_kline' WHEN copies > 1 THEN 'duplicate_kline'
  WHEN end_ms > d THEN 'incomplete_at_cutoff' WHEN avail // 1000 > d THEN 'received_after_cutoff' END"""
ASOF = f"""{H}, q AS (SELECT d.series, d.d, max(struct_pack(s := p.start_ms, e := p.end_ms, c := p.close, a := p.avail))
    FILTER (p.copies = 1 AND p.end_ms <= d.d AND p.avail // 1000 <= d.d) AS l FROM d LEFT JOIN p ON p.series = d.series AND p.start_ms < d.d GROUP BY ALL),
f AS (SELECT series, min(start_ms) AS s0 FROM p GROUP BY series),
z AS (SELECT q.series, q.d, q.l, CASE WHEN l IS NULL THEN CASE WHEN s0 < q.d THEN (SELECT {REASON} FROM p WHERE p.series = q.series AND p.start_ms = f.s0) ELSE 'missing_latest_kline' END END AS lf
  FROM q JOIN f USING (series))"""
VIEW = f"""{ASOF}, y AS (SELECT z.series, z.d, w.s, p.close, {REASON} AS why, w.s = z.l.s - 3600000 AS prev
    FROM z, unnest(generate_series(z.l.s - 5 * 3600000, z.l.s, 3600000)) w(s) LEFT JOIN p ON p.series = z.series AND p.start_ms = w.s),
g AS (SELECT *, close / lag(close) OVER (PARTITION BY series, d ORDER BY s) AS ratio, (close - lag(close) OVER (PARTITION BY series, d ORDER BY s)) / nullif(lag(close) OVER (PARTITION BY series, d ORDER BY s), 0) AS r FROM y),
u AS (SELECT series, d, string_agg(DISTINCT why, ';' ORDER BY why) AS whys, max(why) FILTER (prev) AS why1, max(close) FILTER (prev AND why IS NULL) AS c1,
    count(*) FILTER (why IS NULL) AS ok, arg_min(close, s) AS c_first, arg_max(close, s) AS c_last, stddev_pop(r) AS vol FROM g GROUP BY ALL),
fv AS (SELECT z.series, z.d AS window_ms, z.l.s AS latest_start_ms, z.l.e AS latest_end_ms, z.l.c AS latest_close, z.l.a AS latest_available_at,
    (z.l.c - c1) / nullif(c1, 0) AS return_short, coalesce(c1 IS NOT NULL, false) AS short_valid,
    CASE WHEN z.l IS NULL THEN lf WHEN c1 IS NOT NULL THEN 'valid_consecutive_kline' ELSE why1 END AS short_flag,
    CASE WHEN ok = 6 THEN (c_last - c_first) / nullif(c_first, 0) END AS return_long, coalesce(ok = 6, false) AS long_valid,
    CASE WHEN z.l IS NULL THEN lf WHEN ok = 6 THEN 'valid_consecutive_lookback' ELSE whys END AS long_flag,
    CASE WHEN ok = 6 THEN vol END AS volatility
  FROM z LEFT JOIN u ON u.series = z.series AND u.d = z.d),
features AS (SELECT *, long_valid AS volatility_valid, long_flag AS volatility_flag, short_valid AND long_valid AS usable,
    CASE WHEN short_valid AND long_valid THEN 'valid_all_initial_features' WHEN short_valid THEN long_flag WHEN long_valid OR short_flag = long_flag THEN short_flag
      ELSE short_flag || ';' || long_flag END AS feature_flag FROM fv)"""
TARGET = """targets AS (SELECT d.series, d.d AS window_ms, d.d + 14400000 AS window_end_ms,
    CASE WHEN a.copies = 1 THEN a.close END AS start_price, CASE WHEN a.copies = 1 THEN a.start_ms END AS start_interval_ms, CASE WHEN a.copies = 1 THEN a.avail END AS start_available_at,
    CASE WHEN b.copies = 1 THEN b.close END AS end_price, CASE WHEN b.copies = 1 THEN b.start_ms END AS end_interval_ms, CASE WHEN b.copies = 1 THEN b.avail END AS end_available_at,
    CASE WHEN a.copies = 1 AND b.copies = 1 THEN greatest(a.avail, b.avail) END AS target_available_at,
    CASE WHEN a.copies = 1 AND b.copies = 1 THEN CASE WHEN b.close >= a.close THEN 'UP' ELSE 'DOWN' END END AS label,
    'kline_proxy' AS label_source, 'end_price_gte_start_price' AS label_definition,
    coalesce(a.copies = 1 AND b.copies = 1, false) AS target_valid,
    CASE WHEN a.copies > 1 OR b.copies > 1 THEN 'duplicate_boundary_observation' WHEN a.copies IS NULL THEN 'missing_start_boundary' WHEN b.copies IS NULL THEN 'missing_end_boundary'
      WHEN a.avail > d.d * 1000 THEN 'valid_target_late_start_boundary' ELSE 'valid_proxy_target' END AS target_flag
  FROM d LEFT JOIN p a ON a.series = d.series AND a.start_ms = d.d - 3600000 LEFT JOIN p b ON b.series = d.series AND b.start_ms = d.d + 14400000 - 3600000)"""
AUDIT = f"""{VIEW}, {TARGET}, audit AS (SELECT coalesce(f.series, t.series) AS series, coalesce(f.window_ms, t.window_ms) AS window_ms,
    f.series IS NOT NULL AS feature_present, t.series IS NOT NULL AS target_present, coalesce(f.usable, false) AS feature_ok, coalesce(t.target_valid, false) AS target_ok,
    return_short, return_long, volatility, t.label, t.label_source, t.label_definition, feature_flag, target_flag, short_flag, long_flag, volatility_flag,
    CASE WHEN f.series IS NULL THEN 'missing_feature_row' WHEN t.series IS NULL THEN 'missing_target_row' WHEN usable AND target_valid THEN 'eligible'
      WHEN NOT usable AND NOT target_valid THEN 'invalid_feature_and_target' WHEN NOT usable THEN 'invalid_feature' ELSE 'invalid_target' END AS eligibility_reason
  FROM features f FULL JOIN targets t ON f.series = t.series AND f.window_ms = t.window_ms)"""
SCORE = "s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS y, CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS p FROM events)"


def historical_sql(plan: historical.Plan, select: str) -> str:
    back, ahead, size = historical.HISTORY + 1, plan.horizon, plan.block
    need = plan.lookback
    w = "OVER (PARTITION BY series ORDER BY t"
    returns = ", ".join(f"CASE WHEN whole = {need} THEN c1 / nullif(lag(close, {k + 1}) {w}), 0) - 1 END AS return_{k}" for k in plan.returns)
    vols = ", ".join(f"CASE WHEN whole = {need} THEN stddev_pop(r) {w} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS volatility_{k}" for k in plan.volatilities)
    lags = ", ".join(f"lag(v5, {5 * j}) {w})" for j in range(1, 13))
    names = plan.features
    usable = " AND ".join(f"{n} IS NOT NULL" for n in names)
    if plan.join_boundary_flags:
        missing = "concat_ws(';', CASE WHEN c1 IS NULL THEN 'missing_start_boundary' END, CASE WHEN c_end IS NULL THEN 'missing_end_boundary' END)"
    else:
        missing = "CASE WHEN c1 IS NULL THEN 'missing_start_boundary' ELSE 'missing_end_boundary' END"
    return f"""WITH {B}, parts AS (SELECT DISTINCT series, t // {size} AS part FROM b),
    slots AS (SELECT DISTINCT series, unnest(generate_series(part * {size} - {back}, (part + 1) * {size} + {ahead} - 1)) AS t FROM parts),
    all_t AS (SELECT series, unnest(generate_series(min(t), max(t))) AS t FROM slots GROUP BY series),
    s0 AS (SELECT a.series, a.t, open, high, low, close, volume, close / nullif(lag(close) OVER (PARTITION BY a.series ORDER BY a.t), 0) - 1 AS r,
        sum(volume) OVER (PARTITION BY a.series ORDER BY a.t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS v5
      FROM all_t a LEFT JOIN b ON b.series = a.series AND b.t = a.t),
    s1 AS (SELECT *, count(close) {w} ROWS BETWEEN {need} PRECEDING AND 1 PRECEDING) AS whole, count(close) {w} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS candle,
        count(close) {w} ROWS BETWEEN 65 PRECEDING AND 1 PRECEDING) AS history, lag(close) {w}) AS c1, lead(close, {plan.horizon - 1}) {w}) AS c_end,
        avg(close) {w} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ma, avg(close) {w} ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING) AS ma0,
        avg(greatest(r, 0)) {w} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS gain, avg(greatest(-r, 0)) {w} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS loss,
        max(high) {w} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS hi, min(low) {w} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo,
        quantile_cont(1, 0.5) AS dummy, list_sort([{lags}]) AS vs FROM s0 GROUP BY ALL),
    s2 AS (SELECT *, CASE WHEN history = 65 THEN (vs[6] + vs[7]) / 2 END AS base, {returns}, {vols},
        CASE WHEN whole = {need} THEN c1 / nullif(ma, 0) - 1 END AS distance_ma_15, CASE WHEN whole = {need} THEN ma / nullif(ma0, 0) - 1 END AS ma_slope_15,
        CASE WHEN whole = {need} THEN CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100 ELSE 50 END END AS rsi_14,
        CASE WHEN candle = 5 THEN c1 / nullif(lag(open, 5) {w}), 0) - 1 END AS candle_body_5, CASE WHEN candle = 5 THEN (hi - lo) / nullif(c1, 0) END AS high_low_range_5 FROM s1),
    s3 AS (SELECT *, CASE WHEN base > 0 THEN v5 / base END AS volume_ratio_5 FROM s2),
    s4 AS (SELECT *, {usable} AS ok, c1 IS NOT NULL AND c_end IS NOT NULL AS tv FROM s3 WHERE (series, t // {size}) IN (SELECT (series, part) FROM parts) AND t % {plan.step} = 0),
    audit AS (SELECT series, t AS decision, ok AS feature_row_usable, CASE WHEN ok THEN 'valid_all_features' ELSE concat_ws(';', CASE WHEN whole < {need} THEN 'missing_minute_lookback' END,
        CASE WHEN candle < 5 THEN 'missing_5m_candle' END, CASE WHEN history < 65 THEN 'missing_volume_history' WHEN base <= 0 THEN 'zero_volume_baseline' END, 'missing_feature_values') END AS feature_flag,
        {', '.join(f'round({n}, 9) AS {n}' for n in names)}, tv AS target_valid, CASE WHEN tv THEN 'valid_target' ELSE {missing} END AS target_flag,
        CASE WHEN tv THEN c1 END AS target_start_price, CASE WHEN tv THEN c_end END AS target_end_price, CASE WHEN tv THEN round(c_end / nullif(c1, 0) - 1, 9) END AS target_return,
        CASE WHEN tv THEN CASE WHEN c_end >= c1 THEN 'UP' ELSE 'DOWN' END END AS label, 'bar_close' AS label_source, 'end_price_gte_start_price' AS label_definition, ok AND tv AS eligible FROM s4)
    {select}""".replace("quantile_cont(1, 0.5) AS dummy, ", "").replace(" FROM s0 GROUP BY ALL)", " FROM s0)")


# --- bars and grids ----------------------------------------------------------------------


@query(f"WITH {B} SELECT series, t, open, high, low, close, round(volume, 6) AS volume, n FROM b")
def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.hour_bars(spark, sf_dir), 6)


@query(
    f"""WITH {E} SELECT series, us // 60000000 AS t, arg_min(value, us) AS open, max(value) AS high, min(value) AS low, arg_max(value, us) AS close,
    round(sum(value), 6) AS volume, count(*) AS n FROM e GROUP BY ALL"""
)
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.bars(ev.ticks(spark, sf_dir), 60_000_000, by=("series",)), 6)


@query(
    f"""WITH {B} SELECT series, t // 4 AS b, CASE WHEN count(*) = 4 THEN arg_min(open, t) END AS open, CASE WHEN count(*) = 4 THEN max(high) END AS high,
    CASE WHEN count(*) = 4 THEN min(low) END AS low, CASE WHEN count(*) = 4 THEN arg_max(close, t) END AS close, CASE WHEN count(*) = 4 THEN round(sum(volume), 6) END AS volume,
    count(*) AS bars FROM b GROUP BY series, t // 4"""
)
def complete_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars.blocks(ev.hour_bars(spark, sf_dir), 4, by=("series",)), 6)


@query(f"WITH {H} SELECT series, d AS decision_ms FROM d")
def decision_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.decisions(ev.hour_klines(spark, sf_dir))


# --- historical datasets -----------------------------------------------------------------


@query(historical_sql(PLAN, "SELECT * FROM audit"))
def quarter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(historical.dataset(ev.hour_bars(spark, sf_dir), PLAN))


@query(historical_sql(PLAN, f"SELECT series, decision, {', '.join(PLAN.features)}, label, label_source, label_definition FROM audit WHERE eligible"))
def quarter_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(historical.model_view(historical.dataset(ev.hour_bars(spark, sf_dir), PLAN), PLAN))


@query(historical_sql(LONG_PLAN, "SELECT * FROM audit"))
def hourly_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(historical.dataset(ev.hour_bars(spark, sf_dir), LONG_PLAN))


@query(historical_sql(LONG_PLAN, f"SELECT series, decision, {', '.join(LONG_PLAN.features)}, label, label_source, label_definition FROM audit WHERE eligible"))
def hourly_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(historical.model_view(historical.dataset(ev.hour_bars(spark, sf_dir), LONG_PLAN), LONG_PLAN))


@query(historical_sql(PLAN, "SELECT feature_flag, target_flag, count(*) AS rows, count(*) FILTER (eligible) AS eligible_rows FROM audit GROUP BY ALL"))
def completeness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = historical.dataset(ev.hour_bars(spark, sf_dir), PLAN)
    return x.groupBy("feature_flag", "target_flag").agg(F.count(F.lit(1)).alias("rows"), F.count_if("eligible").alias("eligible_rows"))


@query(historical_sql(PLAN, "SELECT coalesce(label, '') AS label, count(*) AS rows FROM audit GROUP BY ALL"))
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = historical.dataset(ev.hour_bars(spark, sf_dir), PLAN)
    return review.label_balance(x.withColumn("label", F.coalesce("label", F.lit(""))))


# --- coverage ----------------------------------------------------------------------------

DAY0, DAYS30 = 1_704_067_200_000, 1_704_067_200_000 + 30 * 86_400_000
GAPS = f"""{M}, i AS (SELECT *, row_number() OVER (PARTITION BY series, start_ms ORDER BY line_no) > 1 AS repeats FROM m WHERE start_ms >= {DAY0} AND start_ms < {DAYS30}),
g AS (SELECT *, start_ms - max(start_ms) OVER (PARTITION BY series ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delta_ms FROM i WHERE NOT repeats)"""
COVER = f"""{GAPS}, c AS (SELECT i.series, count(*) AS in_window, count(DISTINCT start_ms) AS distinct_starts, count(*) - count(DISTINCT start_ms) AS duplicates,
  {(DAYS30 - DAY0) // 60000} - count(DISTINCT start_ms) AS missing_starts FROM i GROUP BY series),
n AS (SELECT series, count(*) FILTER (delta_ms > 60000) AS gap_events, count(*) FILTER (delta_ms < 0) AS backward_starts, coalesce(max(delta_ms - 60000) FILTER (delta_ms > 60000), 0) AS largest_gap_ms FROM g GROUP BY series),
cover AS (SELECT * FROM c JOIN n USING (series))"""


@query("SELECT coalesce(event_type, '<missing>') AS stream, count(*) AS records FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stream_counts(ev.table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), F.lit(False).alias("malformed")))


@query(
    f"""WITH {M} SELECT series, CAST(0 AS BIGINT) AS malformed, count(*) AS records_scanned, count(*) FILTER (series = 'click') AS kline_records, count(*) FILTER (series = 'click') AS closed_klines,
    count(*) FILTER (series = 'click' AND start_ms >= {DAY0} AND start_ms < {DAYS30}) AS in_window, arg_min(avail, line_no) AS first_received, arg_max(avail, line_no) AS last_received FROM m GROUP BY series"""
)
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ev.minute_klines(spark, sf_dir).withColumns(
        {"malformed": F.lit(False), "stream": F.col("series"), "closed": F.lit(True), "received_at": F.col("available_at")}
    )
    return micros(audit.scan_counts(x, "click", DAY0, DAYS30), "first_received", "last_received")


@query(f"WITH {GAPS} SELECT series, line_no, start_ms, delta_ms, coalesce(delta_ms > 60000, false) AS gap, coalesce(delta_ms < 0, false) AS backward FROM g")
def arrival_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ev.minute_klines(spark, sf_dir).where((F.col("start_ms") >= DAY0) & (F.col("start_ms") < DAYS30))
    return audit.arrival_gaps(x, ev.MINUTE_MS, ev.MINUTE_LINES).select("series", "line_no", "start_ms", "delta_ms", "gap", "backward")


@query(f"WITH {COVER} SELECT * FROM cover")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(ev.minute_klines(spark, sf_dir), DAY0, DAYS30, ev.MINUTE_MS, lines=ev.MINUTE_LINES)


@query(
    f"""WITH {COVER} SELECT count(*) AS archives, CAST(sum(in_window) AS BIGINT) AS in_window, CAST(sum(distinct_starts) AS BIGINT) AS distinct_starts, CAST(sum(duplicates) AS BIGINT) AS duplicates,
    CAST(sum(missing_starts) AS BIGINT) AS missing_starts, CAST(sum(gap_events) AS BIGINT) AS gap_events, CAST(sum(backward_starts) AS BIGINT) AS backward_starts, max(largest_gap_ms) AS largest_gap_ms FROM cover"""
)
def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage_totals(audit.coverage(ev.minute_klines(spark, sf_dir), DAY0, DAYS30, ev.MINUTE_MS, lines=ev.MINUTE_LINES))


@query(f"WITH {M} SELECT series, start_ms, count(*) AS copies FROM m GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(ev.minute_klines(spark, sf_dir), ["series", "start_ms"])


@query(
    f"""WITH {M}, x AS (SELECT *, lag(start_ms) OVER (PARTITION BY series ORDER BY line_no) AS before FROM m)
    SELECT series, line_no, start_ms, before FROM x WHERE start_ms <= before"""
)
def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.disorder(ev.minute_klines(spark, sf_dir), "line_no", "start_ms", ["series"], ev.MINUTE_LINES).select("series", "line_no", "start_ms", "before")


CONSECUTIVE = f"""{M}, x AS (SELECT *, lag(start_ms) OVER w AS ps, lag(close) OVER w AS previous_close FROM m WINDOW w AS (PARTITION BY series ORDER BY line_no)),
r AS (SELECT series, line_no, start_ms, end_ms, close, previous_close, round(CASE WHEN start_ms = ps + 60000 THEN (close - previous_close) / nullif(previous_close, 0) END, 9) AS return_1, avail AS available_at,
  coalesce(start_ms = ps + 60000, false) AS consecutive, CASE WHEN ps IS NULL THEN 'no_previous_kline' WHEN start_ms = ps + 60000 THEN 'valid_consecutive_kline' ELSE 'nonconsecutive_previous_kline' END AS quality_flag FROM x)"""


@query(f"WITH {CONSECUTIVE} SELECT * FROM r")
def consecutive_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(micros(audit.consecutive_returns(ev.minute_klines(spark, sf_dir), ev.MINUTE_MS, ev.MINUTE_LINES), "available_at"))


@query(f"WITH {CONSECUTIVE} SELECT * FROM r WHERE consecutive ORDER BY series, line_no LIMIT 25")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(micros(audit.inspect(ev.minute_klines(spark, sf_dir), 25, ev.MINUTE_MS, model_only=True, lines=ev.MINUTE_LINES), "available_at"))


CUTOFF = DAY0 + 15 * 86_400_000


@query(
    f"""WITH {H} SELECT count(*) AS started, count(*) FILTER (end_ms <= {CUTOFF}) AS completed, count(*) FILTER (avail // 1000 <= {CUTOFF}) AS received,
    count(*) FILTER (end_ms <= {CUTOFF} AND avail // 1000 <= {CUTOFF}) AS eligible FROM h WHERE start_ms <= {CUTOFF}"""
)
def cutoff_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.cutoff_cascade(ev.hour_klines(spark, sf_dir), CUTOFF)


@query(
    f"""WITH {H}, x AS (SELECT *, max(start_ms) OVER (PARTITION BY series ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cb FROM h WHERE start_ms <= {CUTOFF}),
    o AS (SELECT *, lag(start_ms) OVER w AS ps, lag(close) OVER w AS pc, row_number() OVER (PARTITION BY series ORDER BY line_no DESC) AS back,
      start_ms - lag(start_ms) OVER w AS gap, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS r FROM x WHERE end_ms <= {CUTOFF} AND avail // 1000 <= {CUTOFF} WINDOW w AS (PARTITION BY series ORDER BY line_no)),
    a AS (SELECT series, count(*) AS n, bool_and(back = 6 OR gap = 3600000) AS run, arg_max(close, line_no) AS cl, arg_min(close, line_no) AS cf, stddev_pop(r) FILTER (back < 6) AS vol FROM o WHERE back <= 6 GROUP BY series)
    SELECT o.series, o.start_ms, o.close, round(CASE WHEN start_ms = ps + 3600000 AND cb = start_ms - 3600000 THEN (close - pc) / nullif(pc, 0) END, 9) AS return_short,
      CASE WHEN ps IS NULL THEN 'no_previous_eligible_kline' WHEN start_ms = ps + 3600000 AND cb = start_ms - 3600000 THEN 'valid_consecutive_kline' ELSE 'nonconsecutive_eligible_kline' END AS short_flag,
      round(CASE WHEN n = 6 AND run THEN (cl - cf) / nullif(cf, 0) END, 9) AS return_long, round(CASE WHEN n = 6 AND run THEN vol END, 9) AS volatility,
      CASE WHEN n < 6 THEN 'insufficient_eligible_history' WHEN run THEN 'valid_consecutive_lookback' ELSE 'nonconsecutive_lookback' END AS long_flag,
      coalesce(start_ms = ps + 3600000 AND cb = start_ms - 3600000, false) AND n = 6 AND run AS snapshot_usable
    FROM o JOIN a USING (series) WHERE back = 1"""
)
def decision_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.snapshot(ev.hour_klines(spark, sf_dir), CUTOFF, ev.GRID, ev.HOUR_LINES))


# --- what was known ----------------------------------------------------------------------


@query(f"WITH {ASOF} SELECT series, d AS decision_ms, l.s AS start_ms, l.c AS close, l.a AS available_at, lf AS latest_flag FROM z")
def asof_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ev.hour_klines(spark, sf_dir)
    x = asof.latest_eligible(asof.per_start(k), ev.decisions(k))
    x = x.select("series", "decision_ms", F.col("latest.start_ms").alias("start_ms"), F.col("latest.close").alias("close"), F.col("latest.available_at").alias("available_at"), "latest_flag")
    return micros(x, "available_at")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ev.hour_klines(spark, sf_dir)
    return asof.feature_view(k, ev.decisions(k), ev.GRID)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ev.hour_klines(spark, sf_dir)
    return targets.targets(k, ev.decisions(k).withColumnRenamed("decision_ms", "window_ms"), ev.GRID)


FEATURES_OUT = """series, window_ms, latest_start_ms, latest_end_ms, latest_close, latest_available_at, round(return_short, 9) AS return_short, short_valid, short_flag,
round(return_long, 9) AS return_long, long_valid, long_flag, round(volatility, 9) AS volatility, volatility_valid, volatility_flag, usable, feature_flag"""


@query(f"WITH {VIEW} SELECT {FEATURES_OUT} FROM features")
def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(micros(_features(spark, sf_dir), "latest_available_at"))


@query(f"WITH {H}, {TARGET} SELECT * FROM targets")
def window_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micros(_targets(spark, sf_dir), "start_available_at", "end_available_at", "target_available_at")


@query(f"WITH {H}, {TARGET} SELECT target_flag, count(*) AS rows, count(*) FILTER (target_valid) AS valid, count(*) FILTER (label = 'UP') AS up FROM targets GROUP BY ALL")
def target_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _targets(spark, sf_dir)
    return x.groupBy("target_flag").agg(F.count(F.lit(1)).alias("rows"), F.count_if("target_valid").alias("valid"), F.count_if(F.col("label") == "UP").alias("up"))


WANTED = f"""{H}, {TARGET}, wanted AS (SELECT series, window_ms, window_end_ms - 3600000 AS boundary_ms FROM targets WHERE target_flag = 'missing_end_boundary'),
src AS (SELECT start_ms AS boundary_ms, count(DISTINCT series) AS sources, arg_min(close, series) AS close, arg_min(avail, series) AS avail, min(series) AS source FROM h WHERE start_ms IN (SELECT boundary_ms FROM wanted) GROUP BY start_ms)"""


@query(f"WITH {WANTED} SELECT w.series, w.window_ms, w.boundary_ms, coalesce(s.sources, 0) AS sources, s.sources IS NOT NULL AS recoverable FROM wanted w LEFT JOIN src s USING (boundary_ms)")
def boundary_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = targets.find_boundaries(targets.wanted_boundaries(_targets(spark, sf_dir), ev.GRID), ev.hour_klines(spark, sf_dir))
    n = F.size(F.array_distinct(F.transform(F.coalesce("sources", F.array()), lambda s: s["series"])))
    return found.select("series", "window_ms", "boundary_ms", n.cast("long").alias("sources"), "recoverable")


REPAIR = f"""{WANTED}, x AS (SELECT t.*, s.close AS fc, s.avail AS fa, s.source AS fs, target_flag = 'missing_end_boundary' AND s.close IS NOT NULL AS asked,
      coalesce(start_interval_ms = window_ms - 3600000 AND start_price IS NOT NULL, false) AS own
      FROM targets t LEFT JOIN (SELECT * FROM src WHERE sources = 1) s ON s.boundary_ms = t.window_end_ms - 3600000),
    y AS (SELECT *, lag(window_end_ms) OVER w AS bw, lag(end_interval_ms) OVER w AS bi, lag(end_price) OVER w AS bp, lag(end_available_at) OVER w AS ba,
      lag(asked) OVER w AS basked, lag(fc) OVER w AS bfc, lag(fa) OVER w AS bfa FROM x WINDOW w AS (PARTITION BY series, window_ms // 86400000 ORDER BY window_ms)),
    z AS (SELECT *, own OR coalesce(bw = window_ms AND bi = window_ms - 3600000 AND bp IS NOT NULL, false) AS base, coalesce(bw = window_ms AND asked AND basked, false) AS chained FROM y),
    c AS (SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY series, window_ms // 86400000 ORDER BY window_ms) AS run FROM z),
    u AS (SELECT *, asked AND bool_or(base) OVER (PARTITION BY series, window_ms // 86400000, run ORDER BY window_ms) AS fixed FROM c),
    r AS (SELECT *, chained AND coalesce(lag(fixed) OVER (PARTITION BY series, window_ms // 86400000 ORDER BY window_ms), false) AS relay FROM u),
    v AS (SELECT *, CASE WHEN own THEN start_price WHEN relay THEN bfc ELSE bp END AS p0, CASE WHEN own THEN start_available_at WHEN relay THEN bfa ELSE ba END AS a0 FROM r),
    repaired AS (SELECT series, window_ms, window_end_ms, CASE WHEN fixed THEN p0 ELSE start_price END AS start_price, CASE WHEN fixed THEN window_ms - 3600000 ELSE start_interval_ms END AS start_interval_ms,
      CASE WHEN fixed THEN a0 ELSE start_available_at END AS start_available_at, CASE WHEN fixed THEN fc ELSE end_price END AS end_price, CASE WHEN fixed THEN window_end_ms - 3600000 ELSE end_interval_ms END AS end_interval_ms,
      CASE WHEN fixed THEN fa ELSE end_available_at END AS end_available_at, CASE WHEN fixed THEN greatest(a0, fa) ELSE target_available_at END AS target_available_at,
      CASE WHEN fixed THEN CASE WHEN fc >= p0 THEN 'UP' ELSE 'DOWN' END ELSE label END AS label, label_source, label_definition, target_valid OR fixed AS target_valid,
      CASE WHEN fixed THEN CASE WHEN a0 // 1000 > window_ms THEN 'valid_target_recovered_end_boundary_late_start' ELSE 'valid_target_recovered_end_boundary' END ELSE target_flag END AS target_flag,
      CASE WHEN fixed THEN fs END AS recovered_from, CASE WHEN fixed THEN CASE WHEN own THEN 'target_row_start' ELSE 'previous_window_end' END END AS start_source, asked AND NOT fixed AS needs_review
    FROM v)"""


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _targets(spark, sf_dir)
    found = targets.find_boundaries(targets.wanted_boundaries(rows, ev.GRID), ev.hour_klines(spark, sf_dir))
    return targets.recover(rows, targets.single_sources(found)[0], ev.GRID)


@query(f"WITH {REPAIR} SELECT * FROM repaired")
def boundary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micros(_repaired(spark, sf_dir), "start_available_at", "end_available_at", "target_available_at")


@query(f"WITH {WANTED} SELECT DISTINCT w.boundary_ms, strftime(make_timestamp(w.window_ms * 1000), '%Y-%m-%d') AS target_day, s.sources FROM wanted w JOIN src s USING (boundary_ms) WHERE s.sources > 1")
def ambiguous_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries that several sources observed: they stay for review."""
    found = targets.find_boundaries(targets.wanted_boundaries(_targets(spark, sf_dir), ev.GRID), ev.hour_klines(spark, sf_dir))
    return targets.single_sources(found)[1].select("boundary_ms", "target_day", F.size("sources").cast("long").alias("sources"))


@query(
    f"""WITH {REPAIR} SELECT strftime(make_timestamp(window_ms * 1000), '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (start_source IS NOT NULL) AS recovered_rows,
    count(*) FILTER (needs_review) AS review_rows FROM repaired GROUP BY ALL"""
)
def recovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.recovery_counters(_repaired(spark, sf_dir))


@query(
    f"""WITH {REPAIR} SELECT window_ms // 86400000 AS day, count(*) AS rows, count(*) FILTER (target_valid) AS valid, count(*) FILTER (target_flag LIKE 'valid_target_recovered%') AS recovered,
    count(*) FILTER (target_flag = 'missing_end_boundary' AND window_end_ms % 86400000 = 0) AS missing_final_end, count(*) FILTER (target_flag = 'missing_end_boundary' AND window_end_ms % 86400000 != 0) AS missing_intraday_end
    FROM repaired GROUP BY ALL"""
)
def recovered_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _repaired(spark, sf_dir).withColumns({"day": F.floor(F.col("window_ms") / 86_400_000), "last_of_day": F.col("window_end_ms") % 86_400_000 == 0})
    return review.day_quality(x, "day")


# --- views -------------------------------------------------------------------------------


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.audit_join(_features(spark, sf_dir), _targets(spark, sf_dir), check=False)


@query(f"WITH {AUDIT} SELECT series, window_ms, feature_present, target_present, feature_ok, target_ok, eligibility_reason, feature_flag, target_flag FROM audit")
def audit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).select(
        "series", "window_ms", "feature_present", "target_present", "feature_ok", "target_ok", "eligibility_reason", F.col("feature_feature_flag").alias("feature_flag"), F.col("target_target_flag").alias("target_flag")
    )


@query(
    f"""WITH {AUDIT} SELECT series, window_ms, round(return_short, 9) AS return_short, round(return_long, 9) AS return_long, round(volatility, 9) AS volatility, label, label_source, label_definition
    FROM audit WHERE eligibility_reason = 'eligible'"""
)
def model_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.model_view(_audit(spark, sf_dir)))


@query(f"WITH {AUDIT} SELECT series, window_ms, eligibility_reason, feature_present, target_present, feature_ok, target_ok, feature_flag AS feature_feature_flag, target_flag AS target_target_flag FROM audit WHERE eligibility_reason != 'eligible'")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.excluded(_audit(spark, sf_dir))


@query(
    f"""WITH {AUDIT} SELECT count(*) AS audit_rows, count(*) FILTER (eligibility_reason = 'eligible') AS eligible_rows, count(*) FILTER (feature_present AND NOT feature_ok) AS invalid_feature_rows,
    count(*) FILTER (target_present AND NOT target_ok) AS invalid_target_rows, count(*) FILTER (NOT feature_present) AS missing_feature_rows, count(*) FILTER (NOT target_present) AS missing_target_rows FROM audit"""
)
def join_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.join_counters(_audit(spark, sf_dir))


MODEL_KEYS = "SELECT series, window_ms FROM audit WHERE feature_ok AND target_ok"


@query(
    f"""WITH {AUDIT}, ok AS (SELECT series, window_ms FROM audit WHERE eligibility_reason = 'eligible'), model AS ({MODEL_KEYS})
    SELECT *, 'audit_only' AS side FROM (SELECT * FROM ok EXCEPT SELECT * FROM model) UNION ALL SELECT *, 'model_only' AS side FROM (SELECT * FROM model EXCEPT SELECT * FROM ok)"""
)
def eligibility_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible windows that the model view lacks, or that only it has: none, on sound tables."""
    a = _audit(spark, sf_dir)
    return views.key_differences(a, views.model_view(a))


@query(
    f"""WITH {VIEW}, {TARGET}, fk AS (SELECT series, window_ms FROM features WHERE usable), tk AS (SELECT series, window_ms FROM targets WHERE target_valid)
    SELECT *, 'features_only' AS side FROM (SELECT * FROM fk EXCEPT SELECT * FROM tk) UNION ALL SELECT *, 'targets_only' AS side FROM (SELECT * FROM tk EXCEPT SELECT * FROM fk)"""
)
def usable_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that can be used on one side only."""
    return views.two_way_anti(_features(spark, sf_dir).where("usable"), _targets(spark, sf_dir).where("target_valid"), ("features_only", "targets_only"))


@query(f"WITH {VIEW} SELECT field, flag, count(*) AS rows FROM (SELECT unnest(['short_flag', 'long_flag', 'volatility_flag']) AS field, unnest([short_flag, long_flag, volatility_flag]) AS flag FROM features) GROUP BY ALL")
def flag_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.flag_counts(_features(spark, sf_dir), FLAGS)


@query(
    f"""WITH {AUDIT}, v AS (SELECT unnest(['return_short', 'return_long', 'volatility']) AS feature, unnest([return_short, return_long, volatility]) AS x FROM audit WHERE eligibility_reason = 'eligible')
    SELECT feature, count(x) AS n, round(min(x), 9) AS least, round(max(x), 9) AS greatest, round(avg(x), 9) AS mean FROM v WHERE x IS NOT NULL AND isfinite(x) GROUP BY feature"""
)
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.feature_profile(views.model_view(_audit(spark, sf_dir)), views.MODEL_FEATURES))


@query(
    f"""WITH {AUDIT}, v AS (SELECT series, unnest(['return_short', 'return_long', 'volatility']) AS feature, unnest([return_short, return_long, volatility]) AS x FROM audit WHERE eligibility_reason = 'eligible')
    SELECT feature, count(x) AS n, round(min(x), 9) AS least, round(max(x), 9) AS greatest FROM v WHERE x IS NOT NULL AND isfinite(x) GROUP BY feature"""
)
def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = review.feature_profile(views.model_view(_audit(spark, sf_dir)), views.MODEL_FEATURES, ["series"])
    return rounded(review.profile_totals(parts).withColumn("n", F.col("n").cast("long")))


@query(
    f"""WITH {H}, {TARGET} SELECT window_ms // 86400000 AS day, count(*) AS rows, count(*) FILTER (target_valid) AS valid, CAST(0 AS BIGINT) AS recovered,
    count(*) FILTER (target_flag = 'missing_end_boundary' AND window_end_ms % 86400000 = 0) AS missing_final_end, count(*) FILTER (target_flag = 'missing_end_boundary' AND window_end_ms % 86400000 != 0) AS missing_intraday_end
    FROM targets GROUP BY ALL"""
)
def day_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _targets(spark, sf_dir).withColumns({"day": F.floor(F.col("window_ms") / 86_400_000), "last_of_day": F.col("window_end_ms") % 86_400_000 == 0})
    return review.day_quality(x, "day")


# --- set operations ----------------------------------------------------------------------

#: Two sides that make up the whole table: hours of all types but clicks, and those of clicks.
_SEEN, _DONE = "SELECT start_ms FROM h WHERE series != 'click'", "SELECT start_ms FROM h WHERE series = 'click'"


def _starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h, seen = ev.hour_klines(spark, sf_dir), F.col("series") != "click"
    return h.where(seen).select("start_ms"), h.where(~seen).select("start_ms")


@query(f"WITH {H} {_SEEN} UNION {_DONE}")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(*_starts(spark, sf_dir))


@query(f"WITH {H} {_SEEN} INTERSECT {_DONE}")
def key_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersection(*_starts(spark, sf_dir))


@query(f"WITH {H} {_SEEN} EXCEPT {_DONE}")
def key_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference(*_starts(spark, sf_dir))


@query("SELECT event_id, ts FROM events")
def table_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a table by type, one after another."""
    e = ev.table(spark, sf_dir, "events")
    types = ["click", "view"]
    return sets.concatenated([*(e.where(F.col("event_type") == t) for t in types), e.where(~F.col("event_type").isin(types))]).select("event_id", "ts")


# --- splits ------------------------------------------------------------------------------


def _split_sql(rank_parts: str) -> str:
    return f"WITH {AUDIT}, v AS (SELECT series, window_ms, label, window_ms // 86400000 AS day FROM audit WHERE eligibility_reason = 'eligible'), k AS (SELECT *, dense_rank() OVER (ORDER BY day) AS rank FROM v) SELECT series, window_ms, label, {rank_parts} AS part FROM k"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.model_view(_audit(spark, sf_dir)).withColumn("day", F.floor(F.col("window_ms") / 86_400_000))


@query(_split_sql("CASE WHEN rank <= 20 THEN 'train' ELSE 'evaluation' END"))
def split_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.by_day_count(_days(spark, sf_dir), "day", [20], ("train", "evaluation")).select("series", "window_ms", "label", "part")


@query(_split_sql("CASE WHEN rank <= 18 THEN 'train' WHEN rank <= 23 THEN 'validation' ELSE 'test' END"))
def split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.by_day_count(_days(spark, sf_dir), "day", [18, 5]).select("series", "window_ms", "label", "part")


@query(_split_sql("CASE WHEN day < 19723 + 17 THEN 'train' WHEN day < 19723 + 24 THEN 'validation' ELSE 'test' END"))
def split_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = split.by_dates(_days(spark, sf_dir), F.date_from_unix_date(F.col("day").cast("int")), "2024-01-18", "2024-01-25")
    return x.select("series", "window_ms", "label", "part")


@query(f"SELECT part, count(*) AS rows, count(*) FILTER (label = 'UP') AS up, min(window_ms) AS first, max(window_ms) AS last FROM ({_split_sql("CASE WHEN rank <= 18 THEN 'train' WHEN rank <= 23 THEN 'validation' ELSE 'test' END")}) GROUP BY part")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.summary(split.by_day_count(_days(spark, sf_dir), "day", [18, 5]), "window_ms")


# --- probabilities -----------------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.ticks(spark, sf_dir)
    return e.select(F.col("series").isin("click", "view").cast("int").alias("y"), (F.col("k") / 100.0).alias("p"))


@query(
    f"""WITH {SCORE}, t AS (SELECT *, CAST((p >= 0.5) = (y = 1) AS INT) AS hit, least(1 - 1e-15, greatest(1e-15, p)) AS q FROM s)
    SELECT count(*) AS n, round(avg(hit), 9) AS accuracy, round((avg(hit) FILTER (y = 0) + avg(hit) FILTER (y = 1)) / 2, 9) AS balanced_accuracy, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 9) AS log_loss,
    round(avg((p - y) * (p - y)), 9) AS brier, round(avg(y), 9) AS prior, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS majority FROM t"""
)
def prob_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.probability_metrics(_scores(spark, sf_dir)))


@query(
    f"""WITH {SCORE}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM s)
    SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 9) AS roc_auc FROM r"""
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_scores(spark, sf_dir)))


@query(f"WITH {SCORE} SELECT a.y, b.predicted, (SELECT count(*) FROM s WHERE s.y = a.y AND CAST(s.p >= 0.5 AS INT) = b.predicted) AS rows FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(predicted)")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scores(spark, sf_dir))


@query(f"WITH {SCORE} SELECT {' + '.join(f'CAST(p >= {e}::DOUBLE AS INT)' for e in metrics.EDGES)} AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate FROM s GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration(_scores(spark, sf_dir)))


@query(
    """WITH x AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(49, floor((value - lo) * 50 / (hi - lo))) AS BIGINT) AS bin, count(*) AS rows FROM events, x WHERE value IS NOT NULL GROUP BY 1"""
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.histogram(ev.table(spark, sf_dir, "events"), "value", 50)


@query()
def logistic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = split.by_day_count(_days(spark, sf_dir), "day", [20], ("train", "evaluation")).withColumn("y", (F.col("label") == "UP").cast("int"))
    whole = x.where(F.col("return_short").isNotNull() & F.col("return_long").isNotNull() & F.col("volatility").isNotNull())
    fitted = model.fit(whole.where("part = 'train'"), views.MODEL_FEATURES)
    return rounded(model.predict(whole, fitted).select("series", "window_ms", "part", "label", "predicted_label", "p_up", "correct"))


# --- texts and identities ----------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS nothing FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").alias("nothing"))


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS us,
    CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS plain, epoch_us(ts) // 1000 AS epoch, epoch_us(ts) // 1000 * 1000 AS key_us FROM events"""
)
def iso_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    e = ev.table(spark, sf_dir, "events")
    return e.select("event_id", iso_ms(ts).alias("ms"), iso_us(ts).alias("us"), iso_plain(ts).alias("plain"), epoch_ms(ts).alias("epoch"), epoch_us(canonical_key(ts)).alias("key_us"))


@query(
    """WITH b AS (SELECT event_type, event_id // 4096 AS block, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS digest, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, sha256(string_agg(digest, ',' ORDER BY block)) AS sha256, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL"""
)
def sha_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.identity(ev.table(spark, sf_dir, "events"), ["event_type"], "event_id", 4096)


from . import file_queries  # noqa: E402, F401  registers its queries
