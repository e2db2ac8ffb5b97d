"""Coverage of captured klines, in arrival order: counts, duplicates, gaps, inspection and snapshots.

Line numbers give the order of arrival inside one archive (``series``). What a line needs from earlier ones is found
by blocks of lines (``ordered``), ``lines`` being the numbers in a block, so a long archive is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import array_std, change
from ..functions.time import epoch_ms
from .asof import Grid
from .ordered import LINES, last_rows, previous, running_max

MISSING = "<missing>"


def scan_counts(events: DataFrame, stream: str, start_ms: Column | int, stop_ms: Column | int) -> DataFrame:
    """Per archive: lines that are no objects, records, klines, closed klines, and those in the interval."""
    kline = F.coalesce(~F.col("malformed") & (F.col("stream") == stream), F.lit(False))
    closed = kline & F.col("closed")
    inside = closed & (F.col("start_ms") >= start_ms) & (F.col("start_ms") < stop_ms)
    good = ~F.col("malformed")
    order = F.when(good & F.col("received_at").isNotNull(), F.col("line_no"))
    return events.groupBy("series").agg(
        F.count_if("malformed").alias("malformed"),
        F.count_if(good).alias("records_scanned"),
        F.count_if(kline).alias("kline_records"),
        F.count_if(closed).alias("closed_klines"),
        F.count_if(inside).alias("in_window"),
        F.min_by("received_at", order).alias("first_received"),
        F.max_by("received_at", order).alias("last_received"),
    )


def archive_audit(counts: DataFrame, cover: DataFrame, archives: DataFrame) -> DataFrame:
    """Scan counts beside coverage for every one of ``archives``; one without records has zeros."""
    return archives.join(counts, "series", "left").fillna(0).join(cover.drop("in_window"), "series", "left")


def stream_counts(events: DataFrame) -> DataFrame:
    """Records by stream; records without that field count under a name of their own."""
    return events.where("NOT malformed").groupBy(F.coalesce("stream", F.lit(MISSING)).alias("stream")).agg(F.count(F.lit(1)).alias("records"))


def first_arrivals(klines: DataFrame) -> DataFrame:
    """The first observation of each start, with ``repeats`` on the later ones."""
    rank = F.row_number().over(Window.partitionBy("series", "start_ms").orderBy("line_no"))
    return klines.withColumn("repeats", rank > 1)


def arrival_gaps(klines: DataFrame, step_ms: int = 1000, lines: int = LINES) -> DataFrame:
    """First arrivals with the distance to the greatest start before them; negative ones went backward."""
    first = first_arrivals(klines).where("NOT repeats")
    x = running_max(first, ["series"], ["line_no"], "start_ms", "before", lines, own=False)
    x = x.withColumn("delta_ms", F.col("start_ms") - F.col("before")).drop("before")
    return x.withColumns({"gap": F.coalesce(F.col("delta_ms") > step_ms, F.lit(False)), "backward": F.coalesce(F.col("delta_ms") < 0, F.lit(False))})


def coverage(klines: DataFrame, start_ms: int, stop_ms: int, step_ms: int = 1000, archives: DataFrame | None = None, lines: int = LINES) -> DataFrame:
    """Per archive: closed klines in the interval, distinct and missing starts, duplicates, gaps.

    Every series of ``archives``, or else of ``klines``, has a row; without klines in the interval all its starts are missing.
    """
    inside = klines.where((F.col("start_ms") >= start_ms) & (F.col("start_ms") < stop_ms))
    n = inside.groupBy("series").agg(F.count(F.lit(1)).alias("in_window"), F.count_distinct("start_ms").alias("distinct_starts"))
    gaps = arrival_gaps(inside, step_ms, lines).groupBy("series").agg(
        F.count_if("gap").alias("gap_events"),
        F.count_if("backward").alias("backward_starts"),
        F.coalesce(F.max(F.when(F.col("gap"), F.col("delta_ms") - step_ms)), F.lit(0)).alias("largest_gap_ms"),
    )
    every = (klines if archives is None else archives).select("series").distinct()
    x = every.join(n.join(gaps, "series"), "series", "left").fillna(0)
    return x.withColumns(
        {"duplicates": F.col("in_window") - F.col("distinct_starts"), "missing_starts": F.lit((stop_ms - start_ms) // step_ms) - F.col("distinct_starts")}
    )


def coverage_totals(days: DataFrame) -> DataFrame:
    return days.agg(
        F.count(F.lit(1)).alias("archives"),
        *[F.sum(c).alias(c) for c in ("in_window", "distinct_starts", "duplicates", "missing_starts", "gap_events", "backward_starts")],
        F.max("largest_gap_ms").alias("largest_gap_ms"),
    )


def consecutive_returns(klines: DataFrame, step_ms: int = 1000, lines: int = LINES) -> DataFrame:
    """Every closed kline with the return over the one that arrived before it, valid only if that is one step earlier."""
    x = previous(klines, ["series"], "line_no", ["start_ms", "close"], "before", lines)
    x = x.withColumns({"previous_start": F.col("before.start_ms"), "previous_close": F.col("before.close")})
    follows = F.coalesce(F.col("start_ms") == F.col("previous_start") + step_ms, F.lit(False))
    flag = (
        F.when(F.col("previous_start").isNull(), "no_previous_kline")
        .when(~follows, "nonconsecutive_previous_kline")
        .otherwise("valid_consecutive_kline")
    )
    return x.select(
        "series",
        "line_no",
        "start_ms",
        "end_ms",
        "close",
        "previous_close",
        F.when(follows, change(F.col("close"), F.col("previous_close"))).alias("return_1"),
        "available_at",
        follows.alias("consecutive"),
        flag.alias("quality_flag"),
    )


def inspect(klines: DataFrame, limit: int, step_ms: int = 1000, model_only: bool = False, lines: int = LINES) -> DataFrame:
    """The first rows in order of arrival, the first ``limit`` of each task being merged. The limit is the feature here."""
    rows = consecutive_returns(klines, step_ms, lines)
    return (rows.where("consecutive") if model_only else rows).orderBy("series", "line_no").limit(limit)


def snapshot(klines: DataFrame, cutoff_ms: int, grid: Grid = Grid(), lines: int = LINES) -> DataFrame:
    """One row per archive: the last usable kline to arrive, and returns over the usable ones before it."""
    step, most = grid.step_ms, grid.lookback + 1
    x = klines.where(F.col("start_ms") <= cutoff_ms)
    ok = (F.col("end_ms") <= cutoff_ms) & (epoch_ms(F.col("available_at")) <= cutoff_ms)
    x = running_max(x.withColumn("ok", ok), ["series"], ["line_no"], "start_ms", "closed_before", lines, own=False).where("ok")
    x = last_rows(x, ["series"], "line_no", most + 1, "back", lines)  # the last that count, and the one before them
    before = F.lag(F.struct("start_ms", "close")).over(Window.partitionBy("series").orderBy("line_no"))
    x = x.withColumn("p", before).withColumns({"p_start": F.col("p.start_ms"), "p_close": F.col("p.close")})
    follows = (F.col("start_ms") == F.col("p_start") + step) & (F.col("closed_before") == F.col("start_ms") - step)
    x = x.withColumn("follows", F.coalesce(follows, F.lit(False)))
    x = x.where(F.col("back") <= most)
    last = F.struct("line_no", "start_ms", "end_ms", "close", "available_at", "p_start", "p_close", "follows")
    x = x.groupBy("series").agg(F.max(last).alias("l"), F.sort_array(F.collect_list(F.struct("line_no", "start_ms", "close"))).alias("h"))
    closes, starts = F.col("h.close"), F.col("h.start_ms")
    index = F.sequence(F.lit(2), F.size("h"))
    whole = F.size("h") == most
    run = whole & F.forall(index, lambda i: F.element_at(starts, i) == F.element_at(starts, i - 1) + step)
    moves = F.transform(index, lambda i: change(F.element_at(closes, i), F.element_at(closes, i - 1)))
    long_flag = F.when(~whole, "insufficient_eligible_history").when(run, "valid_consecutive_lookback").otherwise("nonconsecutive_lookback")
    short_flag = (
        F.when(F.col("l.p_start").isNull(), "no_previous_eligible_kline")
        .when(~F.col("l.follows"), "nonconsecutive_eligible_kline")
        .otherwise("valid_consecutive_kline")
    )
    return x.select(
        "series",
        F.col("l.start_ms").alias("start_ms"),
        F.col("l.close").alias("close"),
        F.when(F.col("l.follows"), change(F.col("l.close"), F.col("l.p_close"))).alias("return_short"),
        short_flag.alias("short_flag"),
        F.when(run, change(F.element_at(closes, -1), F.element_at(closes, 1))).alias("return_long"),
        F.when(run, array_std(moves)).alias("volatility"),
        long_flag.alias("long_flag"),
        (F.col("l.follows") & run).alias("snapshot_usable"),
    )
