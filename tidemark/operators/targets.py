"""Labels from window boundaries, and their repair from verified sources. Labels may use late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch_ms, from_ms
from .asof import Grid, per_start

SOURCE, DEFINITION = "kline_proxy", "end_price_gte_start_price"
RECOVERED, RECOVERED_LATE = "valid_target_recovered_end_boundary", "valid_target_recovered_end_boundary_late_start"
START = ("start_price", "start_interval_ms", "start_available_at")
END = ("end_price", "end_interval_ms", "end_available_at")


def targets(observations: DataFrame, windows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """A label row for each window (series, window_ms); both boundaries must be observed exactly once.

    A boundary that is unique is kept even if the other one is not, for review and repair.
    """
    starts = per_start(observations)

    def side(name: str, prefix: str) -> DataFrame:
        cols = [F.when(F.col("copies") == 1, F.col(c)).alias(f"{prefix}_{n}") for c, n in (("close", "price"), ("start_ms", "interval_ms"), ("available_at", "available_at"))]
        return starts.select("series", F.col("start_ms").alias(name), F.col("copies").alias(f"{prefix}_copies"), *cols)

    x = windows.select("series", "window_ms").withColumns(
        {"s": F.col("window_ms") - grid.step_ms, "e": F.col("window_ms") + grid.window_ms - grid.step_ms}
    )
    x = x.join(side("s", "start"), ["series", "s"], "left").join(side("e", "end"), ["series", "e"], "left")
    n_start, n_end = F.coalesce("start_copies", F.lit(0)), F.coalesce("end_copies", F.lit(0))
    valid = (n_start == 1) & (n_end == 1)
    late = F.col("start_available_at") > from_ms(F.col("window_ms"))
    flag = (
        F.when((n_start > 1) | (n_end > 1), "duplicate_boundary_observation")
        .when(n_start == 0, "missing_start_boundary")
        .when(n_end == 0, "missing_end_boundary")
        .when(late, "valid_target_late_start_boundary")
        .otherwise("valid_proxy_target")
    )
    return x.select(
        "series",
        "window_ms",
        (F.col("window_ms") + grid.window_ms).alias("window_end_ms"),
        *START,
        *END,
        F.when(valid, F.greatest("start_available_at", "end_available_at")).alias("target_available_at"),
        F.when(valid, F.when(F.col("end_price") >= F.col("start_price"), "UP").otherwise("DOWN")).alias("label"),
        F.lit(SOURCE).alias("label_source"),
        F.lit(DEFINITION).alias("label_definition"),
        valid.alias("target_valid"),
        flag.alias("target_flag"),
    )


def wanted_boundaries(target_rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Starts of the end boundaries that labels lack."""
    lacking = target_rows.where("target_flag = 'missing_end_boundary'")
    return lacking.select("series", "window_ms", (F.col("window_end_ms") - grid.step_ms).alias("boundary_ms"))


def find_boundaries(wanted: DataFrame, observations: DataFrame) -> DataFrame:
    """Every wanted boundary with the sources that observed it, in any series; without one it is not recoverable.

    The wanted rows are few for each window but grow with the archives, so Spark chooses the join by their size.
    """
    seen = observations.select(F.col("start_ms").alias("boundary_ms"), F.struct("series", "close", "available_at").alias("source"))
    hits = seen.join(wanted.select("boundary_ms").distinct(), "boundary_ms", "left_semi")
    sources = hits.groupBy("boundary_ms").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    found = wanted.join(sources, "boundary_ms", "left")
    return found.withColumn("recoverable", F.coalesce(F.size("sources") > 0, F.lit(False)))


def single_sources(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``find_boundaries``: overrides for ``recover`` from the boundaries that exactly one source observed, and the
    boundaries that several did, which are ambiguous and stay for review."""
    known = found.where("recoverable").select("boundary_ms", F.date_format(from_ms(F.col("window_ms")), "yyyy-MM-dd").alias("target_day"), "sources").distinct()
    one = F.get("sources", F.lit(0))
    fix = known.where(F.size("sources") == 1).select(
        "boundary_ms", "target_day", one["close"].alias("close"), one["available_at"].alias("available_at"), one["series"].alias("source")
    )
    return fix, known.where(F.size("sources") > 1)


def recover(target_rows: DataFrame, overrides: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Target rows with missing ends taken from ``overrides`` (boundary_ms, close, available_at, source, and target_day, the
    UTC day of the window, if it is to be checked: another day stops the query).

    Only rows flagged missing_end_boundary change. Their start must be theirs, or be the end of the row that
    directly precedes on the same day, for the same interval; else ``needs_review`` is set. A row whose end has been
    taken lends it to the next, so a run of such rows is repaired from its first start on. Input rows stay as they are otherwise.
    Rows are looked at by series and day.
    """
    fix = overrides.select(
        "boundary_ms",
        F.col("close").alias("fix_close"),
        F.col("available_at").alias("fix_at"),
        F.col("source").alias("fix_source"),
        (F.col("target_day") if "target_day" in overrides.columns else F.lit(None).cast("string")).alias("fix_day"),
    )
    expected = F.col("window_ms") - grid.step_ms
    day = F.date_format(from_ms(F.col("window_ms")), "yyyy-MM-dd")
    x = target_rows.withColumns({"boundary_ms": F.col("window_end_ms") - grid.step_ms, "day": day}).join(fix, "boundary_ms", "left")
    asked = (F.col("target_flag") == "missing_end_boundary") & F.col("fix_close").isNotNull()
    wrong = F.raise_error(F.concat(F.lit("a boundary is of "), F.col("fix_day"), F.lit(", its window of "), F.col("day"))).cast("boolean")
    x = x.withColumn("asked", F.when(asked & (F.col("fix_day") != F.col("day")), wrong).otherwise(F.coalesce(asked, F.lit(False))))
    w = Window.partitionBy("series", "day").orderBy("window_ms")
    own = (F.col("start_interval_ms") == expected) & F.col("start_price").isNotNull() & F.col("start_available_at").isNotNull()
    x = x.withColumns({"own": F.coalesce(own, F.lit(False)), "before": F.lag(F.struct("window_end_ms", *END, "asked", "fix_close", "fix_at")).over(w)})
    b = F.col("before")
    follows = F.coalesce(b["window_end_ms"] == F.col("window_ms"), F.lit(False))
    lent = follows & (b["end_interval_ms"] == expected) & b["end_price"].isNotNull() & b["end_available_at"].isNotNull()
    x = x.withColumns({"base": F.col("own") | F.coalesce(lent, F.lit(False)), "chained": follows & F.col("asked") & F.coalesce(b["asked"], F.lit(False))})
    x = x.withColumn("run", F.sum(F.when(F.col("chained"), 0).otherwise(1)).over(w))
    run = Window.partitionBy("series", "day", "run").orderBy("window_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("fixed", F.col("asked") & F.max("base").over(run))
    # the end that the row before lends: what it was repaired with, or its own
    relay = F.col("chained") & F.coalesce(F.lag("fixed").over(w), F.lit(False))
    x = x.withColumns({"relay": relay, "borrowed": F.col("fixed") & ~F.col("own"), "needs_review": F.col("asked") & ~F.col("fixed")})
    end = lambda fixed, old: F.when(F.col("relay"), b[fixed]).otherwise(b[old])
    take = lambda mine, theirs: F.when(F.col("borrowed"), theirs).otherwise(F.col(mine))
    x = x.withColumns(
        {
            "p0": take("start_price", end("fix_close", "end_price")),
            "i0": take("start_interval_ms", expected),
            "a0": take("start_available_at", end("fix_at", "end_available_at")),
        }
    )
    fixed = F.col("fixed")
    late = epoch_ms(F.col("a0")) > F.col("window_ms")
    now = lambda new, old: F.when(fixed, new).otherwise(F.col(old)).alias(old)
    return x.select(
        "series",
        "window_ms",
        "window_end_ms",
        now(F.col("p0"), "start_price"),
        now(F.col("i0"), "start_interval_ms"),
        now(F.col("a0"), "start_available_at"),
        now(F.col("fix_close"), "end_price"),
        now(F.col("boundary_ms"), "end_interval_ms"),
        now(F.col("fix_at"), "end_available_at"),
        now(F.greatest("a0", "fix_at"), "target_available_at"),
        now(F.when(F.col("fix_close") >= F.col("p0"), "UP").otherwise("DOWN"), "label"),
        "label_source",
        "label_definition",
        now(F.lit(True), "target_valid"),
        now(F.when(late, RECOVERED_LATE).otherwise(RECOVERED), "target_flag"),
        F.when(fixed, F.col("fix_source")).alias("recovered_from"),
        F.when(fixed, F.when(F.col("borrowed"), "previous_window_end").otherwise("target_row_start")).alias("start_source"),
        "needs_review",
    )


def recovery_counters(recovered: DataFrame) -> DataFrame:
    """Per UTC day: rows, recovered rows, and rows that need review."""
    day = F.date_format(from_ms(F.col("window_ms")), "yyyy-MM-dd").alias("day")
    return recovered.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("start_source").isNotNull()).alias("recovered_rows"), F.count_if("needs_review").alias("review_rows")
    )
