"""What was known at a decision: eligibility, as-of lookup with availability, and complete lookbacks.

An observation (series, start_ms, end_ms, close, available_at) may be used at d once it has ended and been received by
d, to the millisecond. A start that occurs twice is never used, whenever its copy came in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import array_std, change
from ..functions.time import epoch_ms
from .ordered import running_max

NO_BAR = "missing_latest_kline"


@dataclass(frozen=True)
class Grid:
    """Milliseconds of an observation and of a window, and how many observations a lookback goes back."""

    step_ms: int = 1000
    window_ms: int = 300_000
    lookback: int = 60


def per_start(observations: DataFrame) -> DataFrame:
    """One row for each start, with the number of observations; the first to arrive gives the values."""
    order = "line_no" if "line_no" in observations.columns else "available_at"
    return observations.groupBy("series", "start_ms").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by("end_ms", order).alias("end_ms"),
        F.min_by("close", order).alias("close"),
        F.min_by("available_at", order).alias("available_at"),
    )


def reason(decision="decision_ms"):
    """Why a start cannot be used, null if it can; the first that holds."""
    return (
        F.when(F.col("copies").isNull(), "missing_kline")
        .when(F.col("copies") > 1, "duplicate_kline")
        .when(F.col("end_ms") > F.col(decision), "incomplete_at_cutoff")
        .when(epoch_ms(F.col("available_at")) > F.col(decision), "received_after_cutoff")
    )


DAY_MS = 86_400_000


def latest_eligible(starts: DataFrame, decisions: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """``decisions`` (series, decision_ms) with the latest usable observation in ``latest``, and ``latest_flag`` without one.

    Both sides are sorted together by the time from which an observation counts, and a running maximum picks the
    latest start: one sort for each block of time of a series, no range join. Without any, the flag is the reason of the series'
    first start, if that lies before the decision.
    """
    value = F.struct("start_ms", "end_ms", "close", "available_at")
    from_ = F.greatest("end_ms", epoch_ms(F.col("available_at")))
    usable = starts.where("copies = 1").select("series", from_.alias("at"), F.lit(0).alias("tag"), value.alias("o"))
    asked = decisions.select("series", F.col("decision_ms").alias("at"), F.lit(1).alias("tag"))
    both = usable.unionByName(asked, allowMissingColumns=True)
    found = running_max(both, ["series"], ["at", "tag"], "o", "latest", block_ms, own=True)
    found = found.where("tag = 1").select("series", F.col("at").alias("decision_ms"), "latest")
    first = starts.groupBy("series").agg(F.min(F.struct("start_ms", "copies", "end_ms", "available_at")).alias("f"))
    first = first.select("series", F.col("f.start_ms").alias("first_ms"), "f.copies", "f.end_ms", "f.available_at")
    flag = F.when(F.col("first_ms") < F.col("decision_ms"), F.coalesce(reason(), F.lit(NO_BAR))).otherwise(NO_BAR)
    joined = found.join(first, "series", "left").withColumn("latest_flag", F.when(F.col("latest").isNull(), flag))
    return joined.select("series", "decision_ms", "latest", "latest_flag")


def feature_view(observations: DataFrame, decisions: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Short and long return and volatility of each decision (series, decision_ms), with validity and flags.

    The lookback ends at the latest usable observation and is valid only if each of its starts is usable at the decision.
    """
    starts = per_start(observations)
    asof = latest_eligible(starts, decisions)
    back = F.sequence(F.col("latest.start_ms") - grid.lookback * grid.step_ms, F.col("latest.start_ms"), F.lit(grid.step_ms).cast("long"))
    wanted = asof.where("latest IS NOT NULL").select("series", "decision_ms", F.col("latest.start_ms").alias("last_ms"), F.explode(back).alias("start_ms"))
    seen = wanted.join(starts, ["series", "start_ms"], "left").withColumn("why", reason())
    previous = F.col("start_ms") == F.col("last_ms") - grid.step_ms
    summary = seen.groupBy("series", "decision_ms").agg(
        F.array_join(F.array_sort(F.collect_set("why")), ";").alias("whys"),
        F.max(F.when(previous, F.col("why"))).alias("why_1"),
        F.max(F.when(previous & F.col("why").isNull(), F.col("close"))).alias("close_1"),
        F.sort_array(F.collect_list(F.when(F.col("why").isNull(), F.struct("start_ms", "close")))).alias("used"),
    )
    x = asof.join(summary, ["series", "decision_ms"], "left")
    closes = F.col("used.close")
    whole = F.coalesce(F.size("used") == grid.lookback + 1, F.lit(False)) & F.col("latest").isNotNull()
    moves = F.transform(F.sequence(F.lit(2), F.size(closes)), lambda i: change(F.element_at(closes, i), F.element_at(closes, i - 1)))
    x = x.withColumns(
        {
            "return_short": change(F.col("latest.close"), F.col("close_1")),
            "return_long": F.when(whole, change(F.element_at(closes, -1), F.element_at(closes, 1))),
            "volatility": F.when(whole, array_std(moves)),
            "short_valid": F.col("latest").isNotNull() & F.col("close_1").isNotNull(),
            "long_valid": whole,
        }
    )
    none = F.col("latest").isNull()
    flag_short = F.when(none, F.col("latest_flag")).when(F.col("short_valid"), "valid_consecutive_kline").otherwise(F.col("why_1"))
    flag_long = F.when(none, F.col("latest_flag")).when(whole, "valid_consecutive_lookback").otherwise(
        F.when(F.col("whys") != "", F.col("whys")).otherwise("insufficient_eligible_history")
    )
    usable = F.col("short_valid") & F.col("long_valid")
    bad = F.filter(F.array(flag_short, flag_long), lambda f: ~F.startswith(f, F.lit("valid_")))
    return x.select(
        "series",
        F.col("decision_ms").alias("window_ms"),
        F.col("latest.start_ms").alias("latest_start_ms"),
        F.col("latest.end_ms").alias("latest_end_ms"),
        F.col("latest.close").alias("latest_close"),
        F.col("latest.available_at").alias("latest_available_at"),
        "return_short",
        "short_valid",
        flag_short.alias("short_flag"),
        "return_long",
        "long_valid",
        flag_long.alias("long_flag"),
        "volatility",
        F.col("long_valid").alias("volatility_valid"),
        flag_long.alias("volatility_flag"),
        usable.alias("usable"),
        F.when(usable, "valid_all_initial_features").otherwise(F.array_join(F.array_distinct(bad), ";")).alias("feature_flag"),
    )


def cutoff_cascade(observations: DataFrame, cutoff_ms: int) -> DataFrame:
    """How many observations had started, ended, been received and been usable by a cutoff."""
    done, got = F.col("end_ms") <= cutoff_ms, epoch_ms(F.col("available_at")) <= cutoff_ms
    started = observations.where(F.col("start_ms") <= cutoff_ms)
    return started.agg(
        F.count(F.lit(1)).alias("started"), F.count_if(done).alias("completed"), F.count_if(got).alias("received"), F.count_if(done & got).alias("eligible")
    )
