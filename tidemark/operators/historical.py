"""Features and labels of decisions over regular bars, from completed bars only.

A decision at t sees the bars t-1, t-2, ...; its label is decided by the bar t + horizon - 1. Work is dealt out in
parts of ``block`` units; each part also gets the bars before and after it that its decisions need, so
one long series is spread over all tasks. Inside a part, a spine without holes turns lookbacks into rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import growth, median_of_even, strength_index

BODY = 5  # bars of a candle
BASE = 12  # candles of the volume baseline
HISTORY = BODY * (BASE + 1)


@dataclass(frozen=True)
class Plan:
    """What a dataset looks back and ahead at, in bars."""

    returns: tuple[int, ...]
    volatilities: tuple[int, ...]
    horizon: int
    join_boundary_flags: bool  # name both missing boundaries, or the first alone
    step: int = 1
    block: int = 1440

    @property
    def lookback(self) -> int:
        return max(max(self.returns) + 1, max(self.volatilities) + 1, 31)

    @property
    def features(self) -> list[str]:
        return [
            *(f"return_{k}" for k in self.returns),
            *(f"volatility_{k}" for k in self.volatilities),
            "volume_ratio_5",
            "candle_body_5",
            "high_low_range_5",
            "distance_ma_15",
            "ma_slope_15",
            "rsi_14",
        ]


QUARTER_HOUR = Plan((1, 5, 15, 30), (5, 15), 15, False, step=15)
HOURLY = Plan((1, 5, 15, 30, 60), (5, 15, 60), 60, True, step=60)
MODEL_LABEL = ("label", "label_source", "label_definition")


def spine(bars: DataFrame, plan: Plan, series: str = "series") -> DataFrame:
    """Bars of every part with its surroundings, one row for each unit, holes included."""
    back, ahead, block = HISTORY + 1, plan.horizon, plan.block
    part = F.floor(F.col("t") / block).cast("long")
    first = F.floor((F.col("t") - ahead) / block).cast("long")
    last = F.floor((F.col("t") + back) / block).cast("long")
    spread = bars.withColumn("part", F.explode(F.sequence(F.least(first, part), F.greatest(last, part))))
    own = bars.select(series, part.alias("part")).distinct()
    slots = own.withColumn("t", F.explode(F.sequence(F.col("part") * block - back, (F.col("part") + 1) * block + ahead - 1)))
    return slots.join(spread, [series, "part", "t"], "left")


def dataset(bars: DataFrame, plan: Plan, series: str = "series") -> DataFrame:
    """The audit view: a row for each decision of each part that has bars.

    ``bars`` has (series, t, open, high, low, close, volume) with at most one row a unit. Values are null where a
    bar that they need is missing, with the reason in feature_flag; nothing is filled in.
    """
    w = Window.partitionBy(series, "part").orderBy("t")
    rows = lambda a, b: w.rowsBetween(a, b)
    at = lambda name, k: F.lag(name, k).over(w)
    have = lambda a, b: F.count("close").over(rows(a, b)) == b - a + 1

    x = spine(bars, plan, series)
    x = x.withColumn("r", growth(F.col("close"), at("close", 1)))
    x = x.withColumns({"gain": F.greatest("r", F.lit(0.0)), "loss": F.greatest(-F.col("r"), F.lit(0.0)), "v5": F.sum("volume").over(rows(-BODY, -1))})
    whole, candle, history = have(-plan.lookback, -1), have(-BODY, -1), have(-HISTORY, -1)
    latest = at("close", 1)
    mean, earlier = F.avg("close").over(rows(-15, -1)), F.avg("close").over(rows(-20, -6))
    body_high, body_low = F.max("high").over(rows(-BODY, -1)), F.min("low").over(rows(-BODY, -1))
    median = median_of_even(F.array(*[at("v5", BODY * j) for j in range(1, BASE + 1)]), BASE)
    x = x.withColumns(
        {
            "whole": whole,
            "candle": candle,
            "history": history,
            "latest": latest,
            "base": F.when(history, median),
            **{f"return_{k}": F.when(whole, growth(latest, at("close", k + 1))) for k in plan.returns},
            **{f"volatility_{k}": F.when(whole, F.stddev_pop("r").over(rows(-k, -1))) for k in plan.volatilities},
            "distance_ma_15": F.when(whole, growth(latest, mean)),
            "ma_slope_15": F.when(whole, growth(mean, earlier)),
            "rsi_14": F.when(whole, strength_index(F.avg("gain").over(rows(-14, -1)), F.avg("loss").over(rows(-14, -1)))),
            "candle_body_5": F.when(candle, growth(latest, at("open", BODY))),
            "high_low_range_5": F.when(candle, F.try_divide(body_high - body_low, latest)),
            "end_close": F.lead("close", plan.horizon - 1).over(w) if plan.horizon > 1 else F.col("close"),
        }
    )
    x = x.withColumn("volume_ratio_5", F.when(F.col("base") > 0, F.col("v5") / F.col("base")))
    x = x.where(F.floor(F.col("t") / plan.block) == F.col("part")).where(F.col("t") % plan.step == 0)

    usable = F.lit(True)
    for name in plan.features:
        usable = usable & F.col(name).isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("whole"), "missing_minute_lookback"),
            F.when(~F.col("candle"), "missing_5m_candle"),
            F.when(~F.col("history"), "missing_volume_history").when(F.col("base") <= 0, "zero_volume_baseline"),
            F.lit("missing_feature_values"),
        )
    )
    no_start, no_end = F.col("latest").isNull(), F.col("end_close").isNull()
    if plan.join_boundary_flags:
        missing = F.array_join(F.array_compact(F.array(F.when(no_start, "missing_start_boundary"), F.when(no_end, "missing_end_boundary"))), ";")
    else:
        missing = F.when(no_start, "missing_start_boundary").otherwise("missing_end_boundary")
    x = x.withColumns({"feature_row_usable": usable, "target_valid": ~no_start & ~no_end})
    valid = F.col("target_valid")
    return x.select(
        series,
        F.col("t").alias("decision"),
        "feature_row_usable",
        F.when(F.col("feature_row_usable"), "valid_all_features").otherwise(F.array_join(reasons, ";")).alias("feature_flag"),
        *plan.features,
        "target_valid",
        F.when(valid, "valid_target").otherwise(missing).alias("target_flag"),
        F.when(valid, F.col("latest")).alias("target_start_price"),
        F.when(valid, F.col("end_close")).alias("target_end_price"),
        F.when(valid, growth(F.col("end_close"), F.col("latest"))).alias("target_return"),
        F.when(valid, F.when(F.col("end_close") >= F.col("latest"), "UP").otherwise("DOWN")).alias("label"),
        F.lit("bar_close").alias("label_source"),
        F.lit("end_price_gte_start_price").alias("label_definition"),
        (F.col("feature_row_usable") & valid).alias("eligible"),
    )


def model_view(audit: DataFrame, plan: Plan, series: str = "series") -> DataFrame:
    """Eligible rows alone, without target columns except the label."""
    return audit.where("eligible").select(series, "decision", *plan.features, *MODEL_LABEL)
