"""Bars from ticks, complete blocks of bars, and regular grids of decision times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_unit

FIELDS = ("open", "high", "low", "close", "volume")


def bars(ticks: DataFrame, unit_us: int, value: str = "value", ts: str = "ts", order: str = "event_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, t, open, high, low, close, volume, n): one row for each unit that has ticks.

    Sums are combined before the shuffle, so one busy unit costs a task no more than one row of another task.
    """
    at = F.struct(ts, order)
    return ticks.groupBy(*by, epoch_unit(F.col(ts), unit_us).alias("t")).agg(
        F.min_by(value, at).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, at).alias("close"),
        F.sum(value).alias("volume"),
        F.count(F.lit(1)).alias("n"),
    )


def blocks(bar_rows: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of ``size`` bars (b = t div size); their values are null unless every bar is there."""
    whole: Column = F.count(F.lit(1)) == size
    return bar_rows.groupBy(*by, F.floor(F.col("t") / size).cast("long").alias("b")).agg(
        F.when(whole, F.min_by("open", "t")).alias("open"),
        F.when(whole, F.max("high")).alias("high"),
        F.when(whole, F.min("low")).alias("low"),
        F.when(whole, F.max_by("close", "t")).alias("close"),
        F.when(whole, F.sum("volume")).alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    )


def grid(spans: DataFrame, start: str, stop: str, step: int, name: str = "decision") -> DataFrame:
    """A row for each step from start up to, and without, stop of each span."""
    last = F.col(stop) - 1
    return spans.where(F.col(stop) > F.col(start)).withColumn(name, F.explode(F.sequence(F.col(start), last, F.lit(step).cast("long"))))
