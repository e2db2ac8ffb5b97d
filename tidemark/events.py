"""The driver's event table as captured klines: each event type is a series.

An event's props say how late it was received, which also gives the order of arrival. Hour observations whose last
event has k = 7 are captured twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import epoch_us
from .operators.asof import Grid
from .operators.bars import bars

HOUR_MS, MINUTE_MS = 3_600_000, 60_000
GRID = Grid(HOUR_MS, 4 * HOUR_MS, 5)
MINUTE_LINES = 86_400_000_000 * 128  # line numbers of a day of minute klines, and of hour klines
HOUR_LINES = 86_400_000_000 * 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def minute_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed kline for each event, in order of a late and mixed-up arrival."""
    at = epoch_us(F.col("ts")) + F.col("k") * 10_000_000
    start = F.floor(epoch_us(F.col("ts")) / 60_000_000) * MINUTE_MS
    return ticks(spark, sf_dir).select(
        "series",
        (at * 128 + F.col("event_id") % 128).alias("line_no"),
        start.alias("start_ms"),
        (start + MINUTE_MS - 1).alias("end_ms"),
        F.col("value").alias("close"),
        F.timestamp_micros(at).alias("available_at"),
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir), HOUR_MS * 1000, by=("series",))


def hour_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour observations with the receipt of their last event."""
    t = ticks(spark, sf_dir)
    hour = F.floor(epoch_us(F.col("ts")) / (HOUR_MS * 1000)).alias("hour")
    last = t.groupBy("series", hour).agg(F.max_by(F.struct("value", "ts", "k"), "ts").alias("l"))
    x = last.select(
        "series",
        (F.col("hour") * HOUR_MS).alias("start_ms"),
        (F.col("hour") * HOUR_MS + HOUR_MS - 1).alias("end_ms"),
        F.col("l.value").alias("close"),
        F.timestamp_micros(epoch_us(F.col("l.ts")) + F.col("l.k") * 10_000_000).alias("available_at"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("l.k") == 7, 2).otherwise(1))).alias("copy"),
    )
    return x.withColumn("line_no", epoch_us(F.col("available_at")) * 2 + F.col("copy")).drop("copy")


def decisions(klines: DataFrame, grid: Grid = GRID) -> DataFrame:
    """(series, decision_ms): every window from that of the first kline up to that of the last."""
    span = klines.groupBy("series").agg(F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"))
    step = F.lit(grid.window_ms).cast("long")
    first = F.floor(F.col("lo") / grid.window_ms) * grid.window_ms
    return span.select("series", F.explode(F.sequence(first, F.col("hi"), step)).alias("decision_ms"))
