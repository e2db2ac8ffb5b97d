"""Live versions of bars and of the last returns: an extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 61


def live_bars(ticks: DataFrame, unit: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars of a stream (series, ts, event_id, value), each given out once the watermark has passed its end."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("series", F.window("ts", unit).alias("w"))
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.sum("value").alias("volume"),
        )
        .select("series", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def live_returns(klines: DataFrame, step_ms: int = 1000, lookback: int = KEEP - 1) -> DataFrame:
    """Short and long return of every new kline (series, start_ms, close); state is the last ``lookback`` + 1 of a series.

    A return is null unless all starts it needs follow each other without a gap. Klines that are not after the last start
    are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, closes = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        rows = pd.concat(list(batches)).sort_values("start_ms")
        for start, close in zip(rows["start_ms"], rows["close"], strict=True):
            if starts and start <= starts[-1]:
                continue
            starts, closes = [*starts, int(start)][-lookback - 1 :], [*closes, float(close)][-lookback - 1 :]
            follows = len(starts) > 1 and starts[-1] - starts[-2] == step_ms
            whole = len(starts) == lookback + 1 and starts[-1] - starts[0] == lookback * step_ms
            out.append((key[0], int(start), closes[-1] / closes[-2] - 1 if follows else None, closes[-1] / closes[0] - 1 if whole else None))
        state.update((starts, closes))
        yield pd.DataFrame(out, columns=["series", "start_ms", "return_short", "return_long"])

    return klines.groupBy("series").applyInPandasWithState(
        step,
        "series string, start_ms long, return_short double, return_long double",
        "starts array<long>, closes array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
