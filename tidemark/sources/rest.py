"""Exchange klines over HTTP: a batch source with one partition a day, and the paging behind it."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MINUTE_MS = 60_000
PAGE = 1000
SCHEMA = "open_ms long, open string, high string, low string, close string, volume string, close_ms long, quote_volume string, trade_count long, taker_buy_base_volume string, taker_buy_quote_volume string"

Opener = Callable[[str], bytes]


def over_http(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=30) as answer:
        return answer.read()


def page_url(base: str, symbol: str, start_ms: int, end_ms: int) -> str:
    asked = {"symbol": symbol, "interval": "1m", "startTime": start_ms, "endTime": end_ms - 1, "limit": PAGE}
    return f"{base}?{urllib.parse.urlencode(asked)}"


def fetch_day(base: str, symbol: str, day: date, opener: Opener = over_http, delay_s: float = 0.0) -> Iterator[list]:
    """Raw klines of a UTC day, page after page; a page that does not advance, or an error answer, stops it."""
    cursor = int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)
    end = cursor + 86_400_000
    while cursor < end:
        found = json.loads(opener(page_url(base, symbol, cursor, end)))
        if isinstance(found, dict):
            raise ValueError(f"the exchange answered {found}")
        if not found:
            return
        yield from found
        following = int(found[-1][0]) + MINUTE_MS
        if following <= cursor:
            raise ValueError("the page did not advance")
        cursor = following
        if delay_s and cursor < end:
            time.sleep(delay_s)


def normalised(rows: Iterator[list], day: date) -> list[tuple]:
    """Rows of twelve values as the eleven of the table, those of the day alone, in order and once each."""
    start = int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)
    out = {}
    for r in rows:
        if len(r) != 12:
            raise ValueError(f"a kline has {len(r)} values")
        at = int(r[0])
        if not start <= at < start + 86_400_000:
            raise ValueError(f"a kline of {at} is not of {day}")
        if at in out:
            raise ValueError(f"the kline of {at} came twice")
        out[at] = (at, *map(str, r[1:6]), int(r[6]), str(r[7]), int(r[8]), str(r[9]), str(r[10]))
    return [out[k] for k in sorted(out)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first, last = date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"])
        return [InputPartition((first + timedelta(d)).isoformat()) for d in range((last - first).days)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        day = date.fromisoformat(partition.value)
        yield from normalised(fetch_day(self.options["url"], self.options["symbol"], day, delay_s=float(self.options.get("delay", 0))), day)


class KlineSource(DataSource):
    """``spark.read.format("klines").options(url=, symbol=, start=, end=)`` after registration; end is exclusive."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def as_minute_bars(rows: DataFrame) -> DataFrame:
    """Rows of the source with the columns of a minute table: instants for its two times, numbers as the exchange wrote them."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    times = {"open_ms": "open_time_utc", "close_ms": "close_time_utc"}
    return rows.select(*[F.timestamp_millis(n).alias(times[n]) if n in times else F.col(n) for n in names])
