"""Instants, epoch numbers and their texts. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})$"
MINUTE_US = 60_000_000


def parse_utc(text: Column) -> Column:
    """The instant of an ISO-8601 text with a zone; a text without one stops the query."""
    return F.when(text.isNull(), F.lit(None).cast("timestamp")).when(text.rlike(_ZONED), text.cast("timestamp")).otherwise(
        F.raise_error(F.concat(F.lit("timestamp without a zone: "), text)).cast("timestamp")
    )


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds, rounded down."""
    return F.floor(epoch_us(ts) / 1000).cast("long")


def epoch_unit(ts: Column, unit_us: int) -> Column:
    return F.floor(epoch_us(ts) / unit_us).cast("long")


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_us(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_plain(ts: Column) -> Column:
    """Without a fraction if it is zero, else with microseconds."""
    return F.when(epoch_us(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(iso_us(ts))


def canonical_key(ts: Column) -> Column:
    """Join key of a window: its instant cut to milliseconds."""
    return F.date_trunc("MILLISECOND", ts)
