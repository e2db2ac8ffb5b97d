"""Delimited tables with a declared header, files with their identity, and small JSON documents."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import finite
from ..operators import checks
from ..operators.ordered import LINES, previous

MINUTE_BARS = T.StructType(
    [
        T.StructField("open_time_utc", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
        T.StructField("close_time_utc", T.TimestampType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("trade_count", T.LongType()),
        T.StructField("taker_buy_base_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
    ]
)
MIDNIGHT = re.compile(r"\d{4}-\d{2}-\d{2}T00:00:00(\.0+)?Z")


def read_exact(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A CSV table whose header must be that of ``schema``, in order; adds file_name."""
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def read_superset(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Named text columns of a CSV table that may have more."""
    rows = spark.read.csv(path, header=True)
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"the table lacks {lacking}")
    return rows.select(columns)


def minute_bars(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(series, t, open, high, low, close, volume) by epoch minute; the file name without ending is the series.

    Times must be whole minutes of the file's day and ascend within the file, and values be finite; one pass decides all of it. Minutes
    that ascend within the files of different days are different, so no further check of uniqueness is needed.
    """
    rows = read_exact(spark, path, MINUTE_BARS)
    us = F.unix_micros("open_time_utc")
    day = F.regexp_extract("file_name", r"(\d{4}-\d{2}-\d{2})", 1)
    rows = rows.withColumns({"t": F.floor(us / 60_000_000).cast("long"), "us": us, "day": day, "line": F.monotonically_increasing_id()})
    seen = previous(rows, ["file_name"], "line", ["us"], "before", LINES)
    values = [F.col(c) for c in ("open", "high", "low", "close", "volume")]
    sound = reduce(lambda x, y: x & y, [finite(v) for v in values])
    rules = {
        "a bar does not start on a whole minute": F.col("us") % 60_000_000 == 0,
        "a bar is not of its file's day": F.date_format("open_time_utc", "yyyy-MM-dd") == F.col("day"),
        "bars do not ascend": F.col("before").isNull() | (F.col("us") > F.col("before.us")),
        "values are not finite": sound,
    }
    checks.all_hold(seen, rules, ["file_name", "open_time_utc"])
    twice = rows.select("file_name", "day").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    checks.holds(twice, F.lit(False), "two files of one day")
    return rows.select(F.lit("1m").alias("series"), "t", "open", "high", "low", "close", "volume")


def file_identity(spark: SparkSession, path: str | list[str], pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, size_bytes and sha256 of the files of a folder. Spark limits a file's content to 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("_metadata.file_name").alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def read_document(spark: SparkSession, path: str) -> Any:
    """A small JSON document, from whatever store Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def coverage_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Names to the midnight, in UTC, that their capture begins at."""
    found = read_document(spark, path)
    if not isinstance(found, dict) or not all(isinstance(k, str) and isinstance(v, str) for k, v in found.items()):
        raise ValueError("a coverage map has text keys and values")
    wrong = [v for v in found.values() if not MIDNIGHT.fullmatch(v)]
    if wrong:
        raise ValueError(f"coverage does not begin at midnight: {wrong[:3]}")
    return found


def boundary_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    """(boundary_ms, target_day, close, available_at, source) of the boundaries that exactly one source observed, and what else
    the report holds: how many were requested, recoverable and not, and those of several sources, which are ambiguous."""
    found = read_document(spark, path)
    if not isinstance(found, list) or not all(isinstance(e, dict) for e in found):
        raise ValueError("a boundary report is an array of objects")
    rows, ambiguous = [], []
    for entry in found:
        if entry.get("recoverable"):
            sources = entry.get("sources")
            if not isinstance(sources, list) or len(sources) != 1:
                ambiguous.append({"boundary_ms": int(entry["boundary_start_ms"]), "target_day": entry["target_day"], "sources": len(sources or [])})
                continue
            one = sources[0]
            lacking = [k for k in ("close", "received_at_utc", "source_group", "source_file") if not one.get(k)]
            if lacking:
                raise ValueError(f"the source of boundary {entry['boundary_start_ms']} lacks {lacking}")
            rows.append((int(entry["boundary_start_ms"]), entry["target_day"], float(one["close"]), one["received_at_utc"], f"{one['source_group']}/{one['source_file']}"))
    named = [int(e["boundary_start_ms"]) for e in found]
    if len(set(named)) < len(named):
        raise ValueError("a boundary is reported twice")
    x = spark.createDataFrame(rows, "boundary_ms long, target_day string, close double, received string, source string")
    about = {"requested": len(found), "recoverable": len(rows), "unrecoverable": sum(not e.get("recoverable") for e in found), "ambiguous": ambiguous}
    return x.select("boundary_ms", "target_day", "close", F.to_timestamp("received").alias("available_at"), "source"), about
