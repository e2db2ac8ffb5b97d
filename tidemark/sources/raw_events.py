"""Raw captures: JSON lines in gzip files, alone or inside zip archives, as typed events.

Only lines that are no JSON objects are malformed; a closed flag that is not the boolean true is not
closed. Documented difference to strict parsers: an object with a repeated key counts as malformed.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import parse_utc

MEMBER = "binance_raw_events_*.jsonl.gz"  # fixed value: name of captured members
LINES = 20_000  # lines of a zip member in one batch


def choose_member(names: list[str], member: str | None = None) -> str:
    """The named member, which must exist, or the only one that looks like a capture."""
    if member is not None:
        if member not in names:
            raise ValueError(f"the archive has no member {member}")
        return member
    found = [n for n in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1], MEMBER)]
    if len(found) != 1:
        raise ValueError(f"expected one member like {MEMBER}, found {found}")
    return found[0]


def read_lines(spark: SparkSession, path: str | list[str], member: str | None = None) -> DataFrame:
    """(series, line_no, value): lines in order of arrival; line_no grows inside a file.

    A gzip file is one task, as gzip cannot be split. Zip archives are opened where they are read, and their
    member is unpacked as a stream.
    """
    paths = [path] if isinstance(path, str) else path
    zips, plain = [p for p in paths if p.endswith(".zip")], [p for p in paths if p.endswith(".jsonl.gz")]
    if len(zips) + len(plain) != len(paths):
        raise ValueError("captures are .zip or .jsonl.gz files")
    if member is not None and plain:
        raise ValueError("a member can be named for zip archives only")
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select(F.col("_metadata.file_name").alias("series"), F.monotonically_increasing_id().alias("line_no"), "value"))
    if zips:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                        with z.open(choose_member(z.namelist(), member)) as packed, gzip.open(packed, "rt", encoding="utf-8", errors="replace") as lines:
                            held, n = [], 0
                            for line in lines:
                                held.append(line.rstrip("\r\n"))
                                if len(held) == LINES:
                                    yield _lines(name, n, held)
                                    held, n = [], n + LINES
                            if held:
                                yield _lines(name, n, held)

        files = spark.read.format("binaryFile").load(zips).select(F.col("_metadata.file_name").alias("series"), "content")
        parts.append(files.mapInArrow(unpack, "series string, line_no long, value string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.trim("value") != "")


def _lines(name: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines)], names=["series", "line_no", "value"])


def events(lines: DataFrame) -> DataFrame:
    """series, line_no, malformed, stream, received_at and, of klines, closed, start_ms, end_ms and close."""
    v = F.try_parse_json("value")
    x = lines.withColumn("v", v)
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    closed = get("$.raw_event.k.x", "variant")
    return x.select(
        "series",
        "line_no",
        (F.col("v").isNull() | ~F.coalesce(is_object, F.lit(False))).alias("malformed"),
        get("$.stream", "string").alias("stream"),
        parse_utc(get("$.received_at_utc", "string")).alias("received_at"),
        F.coalesce((F.schema_of_variant(closed) == "BOOLEAN") & F.try_variant_get(closed, "$", "boolean"), F.lit(False)).alias("closed"),
        get("$.raw_event.k.t", "long").alias("start_ms"),
        get("$.raw_event.k.T", "long").alias("end_ms"),
        get("$.raw_event.k.c", "double").alias("close"),
    )


def closed_klines(rows: DataFrame, stream: str) -> DataFrame:
    """Closed klines of one stream; one that lacks a value stops the query."""
    needed = ("start_ms", "end_ms", "close", "received_at")
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    x = rows.where(~F.col("malformed") & (F.col("stream") == stream) & F.col("closed"))
    x = x.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("closed kline without a value in line "), F.col("line_no").cast("string"))).cast("boolean")))
    return x.select("series", "line_no", "start_ms", "end_ms", "close", F.col("received_at").alias("available_at"))
