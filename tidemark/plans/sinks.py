"""Files for others: single CSV and JSON files that appear whole, partitioned tables, versioned names.

Everything goes through Spark's file system, so paths may be in any store it writes to.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import number_text


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def put(spark: SparkSession, aside: str, path: str) -> None:
    """Renames ``aside`` over ``path`` in one step of the store, so that one of the two files is there at any time."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs, target = _fs(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(name(aside)), fs.makeQualified(target), options)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def texts(df: DataFrame, numbers: str = "%.12g") -> DataFrame:
    """Every column as text: booleans in lower case, instants with microseconds, null as ""."""
    return df.select(_cells(df, numbers))


def _cells(df: DataFrame, numbers: str = "%.12g") -> list[Column]:
    as_text = number_text(numbers)
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = as_text(c.cast("double"))
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return out


def write_csv(df: DataFrame, path: str, order: list[str], overwrite: bool = True) -> None:
    """One file with a header, sorted; it is written beside and then renamed. For results that fit one file."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if not overwrite and fs.exists(target):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    texts(df.orderBy(*order).coalesce(1)).write.csv(aside, header=True, emptyValue="")
    _, folder = _fs(spark, aside)
    try:
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        put(spark, part.toString(), path)
    finally:
        fs.delete(folder, True)


def write_day_csvs(df: DataFrame, path: str, day: str, order: list[str]) -> list[str]:
    """``<day>.csv`` in a folder for each day, sorted and with a header, each renamed over the one before; days that are not in
    ``df`` stay as they are. One job writes all days, a task for each; the paths of the files are returned."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}/.{uuid.uuid4().hex}.tmp"
    keys = [F.col(c).alias(f"order_of_row_{i}") for i, c in enumerate(order)]
    named = df.select(F.col(day).cast("string").alias("file_of_day"), *_cells(df.drop(day)), *keys)
    # sorted after the cells are made, and by a column that stays: the writer then keeps the order instead of sorting by day anew
    ordered = named.repartition("file_of_day").sortWithinPartitions("file_of_day", *[f"order_of_row_{i}" for i in range(len(order))])
    ordered.drop(*[f"order_of_row_{i}" for i in range(len(order))]).write.partitionBy("file_of_day").csv(aside, header=True, emptyValue="")
    return _put_each(spark, aside, path, ".csv")


def write_line_files(df: DataFrame, path: str, name: str, line: str, order: list[str], ending: str = ".jsonl.gz") -> list[str]:
    """A file of lines for each ``name``, in order, packed if its ending says so; written as ``write_day_csvs`` writes."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}/.{uuid.uuid4().hex}.tmp"
    ordered = df.select(F.col(name).alias("file_name"), F.col(line).alias("value"), *order).repartition("file_name").sortWithinPartitions("file_name", *order)
    packed = "gzip" if ending.endswith(".gz") else "none"
    ordered.select("file_name", "value").write.partitionBy("file_name").option("compression", packed).text(aside)
    return _put_each(spark, aside, path, ending)


def _put_each(spark: SparkSession, aside: str, path: str, ending: str) -> list[str]:
    """Puts the one file of each folder ``key=name`` in place as ``name`` with an ending."""
    fs, folder = _fs(spark, aside)
    out = []
    try:
        for one in fs.listStatus(folder):
            name = one.getPath().getName()
            if "=" not in name:
                continue
            target = f"{path.rstrip('/')}/{name.partition('=')[2]}{ending}"
            parts = [s.getPath() for s in fs.listStatus(one.getPath()) if s.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise OSError(f"{target} came in {len(parts)} parts")
            put(spark, parts[0].toString(), target)
            out.append(target)
    finally:
        fs.delete(folder, True)
    return sorted(out)


def write_whole_csv(df: DataFrame, path: str, order: list[str]) -> int:
    """All rows as one file, which is read again: other rows than were written stop it."""
    wanted = df.count()
    write_csv(df, path, order)
    found = df.sparkSession.read.csv(path, header=True).count()
    if found != wanted:
        raise OSError(f"{path} has {found} rows, {wanted} were written")
    return found


def write_json(spark: SparkSession, document: Any, path: str, overwrite: bool = True) -> None:
    """A small document, flushed to its store and renamed into place."""
    fs, target = _fs(spark, path)
    if not overwrite and fs.exists(target):
        raise FileExistsError(path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        out = fs.create(aside, True)
        try:
            out.write(bytearray((json.dumps(document, indent=2, sort_keys=True, default=str) + "\n").encode()))
            out.hsync()
        finally:
            out.close()
        put(spark, aside.toString(), path)
    except BaseException:
        fs.delete(aside, False)
        raise


@contextmanager
def locked(spark: SparkSession, path: str):
    """Holds ``path``.lock, which no one else may hold meanwhile."""
    fs, lock = _fs(spark, f"{path}.lock")
    try:
        fs.create(lock, False).close()
    except Exception as e:
        raise FileExistsError(f"{path} is locked by another run; delete {path}.lock if there is none") from e
    try:
        yield
    finally:
        fs.delete(lock, False)


def replace_table(df: DataFrame, path: str) -> None:
    """A Parquet table in place of the one that ``df`` may be read from."""
    fs, target = _fs(df.sparkSession, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(aside)
    fs.delete(target, True)
    if not fs.rename(_fs(df.sparkSession, aside)[1], target):
        raise OSError(f"{path} could not be put in place")


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """A Parquet folder for each day; days that are not in ``df`` stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def versioned_name(stem: str, identity: str, *versions: str, now: datetime | None = None) -> str:
    """A file name that no other run makes: stem, short identity, versions, time and process."""
    safe = lambda s: re.sub(r"[^A-Za-z0-9._-]+", "-", s)
    at = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    return "_".join([safe(stem), identity[:12], *map(safe, versions), f"{at}-{os.getpid()}"])


def document_identity(document: Any) -> str:
    """SHA-256 of a document written with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
