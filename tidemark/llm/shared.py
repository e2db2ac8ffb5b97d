"""Written tables in the folder that the whole cluster shares, and a filter of bounded size.

Lineage is cut by writing a table and reading it again, never by keeping blocks on one
executor, so that a lost executor costs a re-read and not the result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_LASTING: list[str] = []
FILTER_BITS = 1 << 26  # of a broadcast filter: 8 MB at most, however many keys it holds


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    return _OWN["dir"]


@contextmanager
def _freed_shuffles(spark: SparkSession):
    """Lets Spark delete the shuffle files of a write as soon as the write is over."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the table read from there.

    The table lasts until ``drop_tables``, as what is computed from it may be read at any time.
    """
    table, path = written(df, name, codec)
    _LASTING.append(path)
    return table


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As ``write_table``, with the path, for tables that are dropped once they are of no more use."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freed_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` made; nothing may read it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables of ``write_table``; call it once the results that were computed from them are stored."""
    while _LASTING:
        drop_table(spark, _LASTING.pop())


Batches = Iterator[pa.RecordBatch]


def in_arrow(rows: DataFrame, work: Callable[[Batches], Batches], schema) -> DataFrame:
    """``rows.mapInArrow(work, schema)`` in batches of ``BATCH_ROWS`` texts, unless the session names another number, after
    which a worker gives back the memory that it holds no more: it lives on, and the next task may be of another kind."""

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    if rows.sparkSession.conf.get(_BATCH, None) is None:
        rows.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def _marked(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """_row and _hit: whether ``key`` may be one of ``keys``."""
    place = F.pmod(F.col(keys.columns[0]), F.lit(FILTER_BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_place"))
    bits = bits.where("_bucket IS NOT NULL").groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    place = F.pmod(key, F.lit(FILTER_BITS)) + 1
    asked = rows.select(F.struct("*").alias("_row"), F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_place"))
    one = F.expr("getbit(CAST(conv(hex(substring(_bits, CAST(_place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(_place % 8 AS INT)) = 1")
    return asked.join(F.broadcast(bits), "_bucket", "left").select("_row", F.coalesce(one, F.lit(False)).alias("_hit"))


def maybe_among(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose ``key``, a long, may be one of ``keys`` (one column of longs): all that are, and few others.

    ``keys`` is made into a bitmap of ``FILTER_BITS`` bits, which is broadcast, so no row moves. The size of the
    bitmap does not grow with the keys; the share of other rows that pass does. A null key never passes.
    """
    return _marked(rows, key, keys).where("_hit").select("_row.*")


def split_by(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``maybe_among``, and all others; each is read from ``rows`` on its own."""
    marked = _marked(rows, key, keys)
    return marked.where("_hit").select("_row.*"), marked.where("NOT _hit").select("_row.*")
