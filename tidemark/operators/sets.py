"""Sets of keys, tables one after another, and identities of sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of either side, once each."""
    return left.union(right).distinct()


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both sides, once each."""
    return left.intersect(right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of the left side alone, once each."""
    return left.subtract(right)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, by the names of their columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def identity(rows: DataFrame, by: list[str], id_: str, block: int) -> DataFrame:
    """SHA-256 of the ids of each group, in order, and how many there are.

    Ids are hashed by blocks of their numbers and the blocks' digests together, so no row holds all ids of a group.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(id_)), lambda i: i.cast("string")), ",")
    blocks = rows.groupBy(*by, F.floor(F.col(id_) / block).alias("block")).agg(F.sha2(ids, 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    parts = F.sort_array(F.collect_list(F.struct("block", "digest")))
    return blocks.groupBy(*by).agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["digest"]), ","), 256).alias("sha256"), F.sum("n").alias("n"))
