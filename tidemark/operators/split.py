"""Chronological splits; rows are never dealt out at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import ConstraintError

NAMES = ("train", "validation", "test")


def by_day_count(rows: DataFrame, day: str, counts: list[int], names: tuple[str, ...] = NAMES) -> DataFrame:
    """The first days of the table form the first part, the next the second; what is left the last.

    Only the distinct days, which are few, are ordered in one place; rows join them by day.
    """
    days = rows.select(day).distinct().withColumn("rank", F.row_number().over(Window.orderBy(day)))
    edge, part = 0, None
    for name, n in zip(names, counts, strict=False):
        edge += n
        rule = F.col("rank") <= edge
        part = F.when(rule, name) if part is None else part.when(rule, name)
    days = days.withColumn("part", part.otherwise(names[len(counts)]))
    return rows.join(days.drop("rank"), day)


def by_dates(rows: DataFrame, day: Column, train_end: str, validation_end: str) -> DataFrame:
    """Days before ``train_end`` train, before ``validation_end`` validate, later ones test."""
    d = day.cast("date")
    return rows.withColumn("part", F.when(d < F.lit(train_end).cast("date"), NAMES[0]).when(d < F.lit(validation_end).cast("date"), NAMES[1]).otherwise(NAMES[2]))


def summary(split: DataFrame, key: str, label: str = "label") -> DataFrame:
    return split.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == "UP").alias("up"), F.min(key).alias("first"), F.max(key).alias("last")
    )


def assert_disjoint(split: DataFrame, key: str) -> DataFrame:
    """No key is in two parts and no part begins before the one before it ends."""
    twice = split.groupBy(key).agg(F.count_distinct("part").alias("parts")).where("parts > 1").limit(1).collect()
    parts = sorted(summary(split, key).collect(), key=lambda r: r["first"])
    if twice or any(b["first"] <= a["last"] for a, b in zip(parts, parts[1:], strict=False)):
        raise ConstraintError("parts of the split overlap")
    return split
