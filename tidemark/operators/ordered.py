"""Values of earlier rows, without one task for a whole series.

A series is cut into blocks of equal width of its ordering number (a line number, or a time). What a row needs from its own
block comes from a window over that block; what it needs from earlier blocks comes from one row for each block,
over which a second window runs. So the longest task sees one block, and the second window as many rows as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 1 << 20  # numbers of lines in a block of a capture
BLOCK = "ordered_block"


def _blocked(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn(BLOCK, F.floor(F.col(order) / width))


def _carried(rows: DataFrame, by: list[str], per_block: Column, over_blocks, name: str) -> DataFrame:
    """``rows`` with a value from the blocks before their own; null in the first block."""
    ends = rows.groupBy(*by, BLOCK).agg(per_block.alias(name))
    carry = ends.select(*by, BLOCK, over_blocks(Window.partitionBy(*by).orderBy(BLOCK)).alias(name))
    return rows.join(carry, [*by, BLOCK], "left")


def running_max(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, width: int, own: bool) -> DataFrame:
    """Adds the greatest ``value`` of all rows up to each (``own``) or before it, in the order of ``order``, whose first column is
    cut into blocks. Nulls are passed over."""
    x = _blocked(rows, order[0], width)
    inside = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    x = x.withColumn(name, F.max(value).over(inside))
    before = lambda w: F.max("ordered_max").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = _carried(x, by, F.max(value), before, "ordered_max")
    greatest = F.when(F.col("ordered_max").isNull() | (F.col(name) > F.col("ordered_max")), F.col(name)).otherwise(F.col("ordered_max"))
    return x.withColumn(name, greatest).drop("ordered_max", BLOCK)


def previous(rows: DataFrame, by: list[str], order: str, values: list[str], name: str, width: int) -> DataFrame:
    """Adds ``name``, a struct of the ``values`` of the row before each; null for the first row of all."""
    x = _blocked(rows, order, width)
    inside = Window.partitionBy(*by, BLOCK).orderBy(order)
    x = x.withColumn(name, F.lag(F.struct(*values)).over(inside))
    last = F.max_by(F.struct(*values), order)
    x = _carried(x, by, last, lambda w: F.lag("ordered_last").over(w), "ordered_last")
    return x.withColumn(name, F.coalesce(name, "ordered_last")).drop("ordered_last", BLOCK)


def last_rows(rows: DataFrame, by: list[str], order: str, n: int, name: str, width: int) -> DataFrame:
    """The last ``n`` rows of each series, numbered from the last in ``name``; each block gives ``n`` at most."""
    x = _blocked(rows, order, width)
    back = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    x = x.withColumn(name, back([*by, BLOCK])).where(F.col(name) <= n).drop(BLOCK)
    return x.withColumn(name, back(by)).where(F.col(name) <= n)
