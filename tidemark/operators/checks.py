"""Constraints that stop a build, each decided by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import LINES, previous


class ConstraintError(ValueError):
    """A table breaks a rule; the message has the first few rows that do."""


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unique(rows: DataFrame, key: list[str], what: str = "rows") -> DataFrame:
    _none(duplicates(rows, key), f"{what}: the key {key} is not unique")
    return rows


def finite(rows: DataFrame, columns: list[str], what: str = "rows") -> DataFrame:
    from ..functions.stats import finite as is_finite

    bad = F.lit(False)
    for c in columns:
        bad = bad | ~is_finite(F.col(c).cast("double"))
    _none(rows.where(bad), f"{what}: values of {columns} are not finite")
    return rows


def disorder(rows: DataFrame, order: str, key: str, part: list[str], width: int = LINES) -> DataFrame:
    """Rows whose key does not exceed that of the row before, in the order of ``order`` within a part."""
    x = previous(rows, part, order, [key], "before", width)
    return x.withColumn("before", F.col("before")[key]).where(F.col(key) <= F.col("before"))


def ordered(rows: DataFrame, order: str, key: str, part: list[str], what: str = "rows", width: int = LINES) -> DataFrame:
    _none(disorder(rows, order, key, part, width), f"{what}: {key} does not ascend")
    return rows


def aligned(rows: DataFrame, ms: str, step_ms: int, what: str = "rows") -> DataFrame:
    _none(rows.where(F.col(ms) % step_ms != 0), f"{what}: {ms} is not a multiple of {step_ms} ms")
    return rows


def all_hold(rows: DataFrame, rules: dict[str, Column], show: list[str]) -> DataFrame:
    """Every row meets every rule, by one aggregate over all of them; null counts as a breach."""
    broken = {f"r{i}": ~F.coalesce(rule, F.lit(False)) for i, rule in enumerate(rules.values())}
    first = [F.min(F.when(bad, F.struct(*show))).alias(name) for name, bad in broken.items()]
    found = rows.agg(*first).first()
    wrong = [f"{what}: {found[f'r{i}'].asDict()}" for i, what in enumerate(rules) if found[f"r{i}"] is not None]
    if wrong:
        raise ConstraintError("; ".join(wrong))
    return rows


def in_domain(rows: DataFrame, domains: dict[str, list], what: str = "rows") -> DataFrame:
    """Each of the columns has one of the values named for it."""
    bad = F.lit(False)
    for column, values in domains.items():
        bad = bad | ~F.coalesce(F.col(column).isin(values), F.lit(False))
    _none(rows.where(bad).select(*domains), f"{what}: values outside their domain")
    return rows


def holds(rows: DataFrame, rule: Column, what: str) -> DataFrame:
    """Every row meets ``rule``; null counts as a breach."""
    _none(rows.where(~F.coalesce(rule, F.lit(False))), what)
    return rows


def counted(rows: DataFrame, part: list[str], n: int, what: str = "rows") -> DataFrame:
    _none(rows.groupBy(part).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != n), f"{what}: a part has not {n} rows")
    return rows


def reconciled(parts: DataFrame, totals: DataFrame, columns: list[str], what: str = "totals") -> None:
    """The sums of ``parts`` are the one row of ``totals``."""
    found = parts.agg(*[F.sum(c).alias(c) for c in columns]).first().asDict()
    stated = totals.select(columns).first().asDict()
    if found != stated:
        raise ConstraintError(f"{what}: {found} summed, {stated} stated")


def _none(bad: DataFrame, message: str) -> None:
    found = bad.limit(3).collect()
    if found:
        raise ConstraintError(f"{message}: {[r.asDict() for r in found]}")
