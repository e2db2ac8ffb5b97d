"""Quality of a model view: label balance, feature ranges, flags, and agreement with its audit view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite


def label_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def feature_profile(rows: DataFrame, features: list[str], part: list[str] | None = None) -> DataFrame:
    """Count, least, greatest and mean of the finite values of each feature; one pass over the rows."""
    long = rows.select(*(part or []), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f) for f in features]))).alias("feature", "value"))
    keep = long.where(finite(F.col("value")))
    return keep.groupBy(*(part or []), "feature").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"))


def profile_totals(days: DataFrame) -> DataFrame:
    """Profiles of parts merged; means do not merge without their counts and are left out."""
    return days.groupBy("feature").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def flag_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """How often each flag column has each value."""
    pairs = ", ".join(f"'{f}', {f}" for f in flags)
    return rows.selectExpr(f"stack({len(flags)}, {pairs}) AS (field, flag)").groupBy("field", "flag").agg(F.count(F.lit(1)).alias("rows"))


def missing_windows(targets: DataFrame, key: list[str], most: int | None = None) -> DataFrame:
    """Windows without a valid target, by flag, in order; ``most`` of them where a report shows some only."""
    x = targets.where("NOT target_valid").select("target_flag", *key).orderBy("target_flag", *key)
    return x if most is None else x.limit(most)


def unusable_rows(features: DataFrame, flags: list[str], key: list[str]) -> DataFrame:
    """Feature rows that cannot be used, with their flags."""
    return features.where("NOT usable").select(*key, *flags, "feature_flag")


def sorted_values(rows: DataFrame, value: str) -> DataFrame:
    """The values in ascending order, as a curve is drawn through them; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).select(value).orderBy(value)


def day_quality(targets: DataFrame, day: str) -> DataFrame:
    """Per day: rows, valid, recovered, and missing ends that are or are not the day's last window."""
    missing = F.col("target_flag") == "missing_end_boundary"
    return targets.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("target_valid").alias("valid"),
        F.count_if(F.startswith("target_flag", F.lit("valid_target_recovered"))).alias("recovered"),
        F.count_if(missing & F.col("last_of_day")).alias("missing_final_end"),
        F.count_if(missing & ~F.col("last_of_day")).alias("missing_intraday_end"),
    )


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal parts between the least and the greatest value; the last part has its end."""
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), at)).cast("long")
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def assert_reviewable(model: DataFrame, part: str, features: list[str]) -> DataFrame:
    """Every part has rows with finite features and a known label."""
    from .checks import ConstraintError

    bad = reduce(lambda a, f: a | ~finite(F.col(f)), features, ~F.col("label").isin("UP", "DOWN"))
    found = model.groupBy(part).agg(F.count_if(bad).alias("bad")).where("bad > 0").limit(3).collect()
    if found:
        raise ConstraintError(f"rows with unknown labels or non-finite features: {found}")
    return model
