"""The audit view keeps every window with its reasons; the model view keeps the eligible ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import from_ms
from .checks import unique

KEY = ["series", "window_ms"]
MODEL_FEATURES = ["return_short", "return_long", "volatility"]
MODEL_COLUMNS = [*KEY, *MODEL_FEATURES, "label", "label_source", "label_definition"]


def audit_join(features: DataFrame, targets: DataFrame, check: bool = True) -> DataFrame:
    """Full outer join on the window; a window that either side has twice stops the query."""
    if check:
        unique(features, KEY, "features")
        unique(targets, KEY, "targets")
    f = features.select(*KEY, F.lit(True).alias("feature_present"), *[F.col(c).alias(f"feature_{c}") for c in features.columns if c not in KEY])
    t = targets.select(*KEY, F.lit(True).alias("target_present"), *[F.col(c).alias(f"target_{c}") for c in targets.columns if c not in KEY])
    x = f.join(t, KEY, "full_outer")
    no = F.lit(False)
    x = x.withColumns(
        {
            "feature_present": F.coalesce("feature_present", no),
            "target_present": F.coalesce("target_present", no),
            "feature_ok": F.coalesce("feature_usable", no),
            "target_ok": F.coalesce("target_target_valid", no),
        }
    )
    why = (
        F.when(~F.col("feature_present"), "missing_feature_row")
        .when(~F.col("target_present"), "missing_target_row")
        .when(F.col("feature_ok") & F.col("target_ok"), "eligible")
        .when(~F.col("feature_ok") & ~F.col("target_ok"), "invalid_feature_and_target")
        .when(~F.col("feature_ok"), "invalid_feature")
        .otherwise("invalid_target")
    )
    return x.withColumn("eligibility_reason", why).withColumn("eligible", F.col("eligibility_reason") == "eligible")


def model_view(audit: DataFrame) -> DataFrame:
    """Eligible windows with features and label; a blank value in one stops the query."""
    blank = F.lit(False)
    for c in [*(f"feature_{c}" for c in MODEL_FEATURES), "target_label"]:
        blank = blank | F.col(c).isNull()
    whole = F.when(blank, F.raise_error(F.lit("an eligible row has a blank value")).cast("boolean")).otherwise(True)
    return audit.where("eligible").where(whole).select(
        *KEY, *[F.col(f"feature_{c}").alias(c) for c in MODEL_FEATURES], *[F.col(f"target_{c}").alias(c) for c in ("label", "label_source", "label_definition")]
    )


def excluded(audit: DataFrame) -> DataFrame:
    """Windows that the model view lacks, with the flags that say why."""
    return audit.where("NOT eligible").select(
        *KEY, "eligibility_reason", "feature_present", "target_present", "feature_ok", "target_ok", "feature_feature_flag", "target_target_flag"
    )


def join_counters(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("audit_rows"),
        F.count_if("eligible").alias("eligible_rows"),
        F.count_if(F.expr("feature_present AND NOT feature_ok")).alias("invalid_feature_rows"),
        F.count_if(F.expr("target_present AND NOT target_ok")).alias("invalid_target_rows"),
        F.count_if(F.expr("NOT feature_present")).alias("missing_feature_rows"),
        F.count_if(F.expr("NOT target_present")).alias("missing_target_rows"),
    )


def with_day(rows: DataFrame) -> DataFrame:
    """Rows with the UTC day of their window."""
    return rows.withColumn("day", F.to_date(from_ms(F.col("window_ms"))))


def day_counters(rows: DataFrame, **counts: Column) -> DataFrame:
    """Rows of each UTC day, and those of them that each of ``counts`` holds for."""
    return with_day(rows).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def without_days(rows: DataFrame, days: list[str]) -> DataFrame:
    """Rows whose UTC day is none of ``days``."""
    return with_day(rows).where(~F.col("day").cast("string").isin(days)).drop("day") if days else rows


def two_way_anti(left: DataFrame, right: DataFrame, sides: tuple[str, str], key: list[str] = KEY) -> DataFrame:
    """Keys that one of two tables lacks, with the side that has them."""
    a, b = left.select(*key), right.select(*key)
    return a.join(b, key, "left_anti").withColumn("side", F.lit(sides[0])).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit(sides[1])))


def key_differences(audit: DataFrame, model: DataFrame) -> DataFrame:
    """Eligible windows that the model view lacks, and windows that only the model view has."""
    return two_way_anti(audit.where("eligible"), model, ("audit_only", "model_only"))
