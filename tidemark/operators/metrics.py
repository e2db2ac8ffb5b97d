"""Quality of probabilities (y 0/1, p) and of the decisions p >= 1/2, each from aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-15
#: ten equal bins, as doubles of k / 10
EDGES = [k / 10 for k in range(1, 10)]


def probability_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, log-loss, Brier score, class prior and majority label (1 on a tie)."""
    hit = (F.col("p") >= 0.5) == (F.col("y") == 1)
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("p")))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    right = lambda y: F.avg(F.when(F.col("y") == y, hit.cast("double")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("double")).alias("accuracy"),
        ((right(0) + right(1)) / 2).alias("balanced_accuracy"),
        F.avg(loss).alias("log_loss"),
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
        F.avg(F.col("y").cast("double")).alias("prior"),
        F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("majority"),
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties as half.

    Rows are counted by score first, and cumulative counts run inside score bands with the bands' offsets
    added, so no task holds all scores.
    """
    by = rows.groupBy(F.col("p").alias("s")).agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    by = by.withColumn("band", F.floor(F.col("s") * 1024))
    bands = by.groupBy("band").agg(F.sum("neg").alias("band_neg"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("band", F.coalesce(F.sum("band_neg").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("band").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    x = by.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(bands, "band")
    won = F.sum(F.col("pos") * (F.col("offset") + F.col("below") + F.col("neg") / 2))
    return x.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def confusion(rows: DataFrame) -> DataFrame:
    """Rows by (y, predicted), with zeros for pairs that do not occur."""
    spark = rows.sparkSession
    all_ = spark.range(4).select((F.col("id") / 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("predicted"))
    seen = rows.groupBy(F.col("y").cast("int").alias("y"), (F.col("p") >= 0.5).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("rows"))
    return all_.join(seen, ["y", "predicted"], "left").select("y", "predicted", F.coalesce("rows", F.lit(0)).alias("rows"))


def calibration(rows: DataFrame) -> DataFrame:
    """Mean probability, observed rate and rows in ten bins; a value on an edge belongs to the upper bin."""
    bin_ = sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in EDGES), F.lit(0))
    return rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
