"""Scores of maps and classifiers, and summaries over parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every parameter row; the grid is a few dozen rows by construction."""
    return df.crossJoin(F.broadcast(grid))


def threshold_grid(spark, steps: int = 6) -> DataFrame:
    values = spark.range(steps)
    t = lambda n: values.select((F.col("id") / 10.0).alias(n))
    return t("t_pred").crossJoin(t("t_ref"))


def iou_surface(best: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean and median IoU of the pairs whose overlaps on both sides exceed each threshold pair."""
    kept = cross_grid(best, grid).filter((F.col("overlap_b") > F.col("t_pred")) & (F.col("overlap_a") > F.col("t_ref")))
    return kept.groupBy("t_pred", "t_ref").agg(F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.count(F.lit(1)).alias("n"))


def grid_summary(results: DataFrame, keys: list[str], overlap: str = "overlap_b", filters: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Mean IoUs and sample size per key under four overlap filters, long, best row per (filter, metric) with ties (equal to nine digits)."""
    each = results.withColumn("least", F.explode(F.array(*(F.lit(f) for f in filters)))).filter(F.col(overlap) >= F.col("least"))
    means = each.groupBy("least", *keys).agg(F.avg("max_iou").alias("mean_max"), F.avg("centre_iou").alias("mean_centre"), F.count(F.lit(1)).alias("n"))
    long = means.unpivot(["least", *keys, "n"], ["mean_max", "mean_centre"], "metric", "score").withColumn("score", F.round("score", 9))
    best = long.groupBy("least", "metric").agg(F.max("score").alias("top"))
    return long.join(best, ["least", "metric"]).filter(F.col("score") == F.col("top")).drop("top")


def class_scores(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Confusion counts, accuracy, precision, recall, Matthews correlation and kappa of a binary prediction, from one count per cell."""
    cell = lambda p, t: F.coalesce(F.sum(F.when((F.col(pred) == p) & (F.col(label) == t), F.col("n"))), F.lit(0)).cast("double")
    counts = df.groupBy(pred, label).agg(F.count(F.lit(1)).alias("n"))
    m = counts.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    zero = lambda x: F.nullif(x, F.lit(0.0))
    accuracy = (tp + tn) / zero(n)
    return m.select(
        "tp",
        "fp",
        "fn",
        "tn",
        accuracy.alias("accuracy"),
        (tp / zero(tp + fp)).alias("precision"),
        (tp / zero(tp + fn)).alias("recall"),
        ((tp * tn - fp * fn) / zero(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        ((accuracy - chance) / zero(1 - chance)).alias("kappa"),
    )
