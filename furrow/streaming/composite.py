"""The daily best-pixel composite over a stream of thermal observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.masks import mask_lst_quality


def stream_best_pixel(obs: DataFrame, lateness: str = "1 day", max_vza: float = 45.0) -> DataFrame:
    """One row per pixel and day, final once the watermark has passed the day's end.

    The same order as the batch composite: highest lst, then least seq. State is one
    struct per open pixel and day. Days without a valid scene give no row.
    """
    valid = mask_lst_quality(obs).filter(F.col("lst").isNotNull() & (F.col("vza") < max_vza))
    order = F.struct("lst", (-F.col("seq")).alias("s"), "vza", "vaa", "ts")
    best = valid.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "pixel").agg(F.max(order).alias("b"))
    return best.select("pixel", F.to_date("window.start").alias("day"), "b.lst", "b.vza", "b.vaa", "b.ts")
