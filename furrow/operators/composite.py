"""Best-pixel and median composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.masks import clamp_et


def best_pixel(df: DataFrame, by: str = "lst", how: str = "max", max_vza: float = 45.0, carry: tuple[str, ...] = ("lst", "vza", "vaa", "ts"), pixel: str = "pixel", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """One row per pixel and day: the carried columns of the scene that wins.

    Only scenes with a value and vza < max_vza compete; the earliest wins ties. A day
    without one gives NULLs. One hash aggregate of a struct: partial sums before the
    shuffle, no sort.
    """
    valid = F.col("lst").isNotNull() & (F.col("vza") < max_vza)
    sign = 1 if how == "max" else -1
    order = F.struct((sign * F.col(by)).alias("v"), (-F.col(seq)).alias("s"), *(F.col(c).alias(c) for c in carry))
    best = df.groupBy(pixel, F.to_date(ts).alias("day")).agg(F.max(F.when(valid, order)).alias("b"))
    return best.select(pixel, "day", *(F.col(f"b.{c}").alias(c) for c in carry))


def et_median(df: DataFrame, start: str, end: str, pixel: str = "pixel", day: str = "d", et: str = "et", mask: Column | None = None) -> DataFrame:
    """Median of clamped daily ET per pixel over a date range; zeros take part."""
    inside = df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    value = clamp_et(F.col(et))
    return inside.groupBy(pixel).agg(F.median(value if mask is None else value * mask).alias("et_median"), F.count(F.lit(1)).alias("n_days"))


def monthly_median(df: DataFrame, bad_flags: int, pixel: str, ts: str, band: str, value: str, qa: str) -> DataFrame:
    """Median per pixel, month and band of the rows whose QA word has none of the bad bits."""
    good = df.filter(F.col(qa).bitwiseAND(F.lit(bad_flags)) == 0)
    return good.groupBy(pixel, F.trunc(ts, "month").alias("month"), band).agg(F.median(value).alias("value"), F.count(F.lit(1)).alias("n"))
