"""Canopy transforms that need a window, a fixed number of steps, or a weights table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_fg_gutman(df: DataFrame, ndvi: str, tile: str) -> DataFrame:
    """Green fraction: NDVI scaled by its range in the tile, clipped to 0..1. The range is a small aggregate, joined back."""
    span = df.groupBy(tile).agg(F.min(ndvi).alias("_lo"), F.max(ndvi).alias("_hi"))
    scaled = (F.col(ndvi) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(span, tile).withColumn("f_g", F.when(scaled.isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))).drop("_lo", "_hi")


def with_canopy_height(df: DataFrame, lai: str, tile: str, most: float = 1.2, least: float = 0.0) -> DataFrame:
    """Canopy height in proportion to LAI, `most` at the tile's largest."""
    span = df.groupBy(tile).agg(F.max(lai).alias("_hi"))
    h = F.lit(least) + F.col(lai) * (most - least) / F.nullif(F.col("_hi"), F.lit(0.0))
    return df.join(span, tile).withColumn("h_canopy", F.when(h.isNotNull(), F.greatest(F.least(h, F.lit(most)), F.lit(least)))).drop("_hi")


def with_green_fraction(df: DataFrame, lai: str, fapar: str, theta: str, steps: int = 20) -> DataFrame:
    """f_green, fipar and pai by a fixed number of fixed-point steps per row, whatever its neighbours."""
    cosine = F.greatest(F.least(F.cos(F.col(theta)), F.lit(1.0)), F.lit(0.01))

    def step(state: Column, _: Column) -> Column:
        fipar = F.greatest(F.least(1.0 - F.exp(-0.5 * state["pai"] / cosine), F.lit(1.0)), F.lit(1e-6))
        fg = F.greatest(F.least(F.col(fapar) / fipar, F.lit(1.0)), F.lit(0.01))
        return F.struct(fg.alias("fg"), fipar.alias("fipar"), (F.col(lai) / fg).alias("pai"))

    start = F.struct(F.lit(1.0).alias("fg"), F.lit(0.0).alias("fipar"), F.col(lai).cast("double").alias("pai"))
    out = df.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))
    return out.withColumns({"f_green": F.col("_s.fg"), "fipar": F.col("_s.fipar"), "pai": F.col("_s.pai")}).drop("_s")


def with_flags(df: DataFrame, bands: list[str], domains: DataFrame, output: str, low: float, high: float) -> DataFrame:
    """domain code (digits ceil(10 * band) % 10), whether it is listed, and whether the output is in its range.

    domains has a column `code`; it is a lookup table of at most 10 ** bands rows.
    """
    code = F.lit(0).cast("long")
    for i, b in enumerate(bands):
        code = code + (F.ceil(F.col(b) * 10) % 10) * 10**i
    known = domains.select("code").distinct().withColumn("in_domain", F.lit(True))
    out = df.withColumn("code", code).join(known, "code", "left")
    return out.withColumns({"in_domain": F.coalesce("in_domain", F.lit(False)), "in_range": F.col(output).between(low, high)})


def score_network(df: DataFrame, weights: DataFrame, inputs: list[str]) -> DataFrame:
    """One hidden layer of tanh units with affine scaling before and after.

    weights is one row: in_off, in_gain (arrays), w1 (array of rows), b1, w2, b2, out_off, out_gain.
    """
    one = df.crossJoin(F.broadcast(weights.limit(1)))
    x = F.zip_with(F.zip_with(F.array(*(F.col(c).cast("double") for c in inputs)), "in_off", lambda a, o: a - o), "in_gain", lambda a, g: a * g - 1.0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scaled = one.withColumn("_x", x)
    hidden = F.zip_with("w1", "b1", lambda w, b: F.tanh(dot(w, F.col("_x")) + b))
    raw = scaled.withColumn("_h", hidden).withColumn("_o", dot(F.col("w2"), F.col("_h")) + F.col("b2"))
    return raw.withColumn("scored", (F.col("_o") + 1.0) / F.col("out_gain") + F.col("out_off")).select(*df.columns, "scored")


