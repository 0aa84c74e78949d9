"""Grid alignment: stacking, mosaicking, resampling, windows, chips and extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CELL = ["r", "c"]


def stack_layers(*layers: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Layers of one grid side by side; cells missing from any layer drop."""
    return reduce(lambda a, b: a.join(b, keys), layers)


def mosaic(layers: list[DataFrame], value: str, keys: list[str] = CELL) -> DataFrame:
    """One layer from several; where they overlap the later one in the list wins."""
    united = reduce(DataFrame.unionByName, (d.select(*keys, value).withColumn("_p", F.lit(i)) for i, d in enumerate(layers)))
    return united.groupBy(*keys).agg(F.max_by(value, "_p").alias(value))


def resample_nearest(src: DataFrame, targets: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str) -> DataFrame:
    """Source value at each target's (x, y): the cell that holds it; targets outside drop."""
    at = targets.withColumns({"r": F.floor((F.col("y") - y0) / dy).cast("long"), "c": F.floor((F.col("x") - x0) / dx).cast("long")})
    return at.join(src.select("r", "c", value), CELL)


def resample_bilinear(src: DataFrame, targets: DataFrame, x0: float, y0: float, dx: float, dy: float, value: str, keys: list[str], by: list[str] = []) -> DataFrame:
    """Bilinear value at each target's (x, y) from the four cell centres around it, of source cells with the target's `by` columns.

    Weights are renormalised over the centres that have a value; none: the row drops.
    """
    fx, fy = (F.col("x") - x0) / dx - 0.5, (F.col("y") - y0) / dy - 0.5
    c0, r0 = F.floor(fx).cast("long"), F.floor(fy).cast("long")
    wx, wy = fx - F.floor(fx), fy - F.floor(fy)
    corners = F.array(
        *(
            F.struct((r0 + i).alias("r"), (c0 + j).alias("c"), ((wy if i else 1 - wy) * (wx if j else 1 - wx)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        )
    )
    spread = targets.select(*by, *keys, F.inline(corners)).filter("w > 0")
    near = spread.join(src.select(*by, "r", "c", value).filter(F.col(value).isNotNull()), [*by, *CELL])
    return near.groupBy(*by, *keys).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def aggregate_to_grid(df: DataFrame, factor: int, values: list[str], keys: list[str] = []) -> DataFrame:
    """Mean and population standard deviation per block of factor x factor cells (of each key), NULLs skipped."""
    aggs = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*keys, *(F.floor(F.col(k) / factor).cast("long").alias(k) for k in CELL)).agg(*aggs, F.count(F.lit(1)).alias("n"))


def with_cv(df: DataFrame, values: list[str]) -> DataFrame:
    """cv: mean over bands of std / mean; a zero mean counts as 1e-6, an undefined band as 1000."""
    each = [F.coalesce(F.col(f"std_{v}") / F.when(F.col(f"mean_{v}") == 0, F.lit(1e-6)).otherwise(F.col(f"mean_{v}")), F.lit(1000.0)) for v in values]
    return df.withColumn("cv", reduce(lambda a, b: a + b, each) / len(values))


def coarse_residual(high: DataFrame, low: DataFrame, factor: int, t_high: str, t_low: str, emission: bool = True) -> DataFrame:
    """Coarse temperature less the (fourth-power) mean of the fine ones inside it."""
    power = F.col(t_high) * F.col(t_high) * F.col(t_high) * F.col(t_high) if emission else F.col(t_high)
    mean = high.groupBy(*(F.floor(F.col(k) / factor).cast("long").alias(k) for k in CELL)).agg(F.avg(power).alias("_m"))
    back = F.pow("_m", F.lit(0.25)) if emission else F.col("_m")
    return low.join(mean, CELL).select(*CELL, (F.col(t_low) - back).alias("residual"))


def extent_of(df: DataFrame, cols: tuple[str, str] = ("r", "c")) -> DataFrame:
    r, c = cols
    return df.agg(F.min(r).alias("r0"), F.max(r).alias("r1"), F.min(c).alias("c0"), F.max(c).alias("c1"))


def clip_to(df: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of df inside the extents of both tables; each extent is one row."""
    a, b = extent_of(df), extent_of(other)
    both = a.crossJoin(b.toDF("q0", "q1", "p0", "p1")).select(
        F.greatest("r0", "q0").alias("r0"), F.least("r1", "q1").alias("r1"), F.greatest("c0", "p0").alias("c0"), F.least("c1", "p1").alias("c1")
    )
    inside = F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))
    return df.join(F.broadcast(both), inside).select(*df.columns)


def with_xy(df: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Cell-centre coordinates."""
    return df.withColumns({"x": F.lit(x0) + (F.col("c") + 0.5) * dx, "y": F.lit(y0) + (F.col("r") + 0.5) * dy})


def tile_boxes(df: DataFrame, tile: str = "tile") -> DataFrame:
    return df.groupBy(tile).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))


def _starts(n: int, size: int, overlap: int, cover: bool) -> list[int]:
    step = size - overlap
    ends = list(range(size, n, step))
    if cover:
        while not ends or ends[-1] < n:
            ends.append((ends[-1] + step) if ends else size)
    return [e - size for e in ends]


def chip_grid(spark, n_rows: int, n_cols: int, size: int, overlap: int, cover: bool = False) -> DataFrame:
    """Chip extents of a raster. cover=False loses an exactly fitting last chip and the margin behind it; True adds chips until all cells are in one."""
    rows, cols = _starts(n_rows, size, overlap, cover), _starts(n_cols, size, overlap, cover)
    grid = spark.createDataFrame([(r,) for r in rows], "row_start long").crossJoin(spark.createDataFrame([(c,) for c in cols], "col_start long"))
    return grid.withColumns({"row_end": F.col("row_start") + size, "col_end": F.col("col_start") + size})


def slice_grid(spark, n_rows: int, n_cols: int, n: int) -> DataFrame:
    """n x n slices of equal whole size; the remainder at the far edges is in none."""
    h, w = n_rows // n, n_cols // n
    ids = spark.range(n)
    both = ids.toDF("i").crossJoin(ids.toDF("j"))
    return both.select("i", "j", (F.col("i") * h).alias("row_start"), ((F.col("i") + 1) * h).alias("row_end"), (F.col("j") * w).alias("col_start"), ((F.col("j") + 1) * w).alias("col_end"))


def explode_to_chips(df: DataFrame, n_rows: int, n_cols: int, size: int, overlap: int, cover: bool = True) -> DataFrame:
    """Each cell once per chip that holds it, with chip origin and place inside."""
    step = size - overlap
    last_r, last_c = (len(_starts(n, size, overlap, cover)) - 1 for n in (n_rows, n_cols))

    def chips(k: Column, last: int) -> Column:
        low = F.greatest(F.ceil((k - size + 1) / step), F.lit(0)).cast("int")
        high = F.least(F.floor(k / step), F.lit(last)).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return (
        df.withColumn("_i", F.explode(chips(F.col("r"), last_r)))
        .withColumn("_j", F.explode(chips(F.col("c"), last_c)))
        .withColumns({"row_start": (F.col("_i") * step).cast("long"), "col_start": (F.col("_j") * step).cast("long")})
        .withColumns({"in_r": F.col("r") - F.col("row_start"), "in_c": F.col("c") - F.col("col_start")})
        .drop("_i", "_j")
    )


def stitch_chips(chips: DataFrame, size: int, overlap: int, value: str, mask: DataFrame | None = None) -> DataFrame:
    """Mosaic of chip predictions: half the overlap cropped on every side, masked, chips that are all zero dropped."""
    half = overlap // 2
    inner = F.col("in_r").between(half, size - half - 1) & F.col("in_c").between(half, size - half - 1)
    cells = chips.filter(inner).select("row_start", "col_start", (F.col("row_start") + F.col("in_r")).alias("r"), (F.col("col_start") + F.col("in_c")).alias("c"), value)
    if mask is not None:
        cells = cells.join(mask, CELL).withColumn(value, F.col(value) * F.col("mask")).drop("mask")
    full = cells.groupBy("row_start", "col_start").agg(F.sum(value).alias("_s")).filter("_s > 0").select("row_start", "col_start")
    return cells.join(full, ["row_start", "col_start"], "left_semi").groupBy(*CELL).agg(F.max(value).alias(value))


def assign_windows(df: DataFrame, size: int, margin: float = 0.25) -> DataFrame:
    """Each cell once per training window that holds it: windows of `size` cells, wider by `margin` on every side."""
    extra = int(round(size * margin))

    def ids(k: Column) -> Column:
        return F.sequence(F.greatest(F.floor((k - extra) / size), F.lit(0)).cast("int"), F.floor((k + extra) / size).cast("int"))

    return df.withColumn("win_r", F.explode(ids(F.col("r")))).withColumn("win_c", F.explode(ids(F.col("c"))))
