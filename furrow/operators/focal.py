"""Neighbourhood operators on sparse cell tables: neighbours come by equi-joins on shifted keys."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def spread(df: DataFrame, offsets: Iterable[tuple], cols: dict[str, str]) -> DataFrame:
    """Every cell's columns at each offset place (r, c), with the offset's further members as w0, w1, ..."""
    offsets = list(offsets)
    extra = len(offsets[0]) - 2
    steps = F.array(*(F.struct(F.lit(o[0]).alias("i"), F.lit(o[1]).alias("j"), *(F.lit(float(o[2 + k])).alias(f"w{k}") for k in range(extra))) for o in offsets))
    out = df.select("r", "c", *(F.col(c).alias(n) for n, c in cols.items()), F.explode(steps).alias("o"))
    return out.select((F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), *cols, *(F.col(f"o.w{k}").alias(f"w{k}") for k in range(extra)))


def _weighted(df: DataFrame, value: str, weights: dict[int, float]) -> DataFrame:
    """Weighted mean of the non-NULL neighbours of every non-NULL cell; the weight of (i, j) is weights[i] * weights[j].

    The kernel is a product, so sums go along rows first and then along columns: a
    cell is copied twice the width of the kernel, not its square.
    """
    filled = df.filter(F.col(value).isNotNull())
    total, share = F.col("v") * F.col("w0"), F.col("w") * F.col("w0")
    sums = filled.select("r", "c", F.col(value).alias("v"), F.lit(1.0).alias("w"))
    for kernel in ([(0, k, x) for k, x in weights.items()], [(k, 0, x) for k, x in weights.items()]):
        sums = spread(sums, kernel, {"v": "v", "w": "w"}).groupBy("r", "c").agg(F.sum(total).alias("v"), F.sum(share).alias("w"))
    smooth = sums.select("r", "c", (F.col("v") / F.col("w")).alias("smooth"))
    return df.join(smooth, ["r", "c"], "left").withColumn("smooth", F.when(F.col(value).isNotNull(), F.col("smooth")))


def smooth_binomial(df: DataFrame, value: str) -> DataFrame:
    """3x3 binomial mean of the neighbours that have a value; a NULL centre stays NULL."""
    return _weighted(df, value, {-1: 1, 0: 2, 1: 1})


def smooth_mean(df: DataFrame, value: str, size: int) -> DataFrame:
    """Moving mean over size x size cells that have a value."""
    return _weighted(df, value, {k: 1 for k in range(-(size // 2), size // 2 + 1)})


def smooth_gauss(df: DataFrame, value: str, size: int) -> DataFrame:
    """NULL-aware Gaussian, standard deviation size / 4, cut at 4 of them."""
    sigma = size / 4
    k = int(4 * sigma + 0.5)
    return _weighted(df, value, {i: math.exp(-i * i / (2 * sigma * sigma)) for i in range(-k, k + 1)})


def fill_edges(df: DataFrame, value: str) -> DataFrame:
    """A NULL cell takes the mean of its four neighbours that have a value."""
    sums = spread(df.filter(F.col(value).isNotNull()), FOUR, {"v": value}).groupBy("r", "c").agg(F.avg("v").alias("_m"))
    return df.join(sums, ["r", "c"], "left").withColumn("filled", F.coalesce(value, "_m")).drop("_m")


def dilate(df: DataFrame, value: str, kernel: Iterable[tuple[int, int]] = ((0, 0), *FOUR), iterations: int = 1) -> DataFrame:
    """(r, c) grown: cells within the kernel of a 1, inside the table's cells. Missing cells count as 0."""
    out = df.select("r", "c", F.col(value).alias("v"))
    for _ in range(iterations):
        grown = spread(out.filter("v = 1"), kernel, {"v": "v"}).select("r", "c").distinct().withColumn("_g", F.lit(1))
        out = out.join(grown, ["r", "c"], "left").select("r", "c", F.coalesce("_g", F.lit(0)).alias("v"))
    return out.withColumnRenamed("v", value)


def erode(df: DataFrame, value: str, kernel: Iterable[tuple[int, int]] = ((0, 0), *FOUR), iterations: int = 1) -> DataFrame:
    """Cells whose whole kernel is 1; missing cells count as 0."""
    kernel = list(kernel)
    out = df.select("r", "c", F.col(value).alias("v"))
    for _ in range(iterations):
        held = spread(out.filter("v = 1"), [(-i, -j) for i, j in kernel], {"v": "v"}).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(kernel)).select("r", "c", F.lit(1).alias("_g"))
        out = out.join(held, ["r", "c"], "left").select("r", "c", F.coalesce("_g", F.lit(0)).alias("v"))
    return out.withColumnRenamed("v", value)


def opened(df: DataFrame, value: str, kernel: Iterable[tuple[int, int]] = ((0, 0), *FOUR)) -> DataFrame:
    kernel = list(kernel)
    return dilate(erode(df, value, kernel), value, kernel)


def slope_aspect(df: DataFrame, value: str, cell: float) -> DataFrame:
    """Slope and aspect in degrees (aspect clockwise from north, rows going south) by Horn's gradient; cells without all eight neighbours drop."""
    kernel = [(-i, -j, j * (2 - abs(i)), i * (2 - abs(j))) for i, j in EIGHT]
    sums = spread(df.filter(F.col(value).isNotNull()), kernel, {"v": value}).groupBy("r", "c").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("v") * F.col("w0")) / (8 * cell)).alias("gx"), (F.sum(F.col("v") * F.col("w1")) / (8 * cell)).alias("gy")
    )
    at = df.select("r", "c").join(sums.filter("n = 8"), ["r", "c"])
    aspect = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return at.select("r", "c", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope"), F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect"))


def label_boundary(df: DataFrame, label: str) -> DataFrame:
    """Cells (label not 0) with a 4-neighbour of another label; a missing neighbour is another."""
    own = df.filter(F.col(label) != 0).select("r", "c", F.col(label).alias("l"))
    same = spread(own, FOUR, {"m": "l"}).join(own, ["r", "c"]).filter("l = m").groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
    return own.join(same, ["r", "c"], "left").filter("n IS NULL OR n < 4").select("r", "c", F.col("l").alias(label))


def column_nearest(df: DataFrame, keys: list[str], source: str, carry: list[str] = []) -> DataFrame:
    """(keys, r, c, gap, from_r, carried): the nearest cell of its column, and of equally near ones the upper, where `source` holds.

    First of the two passes of a distance transform: each column is read downwards and
    upwards once, whatever the distances are. NULLs where a column has none.
    """
    here = F.when(F.col(source), F.struct("r", *carry))
    column = W.partitionBy(*keys, "c").orderBy("r")
    above = F.last(here, ignorenulls=True).over(column.rowsBetween(W.unboundedPreceding, 0))
    below = F.first(here, ignorenulls=True).over(column.rowsBetween(0, W.unboundedFollowing))
    both = df.select(*keys, "r", "c", above.alias("up"), below.alias("down"))
    upper = F.col("down").isNull() | (F.col("r") - F.col("up.r") <= F.col("down.r") - F.col("r"))
    near = both.withColumn("near", F.when(F.col("up").isNotNull() & upper, F.col("up")).otherwise(F.col("down")))
    return near.select(*keys, "r", "c", F.abs(F.col("r") - F.col("near.r")).alias("gap"), F.col("near.r").alias("from_r"), *(F.col(f"near.{c}").alias(c) for c in carry))


def row_nearest(row: np.ndarray, column: np.ndarray, gap: np.ndarray, from_r: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest source of each wanted cell of some rows, and which cell's column has it (-1: none).

    Second pass: the least of one parabola a source cell. Nearest sources keep the order of
    the cells along a row, so the middle cell of a run parts its sources for both halves:
    all runs of all rows are halved at once, and the work is cells times the logarithm of
    a row's width, whatever the distances are. Ties go to the least (row, column).
    """
    none = np.isnan(gap)
    squares = np.where(none, 0, np.nan_to_num(gap)).astype(np.int64) ** 2
    best, origin = np.where(none, np.int64(1) << 62, squares), np.where(none, -1, np.arange(len(column)))
    in_order = np.lexsort((column, row))
    source, asked = in_order[~none[in_order]], in_order[wanted[in_order]]
    x, y, heights = column[asked].astype(np.int64), column[source].astype(np.int64), squares[source]
    first = np.lexsort((y, from_r[source]))
    rank = np.empty(len(source), np.int64)
    rank[first] = np.arange(len(source))
    lines = np.unique(row[asked])
    runs = np.stack([np.searchsorted(row[some], lines, side) for some in (asked, source) for side in ("left", "right")])
    last = np.int64(len(source))
    while (runs := runs[:, (runs[0] < runs[1]) & (runs[2] < runs[3])]).shape[1]:
        q_low, q_high, s_low, s_high = runs
        middle, n = (q_low + q_high) // 2, s_high - s_low
        start = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(run)) + (s_low - start)[run]
        d2 = (x[middle][run] - y[at]) ** 2 + heights[at]
        least = np.minimum.reduceat(d2, start)
        tie = d2 == least[run]
        left, right = np.minimum.reduceat(np.where(tie, at, last), start), np.maximum.reduceat(np.where(tie, at, -1), start)
        best[asked[middle]] = least
        origin[asked[middle]] = source[first[np.minimum.reduceat(np.where(tie, rank[at], last), start)]]
        runs = np.concatenate([[q_low, middle, s_low, left + 1], [middle + 1, q_high, right, s_high]], axis=1)
    return best, origin


def fill_nearest(df: DataFrame, value: str) -> DataFrame:
    """Gaps (NULL or not positive) take the value of the nearest filled cell, the least (row, col) of equally near ones.

    A distance transform in two passes, columns and then rows. Rows with gaps are completed to the
    table's width, as the nearest value may stand above or below a cell that is missing.
    """
    kind = df.schema[value].dataType.simpleString()
    cells = df.select(F.col("r").cast("long"), F.col("c").cast("long"), F.when(F.col(value) > 0, F.col(value)).alias("v"), F.lit(True).alias("real"))
    span = df.agg(F.min("c").cast("long").alias("low"), F.max("c").cast("long").alias("high"))
    rows = cells.filter("v IS NULL").select("r").distinct().crossJoin(F.broadcast(span))
    places = rows.select("r", F.explode(F.sequence("low", "high")).alias("c"))
    grid = cells.unionByName(places.withColumns({"v": F.lit(None).cast(kind), "real": F.lit(False)}))
    grid = grid.groupBy("r", "c").agg(F.max("v").alias("v"), F.max("real").alias("real")).withColumn("filled", F.col("v").isNotNull())
    near = column_nearest(grid, [], "filled", ["v"]).join(grid.select("r", "c", (F.col("real") & ~F.col("filled")).alias("gap_cell")), ["r", "c"])

    def fill(table: pa.Table) -> pa.Table:
        wanted = table.column("gap_cell").to_numpy()
        r, c, gap, from_r = (table.column(x).to_numpy() for x in ("r", "c", "gap", "from_r"))
        _, origin = row_nearest(r, c, gap.astype(float), from_r.astype(float), wanted)
        keep = wanted & (origin >= 0)
        values = table.column("v").take(pa.array(origin[keep]))
        return pa.table({"r": table.column("r").filter(pa.array(keep)), "c": table.column("c").filter(pa.array(keep)), "_v": values})

    found = near.groupBy("r").applyInArrow(fill, f"r long, c long, _v {kind}")
    return df.join(found, ["r", "c"], "left").withColumn("filled", F.coalesce(F.when(F.col(value) > 0, F.col(value)), "_v")).drop("_v")
