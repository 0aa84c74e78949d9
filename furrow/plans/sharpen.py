"""Thermal sharpening: a coarse temperature grid brought to fine predictors' resolution.

Local and global linear models are fitted from grouped normal sums: Spark reduces
every training window to one row of sums, and only those rows are solved in Python.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.grids import CELL, aggregate_to_grid, assign_windows, resample_bilinear, with_cv
from furrow.operators.sampling import group_quantiles, ranked
from furrow.plans.tree import fit_tree, leaf_of, leaf_value
from furrow.session import materialise

#: Training cells that a window needs for a model of its own.
LEAST_CELLS = 10
#: Stands for the scene where the cells have no key.
ONE = ["_scene"]
_BLOCK = 64


def _scene(df: DataFrame, keys: list[str]) -> DataFrame:
    return df if keys != ONE else df.withColumn(ONE[0], F.lit(0))


def _attached(cells: DataFrame, keys: list[str], place: dict[str, Column], by_scene: DataFrame) -> DataFrame:
    """cells with the columns of a table of one row a scene.

    They come by way of the places (windows, blocks) that a scene's cells have, so that
    cells are dealt by scene and place, whatever the share of a scene.
    """
    placed = cells.withColumns(place)
    there = placed.select(*keys, *place).distinct().join(by_scene, keys)
    return placed.join(there, [*keys, *place])


def training_rows(fine: DataFrame, coarse: DataFrame, factor: int, predictors: list[str], temperature: str, quantile: float = 0.8, keys: list[str] = []) -> DataFrame:
    """Coarse cells with predictor means, temperature y and weight w, of each scene (keys) for itself.

    Valid cells have a temperature and 0 < cv < 1000. w is 1 / cv scaled to 0..1 over
    the scene, halved above its cv quantile.
    """
    by = keys or ONE
    cells = with_cv(aggregate_to_grid(fine, factor, predictors, keys), predictors).join(coarse.select(*keys, *CELL, F.col(temperature).alias("y")), [*keys, *CELL])
    for p in predictors:
        cells = cells.filter(F.col(f"mean_{p}").isNotNull())
    cells = materialise(_scene(cells.filter("y IS NOT NULL AND cv > 0 AND cv < 1000"), by), "training")
    cut = group_quantiles(cells, by, "cv", [quantile]).select(*by, F.get("e", F.lit(0)).alias("cut"))
    bounds = cells.groupBy(*by).agg(F.min(1 / F.col("cv")).alias("lo"), F.max(1 / F.col("cv")).alias("hi")).join(cut, by)
    near = _attached(cells, by, {f"_b{k}": F.floor(F.col(k) / _BLOCK) for k in CELL}, bounds)
    scaled = F.coalesce((1 / F.col("cv") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0))
    weighted = near.withColumn("w", scaled * F.when(F.col("cv") > F.col("cut"), 0.5).otherwise(1.0))
    return weighted.drop("cut", "lo", "hi", "_br", "_bc", *ONE)


def _solve(k: int, ridge: float) -> Callable:
    def run(frames):
        for frame in frames:
            betas = []
            for xx, xy in zip(frame["xx"], frame["xy"], strict=True):
                a = np.array(xx, float).reshape(k, k)
                scale = np.sqrt(np.maximum(np.diag(a), 1e-12))
                a = a / np.outer(scale, scale)
                penalty = ridge * np.eye(k)
                penalty[0, 0] = 0
                betas.append((np.linalg.solve(a + penalty, np.array(xy, float) / scale) / scale).tolist())
            yield frame.drop(columns=["xx", "xy"]).assign(beta=betas)

    return run


def fit_linear(rows: DataFrame, predictors: list[str], by: list[str] = ["win_r", "win_c"], least: int = LEAST_CELLS, ridge: float = 1e-3) -> DataFrame:
    """(by, lo, hi, beta): weighted ridge models of the groups with at least `least` cells, from grouped normal sums."""
    x = [F.lit(1.0), *(F.col(f"mean_{p}") for p in predictors)]
    xx = F.array(*(F.sum(F.col("w") * a * b) for a in x for b in x))
    xy = F.array(*(F.sum(F.col("w") * a * F.col("y")) for a in x))
    sums = rows.groupBy(*by).agg(F.min("y").alias("lo"), F.max("y").alias("hi"), xx.alias("xx"), xy.alias("xy"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    schema = T.StructType([*(sums.schema[c] for c in (*by, "lo", "hi")), T.StructField("beta", T.ArrayType(T.DoubleType()))])
    return sums.mapInPandas(_solve(len(predictors) + 1, ridge), schema)


class Regressor(Protocol):
    """A model of temperature over predictors; it travels pickled, so its parts must be importable by executors."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> object: ...

    def predict(self, model: object, x: np.ndarray) -> np.ndarray: ...


def _named(models: DataFrame, by: list[str], tail: str) -> DataFrame:
    return models.select(*by, *(F.col(c).alias(c + tail) for c in models.columns if c not in by))


def _models(cells: DataFrame, keys: list[str], local: DataFrame, whole: DataFrame) -> DataFrame:
    """A row for each window with cells: its local model, if any, and its scene's."""
    windows = cells.select(*keys, "win_r", "win_c").distinct()
    return windows.join(_named(whole, keys, "_global"), keys).join(_named(local, [*keys, "win_r", "win_c"], "_local"), [*keys, "win_r", "win_c"], "left")


def _linear_predictions(cells: DataFrame, keys: list[str], windows: DataFrame, rows: DataFrame, predictors: list[str], fit: Callable, depth: int) -> DataFrame:
    """cells with t_local and t_global of linear models, in generated code; models and cells meet by scene and window."""
    place = [*keys, "win_r", "win_c"]
    if depth:
        blocks = {f"_b{k}": F.floor(F.col(k) / _BLOCK) for k in CELL}
        whole = fit_tree(rows, predictors, keys, lambda some, table: _attached(some, keys, blocks, table).drop(*blocks), fit, depth, least=LEAST_CELLS)
    else:
        whole = fit(rows, predictors, keys)
    models = _models(cells, keys, fit(windows, predictors, place), whole)
    x = F.array(F.lit(1.0), *(F.col(p) for p in predictors))

    def clipped(tail: str) -> Column:
        value = F.aggregate(F.zip_with(x, "beta" + tail, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.greatest(F.least(value, F.col("hi" + tail)), F.col("lo" + tail))

    plain = F.array(*predictors)
    everywhere = leaf_value("leaves_global", leaf_of("splits_global", plain, depth), plain) if depth else clipped("_global")
    return cells.join(models, place).withColumns({"t_local": F.when(F.col("beta_local").isNotNull(), clipped("_local")), "t_global": everywhere})


def _model_predictions(cells: DataFrame, keys: list[str], windows: DataFrame, rows: DataFrame, predictors: list[str], regressor: Regressor, least: int, most_rows: int) -> DataFrame:
    """cells with t_local and t_global of a user's models: fitted a window a group, applied to a window's fine cells at once.

    A window's coarse and fine cells are bounded by its size. A scene's global model learns
    from at most most_rows of its coarse cells, those of the least hashes of their places.
    """
    means = [f"mean_{p}" for p in predictors]
    place = [*keys, "win_r", "win_c"]

    def trainer(by: list[str], least: int) -> Callable:
        def train(table: pa.Table) -> pa.Table:
            y = table.column("y").to_numpy().astype(float)
            x = np.column_stack([table.column(m).to_numpy().astype(float) for m in means])
            made = [(pickle.dumps(regressor.fit(x, y, table.column("w").to_numpy().astype(float))), float(y.min()), float(y.max()))] if len(y) >= least else []
            found = table.select(by).slice(0, len(made))
            for name, kind, i in (("model", pa.binary(), 0), ("lo", pa.float64(), 1), ("hi", pa.float64(), 2)):
                found = found.append_column(name, pa.array([m[i] for m in made], kind))
            return found

        return train

    def values(models: pa.Table, tail: str, table: pa.Table) -> pa.Array:
        model, lo, hi = (models.column(c + tail)[0].as_py() for c in ("model", "lo", "hi"))
        if model is None:
            return pa.nulls(table.num_rows, pa.float64())
        x = np.column_stack([table.column(p).to_numpy().astype(float) for p in predictors])
        return pa.array(np.clip(regressor.predict(pickle.loads(model), x), lo, hi).astype(float))

    def apply(fine: pa.Table, models: pa.Table) -> pa.Table:
        if not (models.num_rows and fine.num_rows):
            fine = fine.slice(0, 0)
            return fine.append_column("t_local", pa.nulls(0, pa.float64())).append_column("t_global", pa.nulls(0, pa.float64()))
        return fine.append_column("t_local", values(models, "_local", fine)).append_column("t_global", values(models, "_global", fine))

    def fitted(some: DataFrame, by: list[str], least: int) -> DataFrame:
        fields = [*(some.schema[k] for k in by), T.StructField("model", T.BinaryType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]
        return some.select(*by, *means, "y", "w").groupBy(*by).applyInArrow(trainer(by, least), T.StructType(fields))

    some = ranked(rows.select(*keys, *means, "y", "w", F.xxhash64("r", "c").alias("_h"), "r", "c"), keys, [F.col("_h"), F.col("r"), F.col("c")], "_place").filter(F.col("_place") <= most_rows)
    models = _models(cells, keys, fitted(windows, place, least), fitted(some, keys, 1))
    models = models.toDF(*models.columns)  # columns of its own, as both sides come from one table
    schema = T.StructType([*cells.schema.fields, T.StructField("t_local", T.DoubleType()), T.StructField("t_global", T.DoubleType())])
    return cells.groupBy(*place).cogroup(models.groupBy(*place)).applyInArrow(apply, schema)


def sharpen(
    fine: DataFrame,
    coarse: DataFrame,
    factor: int,
    predictors: list[str],
    temperature: str,
    window: int = 15,
    margin: float = 0.25,
    fit: Callable[[DataFrame, list[str], list[str]], DataFrame] = fit_linear,
    regressor: Regressor | None = None,
    most_rows: int = 200_000,
    keys: list[str] = [],
    depth: int = 0,
) -> DataFrame:
    """(keys, r, c, t_sharp) of every fine cell with all predictors.

    keys (date, tile) tell scenes apart in both tables: training quantiles, windows, models,
    blends and residuals are those of the scene, and all scenes are sharpened in one plan.
    Rows with a NULL key drop. Scenes need as many training cells as one linear model.

    Windows are of `window` coarse cells. Local and global predictions, each clipped
    to its training range, are blended in fourth powers by the inverse squares of their
    coarse residuals; the blend's own coarse residual is added back bilinearly. Models
    are linear (`fit` gives their betas from training rows, grouped by the columns named), or
    any `regressor` with fit and predict over arrays: trees, rules, networks. Its global
    model is fitted on at most most_rows training rows of a scene. With a depth, the global
    model of `fit` is a regression tree of that depth with linear leaves.
    """
    by = keys or ONE
    rows = _scene(training_rows(fine, coarse, factor, predictors, temperature, keys=keys), by)
    ready = _scene(fine, by)
    for p in [*predictors, *keys]:
        ready = ready.filter(F.col(p).isNotNull())
    step = factor * window
    at = ready.select(*by, "r", "c", *predictors).withColumns({"win_r": F.floor(F.col("r") / step).cast("int"), "win_c": F.floor(F.col("c") / step).cast("int")})
    windows = assign_windows(rows, window, margin)
    both = _linear_predictions(at, by, windows, rows, predictors, fit, depth) if regressor is None else _model_predictions(at, by, windows, rows, predictors, regressor, LEAST_CELLS, most_rows)
    # written once: means, blend and residual all read the predictions
    cells = materialise(both.select(*by, "r", "c", "t_local", "t_global", *((F.floor(F.col(k) / factor)).cast("long").alias(f"b{k}") for k in CELL)), "predicted")
    fourth = lambda c: F.col(c) * F.col(c) * F.col(c) * F.col(c)
    block = [*by, "br", "bc"]
    low = _scene(coarse, by).select(*by, F.col("r").alias("br"), F.col("c").alias("bc"), F.col(temperature).alias("y"))
    means = cells.groupBy(*block).agg(F.avg(fourth("t_local")).alias("ml"), F.avg(fourth("t_global")).alias("mg")).join(low, block)
    inverse = lambda m: 1 / F.greatest(F.pow(F.col("y") - F.pow(m, F.lit(0.25)), F.lit(2.0)), F.lit(1e-6))
    weights = means.select(*block, "y", F.when(F.col("ml").isNotNull(), inverse("ml")).otherwise(0.0).alias("wl"), inverse("mg").alias("wg"))
    blend = F.pow((F.coalesce(F.col("wl") * fourth("t_local"), F.lit(0.0)) + F.col("wg") * fourth("t_global")) / (F.col("wl") + F.col("wg")), F.lit(0.25))
    mixed = materialise(cells.join(weights, block).select(*by, "r", "c", "br", "bc", "y", blend.alias("t")), "blend")
    left = mixed.groupBy(*block).agg((F.first("y") - F.pow(F.avg(fourth("t")), F.lit(0.25))).alias("residual")).select(*by, F.col("br").alias("r"), F.col("bc").alias("c"), "residual")
    centres = mixed.select(*by, F.col("r").alias("fr"), F.col("c").alias("fc"), ((F.col("r") + 0.5) / factor).alias("y"), ((F.col("c") + 0.5) / factor).alias("x"))
    back = resample_bilinear(left, centres, 0, 0, 1, 1, "residual", ["fr", "fc"], by).select(*by, F.col("fr").alias("r"), F.col("fc").alias("c"), "residual")
    out = mixed.join(back, [*by, "r", "c"], "left")
    return out.select(*keys, "r", "c", (F.col("t") + F.coalesce("residual", F.lit(0.0))).alias("t_sharp"))
