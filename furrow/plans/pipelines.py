"""End-to-end products."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.functions import formulas
from furrow.operators import composite, grids, labels, masks, sampling, scoring, temporal, vectors
from furrow.plans.fluxes import run_fluxes
from furrow.plans.sharpen import sharpen
from furrow.session import materialise


#: The predictor that a worker process holds, by the broadcast that its model came in.
_OPENED: dict[object, Callable[[np.ndarray], np.ndarray]] = {}


def infer_chips(
    cells: DataFrame,
    channels: list[str],
    size: int,
    predict: Callable[[np.ndarray], np.ndarray] | None,
    bands: list[str],
    model: bytes | None = None,
    load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]] | None = None,
    batch: int = 16,
    loads: Accumulator | None = None,
) -> DataFrame:
    """Predicted bands of every chip of exploded cells: row_start, col_start, in_r, in_c and the bands.

    Either `predict` maps a chip's (channel, size, size) to (band, size, size), or `load`
    makes of the bytes of a model a predictor of batches, (chip, channel, size, size) to
    (chip, band, size, size). The bytes are broadcast once and opened once a worker
    process (counted in `loads`); a task holds `batch` chips at a time. Missing cells are
    NaN going in, and have no row coming out.
    """
    sent = None if model is None else cells.sparkSession.sparkContext.broadcast(model)
    chip, place = ["row_start", "col_start"], ["in_r", "in_c"]
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in (*chip, *place)), *(T.StructField(b, T.DoubleType()) for b in bands)])

    def opened() -> Callable[[np.ndarray], np.ndarray]:
        if sent is None:
            return lambda images: np.stack([predict(image) for image in images])
        key = (sent._path, len(sent.value))
        if key not in _OPENED:
            _OPENED.clear()
            _OPENED[key] = load(sent.value)
            if loads is not None:
                loads.add(1)
        return _OPENED[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_of, arrow = opened(), to_arrow_schema(schema)

        def predicted(frame: pd.DataFrame) -> pa.RecordBatch:
            number = frame["chip"].to_numpy()
            number = number - number[0]
            r, c = (frame[k].to_numpy() for k in place)
            images = np.full((number[-1] + 1, len(channels), size, size), np.nan)
            images[number, :, r, c] = frame[channels].to_numpy(float)
            found = model_of(images)[number, :, r, c]
            columns = [*(frame[k].to_numpy() for k in (*chip, *place)), *found.T.astype(float)]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        left = None
        for some in batches:
            frame = some.to_pandas()
            if not len(frame):
                continue
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            new = (frame[chip].diff().fillna(0) != 0).any(axis=1)
            frame["chip"] = new.cumsum()
            while int(frame["chip"].iloc[-1]) - int(frame["chip"].iloc[0]) >= batch:
                stop = int(frame["chip"].iloc[0]) + batch
                yield predicted(frame[frame["chip"] < stop])
                frame = frame[frame["chip"] >= stop]
            left = frame.drop(columns="chip")
        if left is not None:
            yield predicted(left.assign(chip=(left[chip].diff().fillna(0) != 0).any(axis=1).cumsum()))

    dealt = cells.select(*(F.col(k).cast("long").alias(k) for k in (*chip, *place)), *channels).repartition(*chip).sortWithinPartitions(*chip)
    return dealt.mapInArrow(run, schema)


def field_pipeline(cells: DataFrame, n_rows: int, n_cols: int, channels: list[str], predict: Callable, size: int, overlap: int, t_ext: float, t_bound: float, cell: float, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Fields with area and outline length from image cells; with a reference (r, c, ref), also their best IoU.

    Chips, inference, mosaic without the overlap, segmentation across tiles, polygons.
    """
    chips = infer_chips(grids.explode_to_chips(cells, n_rows, n_cols, size, overlap), channels, size, predict, ["extent", "boundary"])
    extent, boundary = (grids.stitch_chips(chips.select("row_start", "col_start", "in_r", "in_c", b), size, overlap, b) for b in ("extent", "boundary"))
    fields = labels.segment_fields(grids.stack_layers(extent, boundary), t_ext, t_bound).withColumn("field", F.when(F.col("field") < 0, 0).otherwise(F.col("field") + 1))
    shapes = vectors.polygonise(fields, "field", cell)
    if reference is None:
        return shapes, None
    pairs = labels.pair_counts(reference.join(fields, ["r", "c"]), "ref", "field")
    return shapes, labels.best_iou(pairs, "ref", "field", mode="dedup")


def et_pipeline(obs: DataFrame, hourly: DataFrame, canopy: DataFrame, start: str, end: str, ground: DataFrame | None = None, window: int = 4) -> tuple[DataFrame, DataFrame]:
    """Daily ET per pixel, and its median over the dates, from thermal scenes, hourly weather and canopy rows (pixel, lai, h_c).

    hourly has hour, t2m, ssrd (J/m2), u100, v100, ea. Best clear scene of a day, weather
    at its time, balance, and scaling by the day's mean radiation. Canopy rows with a
    comp_date hold for the days within `window` of it, the nearest composite of a day
    and then the earlier one. ground, if given, has pixel with bnr (near infrared),
    landcover, dem and geopot: water and unclassified pixels drop, air temperature and
    pressure are corrected for terrain. Scenes are taken at the resolution they have;
    sharpened_et() sharpens them first. Daily rows carry the balance's
    flag and its steps.
    """
    best = _best_scenes(obs, hourly)
    if "comp_date" in canopy.columns:
        canopy = _on_days(canopy, best, window)
    daily = _daily_et(best, hourly, canopy, None if ground is None else _dry_ground(ground, ["pixel"]))
    return daily, composite.et_median(daily.filter("et IS NOT NULL"), start, end, day="day")


def _best_scenes(obs: DataFrame, hourly: DataFrame) -> DataFrame:
    """Best clear observation of a pixel and day that is not colder than the air."""
    with_air = temporal.interp_hourly(masks.mask_lst_quality(obs), hourly, "ts", "hour", ["t2m"])
    return composite.best_pixel(masks.mask_lst_air(with_air)).filter("lst IS NOT NULL")


def _on_days(composites: DataFrame, days: DataFrame, window: int) -> DataFrame:
    """Rows of the nearest composite (the earlier of two) within `window` of each day."""
    met = temporal.window_join(composites.select("comp_date").distinct(), days.select("day").distinct(), "comp_date", "day", window)
    far = F.abs(F.datediff("comp_date", "day"))
    nearest = met.groupBy("day").agg(F.min(F.struct(far.alias("far"), "comp_date")).alias("near")).select("day", "near.comp_date")
    return composites.join(nearest, "comp_date").drop("comp_date")


def _dry_ground(ground: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that are neither water nor unclassified, with their height and geopotential."""
    dry = masks.mask_water(ground, ["landcover"]).filter("landcover IS NOT NULL")
    return masks.mask_landcover(dry, "landcover", "zero").filter("mask = 1").select(*keys, "dem", "geopot")


def _daily_et(best: DataFrame, hourly: DataFrame, canopy: DataFrame, ground: DataFrame | None) -> DataFrame:
    """(pixel, day, flag, steps, et) of observations (pixel, day, ts, lst, vza), weather, canopy by pixel or by pixel and day, and dry ground."""
    weather = formulas.WIND.apply(hourly).withColumn("s_dn", temporal.flux_from_accumulated(F.col("ssrd"))).select("hour", "t2m", "wind", "ea", "s_dn")
    at = temporal.interp_hourly(best, weather, "ts", "hour", ["t2m", "wind", "ea", "s_dn"])
    mean = temporal.daily_radiation(weather, "hour", "s_dn").select("day", F.col("mean_flux").alias("s_mean"))
    rows = at.join(canopy, ["pixel", "day"] if "day" in canopy.columns else ["pixel"])
    rows = rows.join(mean, "day").withColumns({"t_a": F.col("t2m"), "p": F.lit(1013.25)})
    if ground is not None:
        terrain = {"sp": F.col("p"), "rate": F.lit(0.0065), "blend": F.lit(100.0)}
        rows = formulas.TERRAIN.apply(rows.join(ground, "pixel").withColumns(terrain)).withColumns({"t_a": F.col("t_terrain"), "p": F.col("p_terrain")}).drop(*formulas.TERRAIN.columns, *terrain, "dem", "geopot")
    rows = rows.withColumns({"t_r": F.col("lst"), "u": F.col("wind"), "doy": F.dayofyear("day"), "hr": F.hour("ts") + F.minute("ts") / 60.0})
    fluxes = run_fluxes(rows, ["pixel", "day"]).select("pixel", "day", "flag", "steps", "le")
    scaled = rows.select("pixel", "day", "s_mean", F.col("s_dn").alias("s_inst"), "t_a", "ea", "p").join(fluxes, ["pixel", "day"])
    return formulas.DAILY_ET.apply(formulas.AIR.apply(scaled)).select("pixel", "day", "flag", "steps", F.col("et_daily").alias("et"))


def sharpened_et(
    obs: DataFrame,
    composites: DataFrame,
    factor: int,
    predictors: list[str],
    hourly: DataFrame,
    canopy: DataFrame,
    ground: DataFrame,
    window: int = 4,
    block: int = 15,
) -> DataFrame:
    """(r, c, day, t_sharp, flag, steps, et): daily ET of fine cells from coarse thermal scenes, all days in one plan.

    obs are coarse observations with r, c (and the columns that et_pipeline reads but
    pixel); composites have comp_date, r, c and the predictors on the fine grid, `factor`
    times finer; canopy has r, c, lai, h_c, and ground r, c, bnr, landcover, dem, geopot
    there. Each day takes the nearest composite within `window` days; water and
    unclassified cells drop before sharpening; windows are of `block` coarse cells. Fine
    cells take time, angle and weather of their coarse cell's best scene, whose
    temperature is sharpened day by day; air temperature and pressure follow the terrain.
    Days without a composite, or with fewer clear cells than a model needs, have no rows.
    """
    coarse = materialise(_best_scenes(obs.withColumn("pixel", labels.cell_key(F.col("r").cast("long"), F.col("c").cast("long"))), hourly), "scenes")
    place = {"r": F.shiftright("pixel", 32), "c": F.col("pixel").bitwiseAND((1 << 32) - 1)}
    coarse = coarse.withColumns(place).select("day", "r", "c", "lst", "ts", "vza")
    dry = _dry_ground(ground, ["r", "c"])
    fine = _on_days(composites, coarse, window).join(dry.select("r", "c"), ["r", "c"])
    sharp = sharpen(fine, coarse.select("day", "r", "c", "lst"), factor, predictors, "lst", window=block, keys=["day"])
    parents = coarse.select("day", F.col("r").alias("br"), F.col("c").alias("bc"), "ts", "vza")
    cells = sharp.withColumns({f"b{k}": F.floor(F.col(k) / factor).cast("long") for k in ("r", "c")}).join(parents, ["day", "br", "bc"])
    pixel = labels.cell_key(F.col("r"), F.col("c"))
    # written once: the balance and the result read the sharpened cells
    best = materialise(cells.select(pixel.alias("pixel"), "day", F.col("t_sharp").alias("lst"), "ts", "vza"), "sharpened")
    keyed = [d.withColumn("pixel", pixel).drop("r", "c") for d in (canopy, dry)]
    daily = _daily_et(best, hourly, *keyed)
    return daily.join(best.select("pixel", "day", F.col("lst").alias("t_sharp")), ["pixel", "day"]).withColumns(place).select("r", "c", "day", "t_sharp", "flag", "steps", "et")


def compare_maps(reference: DataFrame, maps: dict[str, DataFrame], cell: float, grid: DataFrame, exclude: Sequence[str] = (), per_decile: int | None = None, seed: int | None = None) -> DataFrame:
    """IoU surfaces of several parcel maps (field_id, ring) against a reference (field_id, category, area_ha, ring), by map name.

    The reference is cleaned first: excluded categories, repeated outlines and repeated
    ids drop, and per_decile parcels of each size decile are drawn (all, if None). Each
    parcel meets the parcel of a map that covers most of it, the least id on ties.
    """
    kept = masks.drop_repeated_ids(masks.clean_parcels(reference, "category", exclude, ["ring"]), "field_id")
    if per_decile is not None:
        kept = sampling.sample_per_decile(kept, "field_id", "area_ha", per_decile, seed=seed)
    kept = materialise(kept.select(F.col("field_id").alias("ref"), "ring"), "reference")
    out = None
    for name, other in maps.items():
        pairs = vectors.overlay_pairs(kept, other.select(F.col("field_id").alias("id"), "ring"), "ref", "id", cell)
        best = pairs.groupBy("ref").agg(F.max_by(F.struct("overlap_a", "overlap_b", "iou"), F.struct(F.col("overlap_a"), (-F.col("id")))).alias("b")).select("ref", "b.*")
        one = scoring.iou_surface(best, grid).withColumn("map", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
