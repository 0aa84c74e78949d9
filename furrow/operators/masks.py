"""Quality, land-cover and plausibility masks: a masked value becomes NULL, rows stay."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Land-cover codes that count as agricultural.
AGRICULTURAL_CODES = [200, 1101, 1102, 1103, 1201, 1202, 1300, 1401, 1402, 1501, 1502, 1602, 1603, 1611, 1612, 1613, 1614, 3002, 3003, 4002, 4003]

# Mean and standard deviation of the four image channels.
CHANNEL_STATS = {
    "BLU": (544.18573, 371.41626),
    "GRN": (767.61194, 389.81952),
    "RED": (717.12860, 479.89127),
    "BNR": (2856.1428, 951.73022),
}

# Colour codes and the sensor bands they stand for.
SENSOR_BANDS = {
    "BLU": "B02",
    "GRN": "B03",
    "RED": "B04",
    "RE1": "B05",
    "RE2": "B06",
    "RE3": "B07",
    "BNR": "B08",
    "NIR": "B8A",
    "SW1": "B11",
    "SW2": "B12",
}


def mask_lst_quality(df: DataFrame, confidence_high: int = 32678) -> DataFrame:
    """lst NULL where cloudy (bayes = 2), of middling confidence, or below freezing.

    confidence_high defaults to the published workflow's 32678 (32768 may be meant).
    """
    good = (F.col("bayes") != 2) & ((F.col("confidence") < 16384) | (F.col("confidence") >= confidence_high)) & (F.col("lst") >= 273.15)
    return df.withColumn("lst", F.when(good, F.col("lst")))


def mask_lst_air(df: DataFrame, air: str = "t2m", least: float = -2.0) -> DataFrame:
    """lst NULL where it is over two kelvin colder than the air."""
    return df.withColumn("lst", F.when(F.col("lst") - F.col(air) >= least, F.col("lst")))


def mask_water(df: DataFrame, bands: Iterable[str], nir: str = "bnr", least: float = 500.0) -> DataFrame:
    dry = F.col(nir) >= least
    return df.withColumns({b: F.when(dry, F.col(b)) for b in bands})


def mask_landcover(df: DataFrame, code: str, mode: str = "codes", codes: Iterable[int] = AGRICULTURAL_CODES, value: str | None = None) -> DataFrame:
    """Column `mask` of 1 and 0, multiplied into `value` if one is named.

    mode: codes (listed codes are 1), nodata (-9999 is 0, the rest 1), zero (0 is 0).
    """
    keep = {"codes": F.col(code).isin(*codes), "nodata": F.col(code) != -9999, "zero": F.col(code) != 0}[mode]
    out = df.withColumn("mask", F.when(keep, 1).otherwise(0))
    return out.withColumn(value, F.col(value) * F.col("mask")) if value else out


def mask_valid_inputs(df: DataFrame, needed: Iterable[str], cols: Iterable[str]) -> DataFrame:
    """All of cols NULL unless every needed one is positive."""
    good: Column = F.lit(True)
    for c in needed:
        good = good & F.coalesce(F.col(c) > 0, F.lit(False))
    return df.withColumns({c: F.when(good, F.col(c)) for c in cols})


def clean_parcels(df: DataFrame, category: str, exclude: Iterable[str], geometry: Iterable[str]) -> DataFrame:
    """Drop excluded and missing categories and null geometry; one row per geometry, the least field_id."""
    geometry = list(geometry)
    kept = df.filter(F.col(category).isNotNull() & ~F.col(category).isin(*exclude))
    for g in geometry:
        kept = kept.filter(F.col(g).isNotNull())
    others = [c for c in df.columns if c not in geometry]
    first = kept.groupBy(*geometry).agg(F.min_by(F.struct(*others), "field_id").alias("_f"))
    return first.select(*geometry, *(F.col(f"_f.{c}").alias(c) for c in others)).select(*df.columns)


def filter_months(df: DataFrame, ts: str, low: int, high: int) -> DataFrame:
    return df.filter(F.month(ts).between(low, high))


def standardise(df: DataFrame, channel: str, value: str, stats: dict[str, tuple[float, float]] = CHANNEL_STATS) -> DataFrame:
    """Column z: (value - mean) / std of the row's channel; NULL for other channels."""
    z = None
    for name, (mean, std) in stats.items():
        hit = (F.col(value) - mean) / std
        z = F.when(F.col(channel) == name, hit) if z is None else z.when(F.col(channel) == name, hit)
    return df.withColumn("z", z)


def with_ndvi(df: DataFrame, red: str, nir: str, non_negative: bool = False) -> DataFrame:
    ndvi = (F.col(nir) - F.col(red)) / F.nullif(F.col(nir) + F.col(red), F.lit(0.0))
    return df.withColumn("ndvi", F.greatest(ndvi, F.lit(0.0)) if non_negative else ndvi)


def filter_min_size(df: DataFrame, size: str, more_than: float) -> DataFrame:
    return df.filter(F.col(size) > more_than)


def drop_repeated_ids(df: DataFrame, ident: str) -> DataFrame:
    """Only rows whose id occurs once. Counts are joined, so a frequent id fills no task."""
    single = df.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(ident)
    return df.join(single, ident, "left_semi")


def clamp_et(value: Column, most: float = 12.0) -> Column:
    """Daily ET outside (0, most] counts as 0."""
    return F.when((value <= 0) | (value > most), F.lit(0.0)).otherwise(value)


def split_vegetation(df: DataFrame, fc: str = "f_c", lai: str = "lai") -> DataFrame:
    """Column bare: no green cover or no leaf area."""
    return df.withColumn("bare", (F.coalesce(F.col(fc), F.lit(0.0)) <= 0.01) | (F.coalesce(F.col(lai), F.lit(0.0)) <= 0))


def rename_bands(df: DataFrame, band: str, names: dict[str, str] = SENSOR_BANDS) -> DataFrame:
    """band through a fixed map; unknown names become NULL."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return df.withColumn(band, F.element_at(pairs, F.col(band)))
