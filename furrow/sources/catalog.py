"""Scene catalogues, file names, inventories, station tables and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.masks import SENSOR_BANDS

# Names of months in order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def catalog_query(df: DataFrame, start: str, end: str, box: tuple[float, float, float, float], when: str = "datetime") -> DataFrame:
    """Scenes from start 00:00:00 to end 23:59:59 whose box meets (x0, y0, x1, y1); all conditions reach the scan."""
    t = F.col(when)
    inside = (t >= F.lit(f"{start} 00:00:00").cast(df.schema[when].dataType)) & (t <= F.lit(f"{end} 23:59:59").cast(df.schema[when].dataType))
    return df.filter(inside & (F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1]))


def sign_assets(df: DataFrame, token: str, assets: str = "assets") -> DataFrame:
    """Append ?token to the link of every asset of a map<string, struct<href, ...>>."""
    return df.withColumn(assets, F.transform_values(assets, lambda k, v: F.when(v.isNotNull(), v.withField("href", F.concat(v["href"], F.lit("?"), F.lit(token))))))


def bad_assets(df: DataFrame, assets: str = "assets") -> DataFrame:
    """Rows that have assets without a value, with their keys."""
    return df.withColumn("bad", F.map_keys(F.map_filter(assets, lambda k, v: v.isNull()))).filter(F.size("bad") > 0)


def parse_scene_name(df: DataFrame, name: str) -> DataFrame:
    """tile, scene_date, month_name, band and sensor band out of names such as X0057_Y0044/20190406_..._BNR.tif."""
    text = F.col(name)
    tile = F.nullif(F.regexp_extract(text, r"(X\d{4}_Y\d{4})", 1), F.lit(""))
    date = F.try_to_date(F.nullif(F.regexp_extract(text, r"(?:^|[/_])(\d{8})(?:[_.]|$)", 1), F.lit("")), "yyyyMMdd")
    band = F.nullif(F.regexp_extract(text, r"_([A-Z]{2}[A-Z0-9])(?:_|\.tif$)", 1), F.lit(""))
    sensor = F.element_at(F.create_map(*(F.lit(x) for kv in SENSOR_BANDS.items() for x in kv)), band)
    month = F.element_at(F.array(*(F.lit(m) for m in MONTHS)), F.month(date))
    return df.withColumns({"tile": tile, "scene_date": date, "month_name": month, "band": band, "sensor_band": sensor})


def same_month(files: DataFrame, of: DataFrame, date: str = "scene_date") -> DataFrame:
    """Files of the same year and month as any row of `of`."""
    key = lambda d: d.withColumns({"_y": F.year(date), "_m": F.month(date)})
    return key(files).join(key(of).select("_y", "_m").distinct(), ["_y", "_m"], "left_semi").drop("_y", "_m")


def list_scenes(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, size and time of every file below root with exactly this suffix, in path order; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime").orderBy("path")


def scene_counts(df: DataFrame, tile: str, when: str, years: list[int]) -> DataFrame:
    """Scenes per tile (rows) and year (columns y2019 ...)."""
    return df.groupBy(tile).agg(*(F.count_if(F.year(when) == y).alias(f"y{y}") for y in years))


def audit_complete(df: DataFrame, keys: list[str], expected: DataFrame, n: int) -> DataFrame:
    """Expected keys whose number of rows isn't n, with what was found (0 for absent ones)."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"))
    return expected.join(found, keys, "left").select(*keys, F.coalesce("n_found", F.lit(0)).alias("n_found")).filter(F.col("n_found") != n)


def check_dates(df: DataFrame, tile: str, date: str) -> DataFrame:
    """The common dates, if every tile has the same set; else no row.

    Sets agree exactly if every date occurs in every tile, so two counts suffice.
    """
    pairs = df.select(tile, date).distinct()
    tiles = pairs.agg(F.count_distinct(tile).alias("n_tiles"))
    per_date = pairs.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    ok = per_date.agg(F.min("n").alias("least")).crossJoin(tiles).filter("least = n_tiles")
    return per_date.select(date).join(F.broadcast(ok.select("n_tiles")), how="cross").select(date)


def order_bands(df: DataFrame, colours: list[str], n_days: int, n_tiles: int) -> DataFrame:
    """Rows in band, date, tile order with their place in the band list; fails unless there is one per band, day and tile."""
    if (found := df.filter(F.col("band").isin(*colours)).count()) != (wanted := len(colours) * n_days * n_tiles):
        raise ValueError(f"{found} layers for {wanted} places")
    place = F.array_position(F.array(*(F.lit(c) for c in colours)), F.col("band")).cast("int") - 1
    return df.filter(F.col("band").isin(*colours)).withColumn("place", place).orderBy("place", "scene_date", "tile")


# Required columns of a station table and those of a result table, in order.
STATION_REQUIRED = ["year", "DOY", "time", "T_R1", "VZA", "T_A1", "u", "ea", "S_dn", "LAI", "h_C"]
STATION_RESULT = ["Year", "DOY", "Time", "LAI", "f_g", "VZA", "SZA", "SAA", "L_dn", "Rn_model", "Rn_sw_veg", "Rn_sw_soil", "Rn_lw_veg", "Rn_lw_soil", "T_C", "T_S", "T_AC", "LE_model", "H_model", "LE_C", "H_C", "LE_S", "H_S", "G_model", "R_S", "R_x", "R_A", "u_friction", "L", "Skyl", "z_0M", "d_0", "flag"]


def station_time(year: Column, doy: Column, hour: Column) -> Column:
    """Timestamp of a year, a day of year and a decimal hour."""
    midnight = F.unix_timestamp(F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), doy.cast("int") - 1).cast("timestamp"))
    return F.timestamp_seconds(midnight + F.round(hour * 3600))


def read_station(spark: SparkSession, path: str, required: list[str] = STATION_REQUIRED) -> DataFrame:
    """A white-space separated table with a header line: all columns as doubles, and ts.

    Fails if a required column is missing; further columns stay. The header is the
    line with the required names; NULL where a field isn't a number.
    """
    lines = spark.read.text(path)
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    # files come in no order, so the header is looked for, not taken as the first row
    head = lines.filter(F.arrays_overlap(fields, F.array(*(F.lit(c) for c in required)))).first()
    names = head[0].split() if head else []
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    rows = lines.filter((F.trim("value") != "") & (F.col("value") != head[0]))
    table = rows.select(*(F.get(fields, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))
    return table.withColumn("ts", station_time(F.col("year"), F.col("DOY"), F.col("time")))


def write_station(df: DataFrame, path: str, columns: list[str] = STATION_RESULT) -> None:
    """Tab-separated result columns in their fixed order; absent ones are empty."""
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns)).write.option("sep", "\t").option("header", "true").mode("overwrite").csv(path)


def write_pixels(df: DataFrame, path: str, by: list[str] = ["tile", "date"], deal: int = 8) -> None:
    """Pixel table partitioned by tile and date, rows of a file in (r, c) order so that row groups prune.

    Only partitions that df has rows of are replaced, each as a whole; all others keep
    their files, so a rerun writes what plan_backfill() asks for. A partition is written by up
    to `deal` tasks, as a tile may hold any share of the rows.
    """
    dealt = df.repartition(*by, F.pmod(F.xxhash64(F.floor(F.col("r") / 64), F.floor(F.col("c") / 64)), F.lit(deal)))
    dealt.sortWithinPartitions(*by, "r", "c").write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def written_partitions(spark: SparkSession, path: str, by: list[str] = ["tile", "date"]) -> DataFrame:
    """The manifest of a pixel table: (by, n_files, n_bytes, written) of every partition, from its files' metadata alone; empty where nothing is written yet."""
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in by), T.StructField("n_files", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("written", T.TimestampType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "modificationTime")
    keys = {k: F.url_decode(F.regexp_extract("path", f"/{k}=([^/]*)/", 1)) for k in by}
    known = files.withColumns({k: F.when(v != "__HIVE_DEFAULT_PARTITION__", v) for k, v in keys.items()})
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.max("modificationTime").alias("written"))


def write_layer(df: DataFrame, table: str, buckets: int, keys: list[str] = ["r", "c"]) -> None:
    """A layer as a table of the catalogue, dealt into buckets by its cell keys and sorted within them.

    Layers with equal keys and buckets meet without a shuffle. Choose buckets by bytes
    (about 128 MB each): they are the tasks of every join of these layers. Each bucket is
    one file, as its rows are dealt by the same hash before they are written.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("overwrite").saveAsTable(table)


def read_layer(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def read_pixels(spark: SparkSession, path: str, nodata: float | None = None, bands: list[str] = []) -> DataFrame:
    df = spark.read.parquet(path)
    return df if nodata is None else df.withColumns({b: F.nullif(F.col(b), F.lit(nodata)) for b in bands})


def read_results(spark: SparkSession, glob: str, schema: T.StructType | str, ident: str) -> DataFrame:
    """Many CSV results with the folder each came from; rows of id 0 drop."""
    df = spark.read.option("header", "true").schema(schema).csv(glob)
    return df.withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).filter(F.col(ident) != 0)


def plan_backfill(requested: DataFrame, done: DataFrame, failed: DataFrame, sharpened: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to run and from which stage: `flux` if its sharpened half is there, else `sharpen`."""
    left = requested.join(done, keys, "left_anti").join(failed, keys, "left_anti")
    half = sharpened.select(*keys).distinct().withColumn("_s", F.lit(True))
    return left.join(half, keys, "left").select(*keys, F.when(F.col("_s"), "flux").otherwise("sharpen").alias("stage"))


def collection_extent(df: DataFrame, when: str = "datetime") -> DataFrame:
    return df.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min(when).alias("first"), F.max(when).alias("last"), F.count(F.lit(1)).alias("n"))


def check_contract(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences between a table's columns and a contract; empty if it holds."""
    have = {f.name: f.dataType for f in df.schema}
    out = [f"{f.name} is missing" for f in schema if f.name not in have]
    out += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType]
    return out
