"""Masks, temporal operators, joins, aggregations, sampling, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators import composite, focal, grids, labels, masks, sampling, scoring, sets, temporal
from furrow.plans.registry.base import Source, query, rounded
from furrow.session import fresh_path
from furrow.sources import catalog

R6 = lambda c, n=6: rounded(c, n).alias(c)


# --- masks -------------------------------------------------------------------

@query("p1_lst_quality", "SELECT pixel, seq, CASE WHEN bayes <> 2 AND (confidence < 16384 OR confidence >= 32678) AND lst >= 273.15 THEN round(lst, 6) END AS lst FROM lst_obs", "lst_obs")
def _(s: Source):
    return masks.mask_lst_quality(s.view("lst_obs")).select("pixel", "seq", R6("lst"))


_T2 = """o AS (SELECT *, date_trunc('hour', ts) AS h0 FROM lst_obs),
i AS (SELECT o.pixel, o.seq, o.ts, o.lst, o.vza, o.vaa, o.bayes, o.confidence, a.t2m - (a.t2m - b.t2m) * (extract(minute FROM o.ts) / 60.0) AS t2m
      FROM o JOIN met_hourly a ON a.hour = o.h0 JOIN met_hourly b ON b.hour = o.h0 + INTERVAL 1 HOUR)"""


@query("p2_lst_air", f"WITH {_T2} SELECT pixel, seq, CASE WHEN lst - t2m >= -2 THEN round(lst, 6) END AS lst FROM i", "lst_obs met_hourly")
def _(s: Source):
    obs = temporal.interp_hourly(s.view("lst_obs"), s.view("met_hourly"), "ts", "hour", ["t2m"])
    return masks.mask_lst_air(obs).select("pixel", "seq", R6("lst"))


@query("p3_water_mask", "SELECT r, c, CASE WHEN bnr >= 500 THEN round(red, 6) END AS red, CASE WHEN bnr >= 500 THEN round(bnr, 6) END AS bnr FROM pixels", "pixels")
def _(s: Source):
    return masks.mask_water(s.view("pixels"), ["red", "bnr"]).select("r", "c", R6("red"), R6("bnr"))


@query(
    "p4_landcover_mask",
    "SELECT p_partkey, CASE WHEN p_size * 100 + 1 IN (200,1101,1102,1103,1201,1202,1300,1401,1402,1501,1502,1602,1603,1611,1612,1613,1614,3002,3003,4002,4003) THEN 1 ELSE 0 END AS mask_codes, CASE WHEN p_size <> 1 THEN 1 ELSE 0 END AS mask_zero FROM part",
)
def _(s: Source):
    part = s.table("part").withColumns({"code": F.col("p_size") * 100 + 1, "shifted": F.col("p_size") - 1})
    a = masks.mask_landcover(part, "code").withColumnRenamed("mask", "mask_codes")
    return masks.mask_landcover(a, "shifted", "zero").select("p_partkey", "mask_codes", F.col("mask").alias("mask_zero"))


@query("p5_valid_inputs", "SELECT event_id, CASE WHEN value > 50 AND event_id % 7 > 0 THEN value END AS value, CASE WHEN value > 50 AND event_id % 7 > 0 THEN user_id END AS user_id FROM events")
def _(s: Source):
    df = s.table("events").withColumns({"a": F.col("value") - 50, "b": F.col("event_id") % 7})
    return masks.mask_valid_inputs(df, ["a", "b"], ["value", "user_id"]).select("event_id", "value", "user_id")


@query("p6_clean_parcels", "SELECT min(field_id) AS field_id, arg_min(category, field_id) AS category, gx, gy, side FROM (SELECT field_id, category, field_id % 5 AS gx, CAST(floor(y0 / 400) AS BIGINT) AS gy, round(x1 - x0, 3) AS side FROM parcels) WHERE category NOT IN ('ECONOMY') GROUP BY gx, gy, side", "parcels")
def _(s: Source):
    p = s.view("parcels").select("field_id", "category", (F.col("field_id") % 5).alias("gx"), F.floor(F.col("y0") / 400).cast("long").alias("gy"), rounded(F.col("x1") - F.col("x0"), 3).cast("double").alias("side"))
    return masks.clean_parcels(p, "category", ["ECONOMY"], ["gx", "gy", "side"])


@query("p7_month_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE extract(month FROM o_orderdate) BETWEEN 3 AND 10")
def _(s: Source):
    return masks.filter_months(s.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 3, 10)


@query("p8_rename_bands", "SELECT event_id, CASE event_type WHEN 'click' THEN 'B02' WHEN 'view' THEN 'B03' WHEN 'purchase' THEN 'B04' END AS band FROM events")
def _(s: Source):
    df = s.table("events").select("event_id", F.col("event_type").alias("band"))
    return masks.rename_bands(df, "band", {"click": "B02", "view": "B03", "purchase": "B04"})


@query("p9_standardise", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN round((value*10 - 544.18573) / 371.41626, 6) WHEN 1 THEN round((value*10 - 767.61194) / 389.81952, 6) WHEN 2 THEN round((value*10 - 717.12860) / 479.89127, 6) WHEN 3 THEN round((value*10 - 2856.1428) / 951.73022, 6) END AS z FROM events")
def _(s: Source):
    names = F.array(*(F.lit(x) for x in ("BLU", "GRN", "RED", "BNR", "NIR")))
    df = s.table("events").select("event_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("channel"), (F.col("value") * 10).alias("v"))
    return masks.standardise(df, "channel", "v").select("event_id", R6("z"))


@query("p10_ndvi", "SELECT r, c, round((bnr - red) / nullif(bnr + red, 0), 6) AS ndvi FROM pixels", "pixels")
def _(s: Source):
    return masks.with_ndvi(s.view("pixels"), "red", "bnr").select("r", "c", R6("ndvi"))


@query("p10_ndvi_non_negative", "SELECT r, c, round(greatest((bnr - red) / nullif(bnr + red, 0), 0), 6) AS ndvi FROM pixels", "pixels")
def _(s: Source):
    return masks.with_ndvi(s.view("pixels"), "red", "bnr", True).select("r", "c", R6("ndvi"))


@query("p11_min_size", "SELECT field_id, category FROM parcels WHERE area_ha > 0.05", "parcels")
def _(s: Source):
    return masks.filter_min_size(s.view("parcels"), "area_ha", 0.05).select("field_id", "category")


@query("p12_drop_repeated", "SELECT o_custkey, o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1")
def _(s: Source):
    return masks.drop_repeated_ids(s.table("orders").select("o_custkey", "o_orderkey"), "o_custkey")


@query("p13_et_clamp", "SELECT pixel, d, round(CASE WHEN et <= 0 OR et > 12 THEN 0 ELSE et END, 6) AS et FROM et_daily", "et_daily")
def _(s: Source):
    return s.view("et_daily").select("pixel", "d", rounded(masks.clamp_et(F.col("et")), 6).alias("et"))


@query("p14_split_vegetation", "SELECT id, CAST(lai AS DOUBLE) AS lai, (h_c - 0.1) <= 0.01 OR lai <= 0 AS bare FROM station", "station")
def _(s: Source):
    df = s.view("station").withColumns({"f_c": F.col("h_c") - 0.1, "lai": F.col("lai").cast("double")})
    return masks.split_vegetation(df).select("id", "lai", "bare")


# --- temporal ----------------------------------------------------------------

@query(
    "t1_window_join",
    "WITH comp AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS comp_date FROM orders), daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT comp_date, day, n FROM comp JOIN daily ON day BETWEEN comp_date - (CASE WHEN extract(month FROM comp_date) = 4 AND extract(day FROM comp_date) = 6 THEN 5 ELSE 4 END) AND comp_date + 4 AND extract(year FROM day) = extract(year FROM comp_date)",
)
def _(s: Source):
    o = s.table("orders").withColumn("day", F.to_date("o_orderdate"))
    comp = o.select(F.col("day").alias("comp_date")).distinct()
    return temporal.window_join(comp, o.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "comp_date", "day")


@query("t2_interp_hourly", f"WITH {_T2} SELECT pixel, seq, round(t2m, 6) AS t2m FROM i", "lst_obs met_hourly")
def _(s: Source):
    return temporal.interp_hourly(s.view("lst_obs"), s.view("met_hourly"), "ts", "hour", ["t2m"]).select("pixel", "seq", R6("t2m"))


@query(
    "t3_interp_hourly_ceil",
    "WITH o AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN date_trunc('hour', ts) ELSE ts END AS t FROM events) SELECT o.event_id, round(a.t2m - (a.t2m - b.t2m) * (extract(minute FROM t) / 60.0), 6) AS t2m FROM o JOIN met_hourly a ON a.hour = date_trunc('hour', t) JOIN met_hourly b ON b.hour = CASE WHEN extract(minute FROM t) = 0 AND floor(extract(second FROM t)) = 0 THEN date_trunc('hour', t) ELSE date_trunc('hour', t) + INTERVAL 1 HOUR END",
    "met_hourly",
)
def _(s: Source):
    obs = s.table("events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz")).alias("t"))
    met = s.view("met_hourly").withColumn("hour", F.col("hour").cast("timestamp"))
    obs = obs.withColumn("t", F.col("t").cast("timestamp"))
    return temporal.interp_hourly(obs, met, "t", "hour", ["t2m"], mode="ceil").select("event_id", R6("t2m"))


@query("t4_per_day_counts", "SELECT pixel, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER w AS BIGINT) AS day_end, CAST(sum(count(*)) OVER w - count(*) AS BIGINT) AS day_start FROM lst_obs GROUP BY 1, 2 WINDOW w AS (PARTITION BY pixel ORDER BY CAST(ts AS DATE))", "lst_obs")
def _(s: Source):
    return temporal.per_day_counts(s.view("lst_obs"), "ts", ["pixel"])


@query("t5_acq_time", "SELECT seq, CAST(floor(epoch(ts)) AS BIGINT) AS unix_s, CAST(extract(hour FROM ts) * 100 + extract(minute FROM ts) AS INT) AS hhmm FROM lst_obs", "lst_obs")
def _(s: Source):
    return temporal.with_acq_time(s.view("lst_obs"), "ts").select("seq", "unix_s", "hhmm")


@query("t6_daily_radiation", "SELECT CAST(hour AS DATE) AS day, round(sum(ssrd / 3600) / 24, 4) AS mean_flux, round(sum(ssrd / 3600) * 3600, 2) AS energy FROM met_hourly GROUP BY 1", "met_hourly")
def _(s: Source):
    met = s.view("met_hourly").withColumn("flux", temporal.flux_from_accumulated(F.col("ssrd")))
    return temporal.daily_radiation(met, "hour", "flux").select("day", R6("mean_flux", 4), R6("energy", 2))


@query("t7_flux", "SELECT hour, round(nullif(ssrd, 0) / 3600, 6) AS flux FROM met_hourly", "met_hourly")
def _(s: Source):
    return s.view("met_hourly").select("hour", rounded(temporal.flux_from_accumulated(F.col("ssrd")), 6).alias("flux"))


@query("t8_calendar", "SELECT o_orderkey, CAST(extract(doy FROM o_orderdate) AS INT) AS doy, extract(day FROM last_day(make_date(extract(year FROM o_orderdate), 2, 1))) = 29 AS is_leap, monthname(o_orderdate) AS month_name, CAST(extract(day FROM last_day(o_orderdate)) AS INT) AS month_days, CAST(CASE WHEN extract(day FROM last_day(make_date(extract(year FROM o_orderdate), 2, 1))) = 29 THEN 366 ELSE 365 END AS INT) AS year_days FROM orders")
def _(s: Source):
    return temporal.with_calendar(s.table("orders"), "o_orderdate").select("o_orderkey", "doy", "is_leap", "month_name", "month_days", "year_days")


@query(
    "t9_fill_et",
    "WITH e AS (SELECT pixel, d, CASE WHEN et > 8 OR et < 0 THEN NULL ELSE et END AS et, 1 + extract(day FROM d) / 5.0 AS et_ref FROM et_daily), k AS (SELECT *, last_value(CASE WHEN et IS NOT NULL THEN et / et_ref END IGNORE NULLS) OVER (PARTITION BY pixel ORDER BY d ROWS UNBOUNDED PRECEDING) AS kc FROM e) SELECT pixel, d, round(kc, 6) AS kc, round(coalesce(et, kc * et_ref), 6) AS et_filled FROM k",
    "et_daily",
)
def _(s: Source):
    df = s.view("et_daily").withColumns({"et": F.when((F.col("et") <= 8) & (F.col("et") >= 0), F.col("et")), "et_ref": 1 + F.dayofmonth("d") / 5.0})
    return temporal.fill_et(df, "pixel", "d", "et", "et_ref").select("pixel", "d", R6("kc"), R6("et_filled"))


@query("t10_defaults", "SELECT id, 1013.25 AS p, CAST(u AS DOUBLE) AS u FROM station", "station")
def _(s: Source):
    df = s.view("station").withColumn("u", F.col("u").cast("double"))
    return temporal.with_defaults(df, {"p": F.lit(1013.25).cast("decimal(6,2)"), "u": F.lit(0.0)}).select("id", "p", "u")


# --- joins -------------------------------------------------------------------

@query("j1_stack_layers", "SELECT r, c, round(red, 6) AS red, round(extent, 6) AS extent FROM pixels WHERE red > 900 AND extent > 0.4", "pixels")
def _(s: Source):
    p = s.view("pixels")
    return grids.stack_layers(p.filter("red > 900").select("r", "c", R6("red")), p.filter("extent > 0.4").select("r", "c", R6("extent")))


@query("j2_mosaic", "SELECT r, c, round(CASE WHEN c >= 15 THEN bnr ELSE red END, 6) AS v FROM pixels WHERE c < 25 OR c >= 15", "pixels")
def _(s: Source):
    p = s.view("pixels")
    a, b = p.filter("c < 25").select("r", "c", rounded("red", 6).alias("v")), p.filter("c >= 15").select("r", "c", rounded("bnr", 6).alias("v"))
    return grids.mosaic([a, b], "v")


@query("j3_resample_nearest", "SELECT t.event_id, p.r, p.c, round(p.red, 6) AS red FROM (SELECT event_id, value / 12.5 AS x, (user_id % 160) / 4.0 AS y FROM events) t JOIN pixels p ON p.c = CAST(floor(x) AS BIGINT) AND p.r = CAST(floor(y) AS BIGINT)", "pixels")
def _(s: Source):
    t = s.table("events").select("event_id", (F.col("value") / 12.5).alias("x"), ((F.col("user_id") % 160) / 4.0).alias("y"))
    return grids.resample_nearest(s.view("pixels"), t, 0, 0, 1, 1, "red").select("event_id", "r", "c", R6("red"))


@query(
    "j4_resample_bilinear",
    "WITH t AS (SELECT event_id, value / 12.5 - 0.5 AS fx, (user_id % 160) / 4.0 - 0.5 AS fy FROM events), k AS (SELECT event_id, CAST(floor(fx) AS BIGINT) + j AS c, CAST(floor(fy) AS BIGINT) + i AS r, (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j)) SELECT event_id, round(sum(w * red) / sum(w), 5) AS red FROM k JOIN pixels p ON p.r = k.r AND p.c = k.c WHERE w > 0 GROUP BY event_id",
    "pixels",
)
def _(s: Source):
    t = s.table("events").select("event_id", (F.col("value") / 12.5).alias("x"), ((F.col("user_id") % 160) / 4.0).alias("y"))
    return grids.resample_bilinear(s.view("pixels"), t, 0, 0, 1, 1, "red", ["event_id"]).select("event_id", R6("red", 5))


@query("j5_clip", "SELECT r, c FROM pixels WHERE r BETWEEN 10 AND 20 AND c BETWEEN 5 AND 30", "pixels")
def _(s: Source):
    p = s.view("pixels").select("r", "c")
    return grids.clip_to(p, p.filter("r BETWEEN 10 AND 20 AND c BETWEEN 5 AND 30"))


@query("j7_attach", "SELECT l.r, l.c, l.ref, z.n AS ref_size FROM labels2 l LEFT JOIN (SELECT ref, count(*) AS n FROM labels2 WHERE ref <> 0 GROUP BY ref) z ON l.ref = z.ref", "labels2")
def _(s: Source):
    lab = s.view("labels2")
    return lab.join(labels.zonal(lab, "ref").select("ref", F.col("n").alias("ref_size")), "ref", "left").select("r", "c", "ref", "ref_size")


@query("j8_remove_sampled", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(s: Source):
    return sets.subtract(s.table("orders").select("o_orderkey"), s.table("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("j9_keep_labels", "SELECT r, c, ref FROM labels2 WHERE ref IN (SELECT ref FROM labels2 WHERE ref <> 0 GROUP BY ref HAVING count(*) >= 20)", "labels2")
def _(s: Source):
    lab = s.view("labels2").select("r", "c", "ref")
    return labels.keep_labels(lab, "ref", labels.zonal(lab, "ref").filter("n >= 20").select("ref"))


@query("j10_drop_border_labels", "SELECT r, c, ref FROM labels2 WHERE ref <> 0 AND ref NOT IN (SELECT ref FROM labels2 WHERE ref <> 0 AND (r % 20 < 2 OR r % 20 >= 18 OR c % 20 < 2 OR c % 20 >= 18))", "labels2")
def _(s: Source):
    return labels.drop_border_labels(s.view("labels2").select("r", "c", "ref"), "ref", 20, 2)


@query("j11_cross_grid", "SELECT ref, t_pred, t_ref FROM (SELECT DISTINCT ref FROM labels2), (SELECT a.i / 10.0 AS t_pred, b.i / 10.0 AS t_ref FROM range(6) a(i), range(6) b(i))", "labels2")
def _(s: Source):
    return scoring.cross_grid(s.view("labels2").select("ref").distinct(), scoring.threshold_grid(s.spark))


@query("j12_edge_pairs", "SELECT DISTINCT a.ref AS a, b.ref AS b FROM labels2 a JOIN labels2 b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.ref <> 0 AND b.ref <> 0 AND a.ref < b.ref AND (floor(a.r / 10) <> floor(b.r / 10) OR floor(a.c / 10) <> floor(b.c / 10))", "labels2")
def _(s: Source):
    return labels.edge_pairs(s.view("labels2"), "ref", 10)


# --- aggregations ------------------------------------------------------------

_BEST = "SELECT pixel, CAST(ts AS DATE) AS day, lst, vza, vaa, ts FROM (SELECT *, row_number() OVER (PARTITION BY pixel, CAST(ts AS DATE) ORDER BY {order}, seq) AS k FROM lst_obs WHERE vza < 45) WHERE k = 1"


@query("a1_best_pixel", "WITH b AS (" + _BEST.format(order="lst DESC") + ") SELECT g.pixel, g.day, round(b.lst, 6) AS lst, b.vza, b.vaa FROM (SELECT DISTINCT pixel, CAST(ts AS DATE) AS day FROM lst_obs) g LEFT JOIN b USING (pixel, day)", "lst_obs")
def _(s: Source):
    return composite.best_pixel(s.view("lst_obs")).select("pixel", "day", R6("lst"), "vza", "vaa")


@query("a2_min_vza", "WITH b AS (" + _BEST.format(order="vza") + ") SELECT g.pixel, g.day, round(b.lst, 6) AS lst, b.vza, b.vaa FROM (SELECT DISTINCT pixel, CAST(ts AS DATE) AS day FROM lst_obs) g LEFT JOIN b USING (pixel, day)", "lst_obs")
def _(s: Source):
    return composite.best_pixel(s.view("lst_obs"), by="vza", how="min").select("pixel", "day", R6("lst"), "vza", "vaa")


@query("a3_et_median", "SELECT pixel, round(median(CASE WHEN et <= 0 OR et > 12 THEN 0 ELSE et END), 6) AS et_median, count(*) AS n_days FROM et_daily WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY pixel", "et_daily")
def _(s: Source):
    return composite.et_median(s.view("et_daily"), "2024-01-05", "2024-01-25").select("pixel", R6("et_median"), "n_days")


@query("a4_monthly_median", "SELECT l_suppkey AS pixel, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_linenumber AS band, round(median(l_quantity), 6) AS value, count(*) AS n FROM lineitem WHERE (l_partkey & 6) = 0 GROUP BY 1, 2, 3")
def _(s: Source):
    return composite.monthly_median(s.table("lineitem").select(F.col("l_suppkey").alias("pixel"), "l_shipdate", F.col("l_linenumber").alias("band"), "l_quantity", "l_partkey"), 6, "pixel", "l_shipdate", "band", "l_quantity", "l_partkey").select("pixel", "month", "band", R6("value"), "n")


_AGG = "SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, avg(red) AS mean_red, stddev_pop(red) AS std_red, avg(bnr) AS mean_bnr, stddev_pop(bnr) AS std_bnr, count(*) AS n FROM pixels GROUP BY 1, 2"


@query("a5_aggregate_grid", f"SELECT r, c, round(mean_red, 5) AS mean_red, round(std_red, 5) AS std_red, round(mean_bnr, 5) AS mean_bnr, round(std_bnr, 5) AS std_bnr, n FROM ({_AGG})", "pixels")
def _(s: Source):
    return grids.aggregate_to_grid(s.view("pixels"), 4, ["red", "bnr"]).select("r", "c", *(R6(f"{k}_{b}", 5) for b in ("red", "bnr") for k in ("mean", "std")), "n")


@query("a6_cv", f"SELECT r, c, round((coalesce(std_red / CASE WHEN mean_red = 0 THEN 1e-6 ELSE mean_red END, 1000) + coalesce(std_bnr / CASE WHEN mean_bnr = 0 THEN 1e-6 ELSE mean_bnr END, 1000)) / 2, 6) AS cv FROM ({_AGG})", "pixels")
def _(s: Source):
    return grids.with_cv(grids.aggregate_to_grid(s.view("pixels"), 4, ["red", "bnr"]), ["red", "bnr"]).select("r", "c", R6("cv"))


_PAIRS = "SELECT ref, pred, count(*) AS n FROM labels2 GROUP BY 1, 2"


@query("a7_pair_counts", _PAIRS, "labels2")
def _(s: Source):
    return labels.pair_counts(s.view("labels2"), "ref", "pred")


_IOU = """p AS (SELECT ref, pred, count(*) AS n FROM labels2 GROUP BY 1, 2), a AS (SELECT ref, sum(n) AS size_a FROM p GROUP BY 1), b AS (SELECT pred, sum(n) AS size_b FROM p GROUP BY 1),
k AS (SELECT * FROM p {where} QUALIFY row_number() OVER (PARTITION BY ref ORDER BY n DESC, pred) = 1),
best AS (SELECT ref, pred, n, CAST(size_a AS BIGINT) AS size_a, CAST(size_b AS BIGINT) AS size_b, n / (size_a + size_b - n) AS iou, n / size_a AS overlap_a, n / size_b AS overlap_b FROM k JOIN a USING (ref) JOIN b USING (pred) WHERE ref <> 0 AND pred <> 0 AND size_a > 5 AND size_b > 5)"""
_IOU_OUT = "SELECT ref, pred, n, size_a, size_b, round(iou, 6) AS iou, round(overlap_a, 6) AS overlap_a, round(overlap_b, 6) AS overlap_b FROM best"


@query("a8_best_iou", f"WITH {_IOU.format(where='')} {_IOU_OUT}", "labels2")
def _(s: Source):
    return labels.best_iou(labels.pair_counts(s.view("labels2"), "ref", "pred")).select("ref", "pred", "n", "size_a", "size_b", R6("iou"), R6("overlap_a"), R6("overlap_b"))


@query("a8_best_iou_dedup", f"WITH {_IOU.format(where='WHERE ref <> 0 AND pred <> 0')} {_IOU_OUT}", "labels2")
def _(s: Source):
    return labels.best_iou(labels.pair_counts(s.view("labels2"), "ref", "pred"), mode="dedup").select("ref", "pred", "n", "size_a", "size_b", R6("iou"), R6("overlap_a"), R6("overlap_b"))


@query(
    "a9_iou_surface",
    f"WITH {_IOU.format(where='')}, g AS (SELECT a.i / 10.0 AS t_pred, b.i / 10.0 AS t_ref FROM range(6) a(i), range(6) b(i)) SELECT t_pred, t_ref, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, count(*) AS n FROM best, g WHERE overlap_b > t_pred AND overlap_a > t_ref GROUP BY 1, 2",
    "labels2",
)
def _(s: Source):
    best = labels.best_iou(labels.pair_counts(s.view("labels2"), "ref", "pred"))
    return scoring.iou_surface(best, scoring.threshold_grid(s.spark)).select("t_pred", "t_ref", R6("mean_iou"), R6("median_iou"), "n")


_FIELD = """p AS (SELECT ref, pred, count(*) AS n FROM labels2 GROUP BY 1, 2), a AS (SELECT ref, sum(n) AS sa FROM p GROUP BY 1), b AS (SELECT pred, sum(n) AS sb FROM p GROUP BY 1),
s AS (SELECT ref, pred, n, sb, n / (sa + sb - n) AS iou FROM p JOIN a USING (ref) JOIN b USING (pred) WHERE ref <> 0 AND pred <> 0),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ref ORDER BY iou DESC, pred) = 1),
z AS (SELECT ref, CAST(floor(avg(r)) AS BIGINT) AS centre_r, CAST(floor(avg(c)) AS BIGINT) AS centre_c FROM labels2 WHERE ref <> 0 GROUP BY ref),
f AS (SELECT a.ref, CAST(sa AS BIGINT) AS field_size, coalesce(best.iou, 0) AS max_iou, best.pred AS best_pred, coalesce(ci.iou, 0) AS centre_iou, centre_r, centre_c, best.n / best.sb AS ratio_pred, best.n / sa AS ratio_true
      FROM a LEFT JOIN best USING (ref) LEFT JOIN z USING (ref) LEFT JOIN labels2 l ON l.r = centre_r AND l.c = centre_c LEFT JOIN s ci ON ci.ref = a.ref AND ci.pred = l.pred WHERE a.ref <> 0)"""


@query("a10_field_iou", f"WITH {_FIELD} SELECT ref, field_size, round(max_iou, 6) AS max_iou, best_pred, round(centre_iou, 6) AS centre_iou, centre_r, centre_c, round(ratio_pred, 6) AS ratio_pred, round(ratio_true, 6) AS ratio_true FROM f", "labels2")
def _(s: Source):
    return labels.field_iou(s.view("labels2")).select("ref", "field_size", R6("max_iou"), "best_pred", R6("centre_iou"), "centre_r", "centre_c", R6("ratio_pred"), R6("ratio_true"))


@query(
    "a12_grid_summary",
    f"WITH {_FIELD}, e AS (SELECT least, ref % 3 AS t_ext, ref % 2 AS t_bound, max_iou, centre_iou FROM f, (VALUES (0.0), (0.25), (0.5), (0.75)) l(least) WHERE ratio_true >= least), m AS (SELECT least, t_ext, t_bound, avg(max_iou) AS mean_max, avg(centre_iou) AS mean_centre, count(*) AS n FROM e GROUP BY 1, 2, 3), u AS (SELECT least, t_ext, t_bound, n, 'mean_max' AS metric, round(mean_max, 9) AS score FROM m UNION ALL SELECT least, t_ext, t_bound, n, 'mean_centre', round(mean_centre, 9) FROM m) SELECT CAST(least AS DOUBLE) AS least, metric, t_ext, t_bound, n, round(score, 6) AS score FROM u QUALIFY rank() OVER (PARTITION BY least, metric ORDER BY u.score DESC) = 1",
    "labels2",
)
def _(s: Source):
    f = labels.field_iou(s.view("labels2")).withColumns({"t_ext": F.col("ref") % 3, "t_bound": F.col("ref") % 2})
    return scoring.grid_summary(f, ["t_ext", "t_bound"], overlap="ratio_true").select("least", "metric", "t_ext", "t_bound", "n", R6("score"))


_DECILES = "e AS (SELECT quantile_cont(n_x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM src)"


@query(
    "a13_sample_by_decile",
    f"WITH src AS (SELECT o_orderkey, o_totalprice AS n_x FROM orders), {_DECILES}, b AS (SELECT o_orderkey, i AS bin FROM src, e, range(10) r(i) WHERE n_x > q[i + 1] AND n_x <= q[i + 2]) SELECT o_orderkey, CAST(bin AS INT) AS bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY o_orderkey) <= 20",
)
def _(s: Source):
    return sampling.sample_by_decile(s.table("orders"), "o_orderkey", "o_totalprice", 200).select("o_orderkey", "bin")


@query(
    "a14_sample_per_decile",
    f"WITH src AS (SELECT o_orderkey, o_totalprice AS n_x FROM orders), {_DECILES}, b AS (SELECT o_orderkey, i AS bin FROM src, e, range(10) r(i) WHERE (n_x > q[i + 1] OR i = 0) AND n_x <= q[i + 2]) SELECT o_orderkey, CAST(bin AS INT) AS bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY o_orderkey) <= 15",
)
def _(s: Source):
    return sampling.sample_per_decile(s.table("orders"), "o_orderkey", "o_totalprice", 15).select("o_orderkey", "bin")


@query("a15_allocate", "SELECT state, n, CAST(ceil(n * 500.0 / sum(n) OVER ()) AS BIGINT) AS quota FROM (SELECT state, count(*) AS n FROM chips GROUP BY 1)", "chips")
def _(s: Source):
    return sampling.allocate(s.view("chips"), "state", 500)


@query(
    "a15_sample_chips",
    """WITH c AS (SELECT state, chip_r, chip_c, CAST(sum(pixel_count) AS BIGINT) AS a, CAST(count(*) FILTER (pixel_count > 1) AS BIGINT) AS b FROM chips GROUP BY 1, 2, 3),
q AS (SELECT state, ceil(count(*) * 200.0 / (SELECT count(*) FROM c)) AS quota FROM c GROUP BY state),
e1 AS (SELECT state, quantile_cont(a, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM c GROUP BY state),
s1 AS (SELECT c.*, i AS bin FROM c JOIN e1 USING (state) JOIN q USING (state), range(5) r(i) WHERE a >= e[i + 1] AND a < e[i + 2] QUALIFY row_number() OVER (PARTITION BY state, bin ORDER BY chip_r, chip_c) <= floor(any_value(quota) OVER (PARTITION BY state) / 5 / 2)),
c2 AS (SELECT * FROM c WHERE (state, chip_r, chip_c) NOT IN (SELECT state, chip_r, chip_c FROM s1)),
e2 AS (SELECT state, quantile_cont(b, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM c2 GROUP BY state),
s2 AS (SELECT c2.*, (SELECT min(i) FROM range(5) r(i) WHERE b >= e[i + 1] AND b < e[i + 2]) AS bin FROM c2 JOIN e2 USING (state) JOIN q USING (state) QUALIFY bin IS NOT NULL AND row_number() OVER (PARTITION BY state, bin ORDER BY chip_r, chip_c) <= floor(any_value(quota) OVER (PARTITION BY state) / 5 / 2))
SELECT state, chip_r, chip_c, CAST(bin AS INT) AS bin, 'a' AS drawn_for FROM s1 UNION ALL SELECT state, chip_r, chip_c, CAST(bin AS INT) AS bin, 'b' FROM s2""",
    "chips",
)
def _(s: Source):
    c = s.view("chips").groupBy("state", "chip_r", "chip_c").agg(F.sum("pixel_count").cast("long").alias("a"), F.count_if(F.col("pixel_count") > 1).alias("b"))
    return sampling.sample_chips(c, "state", ["chip_r", "chip_c"], ["a", "b"], 200).select("state", "chip_r", "chip_c", "bin", "drawn_for")


@query("a16_zonal", "SELECT ref, count(*) AS n, CAST(floor(avg(r)) AS BIGINT) AS centre_r, CAST(floor(avg(c)) AS BIGINT) AS centre_c FROM labels2 WHERE ref <> 0 GROUP BY ref", "labels2")
def _(s: Source):
    return labels.zonal(s.view("labels2"), "ref")


@query("a17_chip_stats", "SELECT CAST(floor(r / 8) AS BIGINT) AS chip_r, CAST(floor(c / 8) AS BIGINT) AS chip_c, CAST(count(*) FILTER (ref <> 0) AS BIGINT) AS n_ref, CAST(count(*) FILTER (pred <> 0) AS BIGINT) AS n_pred FROM (SELECT r, c, CASE WHEN r = 9 AND c = 9 THEN NULL ELSE ref END AS ref, pred FROM labels2) GROUP BY 1, 2 HAVING NOT bool_or(ref IS NULL OR ref < 0 OR pred < 0)", "labels2")
def _(s: Source):
    df = s.view("labels2").withColumn("ref", F.when(~((F.col("r") == 9) & (F.col("c") == 9)), F.col("ref")))
    return sampling.chip_stats(df, 8, ["ref", "pred"])


@query("a18_sample_empty", "WITH m AS (SELECT state, band, chip_r, chip_c, max(pixel_count) AS most FROM chips GROUP BY 1, 2, 3, 4) SELECT state, band, chip_r, chip_c FROM m WHERE most = 0 ORDER BY 1, 2, 3, 4 LIMIT (SELECT greatest(CAST(floor(count(*) / 80.0) AS BIGINT), 1) FROM m)", "chips")
def _(s: Source):
    return sampling.sample_empty(s.view("chips"), ["state", "band", "chip_r", "chip_c"], "pixel_count", 1 / 80)


@query("a19_split", "SELECT state, band, chip_r, chip_c, CASE WHEN row_number() OVER (PARTITION BY state ORDER BY band, chip_r, chip_c) <= floor(count(*) OVER (PARTITION BY state) * 0.85) THEN 'train' ELSE 'hold' END AS part FROM chips", "chips")
def _(s: Source):
    return sampling.split(s.view("chips"), 0.85, ["state"], [F.col("band"), F.col("chip_r"), F.col("chip_c")]).select("state", "band", "chip_r", "chip_c", "part")


@query(
    "a20_class_scores",
    """WITH m AS (SELECT CAST(count(*) FILTER (pred = 1 AND label = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (pred = 1 AND label = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (pred = 0 AND label = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (pred = 0 AND label = 0) AS DOUBLE) AS tn FROM class_pred),
k AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS ch FROM m)
SELECT tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc, round(((tp + tn) / n - ch) / nullif(1 - ch, 0), 6) AS kappa FROM k""",
    "class_pred",
)
def _(s: Source):
    return scoring.class_scores(s.view("class_pred")).select("tp", "fp", "fn", "tn", *(R6(k) for k in ("accuracy", "precision", "recall", "mcc", "kappa")))


@query("a22_coarse_residual", f"SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(max(t) - pow(avg(t * t * t * t), 0.25), 5) AS residual FROM (SELECT r, c, 270 + red / 40 AS t FROM pixels) GROUP BY 1, 2", "pixels")
def _(s: Source):
    high = s.view("pixels").select("r", "c", (270 + F.col("red") / 40).alias("t"))
    low = high.groupBy(*(F.floor(F.col(k) / 4).cast("long").alias(k) for k in ("r", "c"))).agg(F.max("t").alias("t_low"))
    return grids.coarse_residual(high, low, 4, "t", "t_low").select("r", "c", R6("residual", 5))


_FLAG = f"""WITH {_T2}, m AS (SELECT pixel, seq, ts, vza, vaa, CASE WHEN bayes <> 2 AND (confidence < 16384 OR confidence >= 32678) AND lst >= 273.15 AND lst - t2m >= -2 THEN lst END AS lst FROM i),
b AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY pixel, CAST(ts AS DATE) ORDER BY lst DESC, seq) AS k FROM m WHERE vza < 45 AND lst IS NOT NULL)
SELECT g.pixel, g.day, round(lst, 6) AS lst, vza, vaa FROM (SELECT DISTINCT pixel, CAST(ts AS DATE) AS day FROM m) g LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (pixel, day)"""


@query("flagship_thermal_composite", _FLAG, "lst_obs met_hourly")
def _(s: Source):
    """P1, T2, P2 and A1 in one plan: one broadcastable hourly join and one aggregation by pixel and day."""
    screened = masks.mask_lst_quality(s.view("lst_obs"))
    with_air = temporal.interp_hourly(screened, s.view("met_hourly"), "ts", "hour", ["t2m"])
    return composite.best_pixel(masks.mask_lst_air(with_air)).select("pixel", "day", R6("lst"), "vza", "vaa")


# --- ranking -----------------------------------------------------------------

@query("k1_order_by_suffix", "SELECT c_custkey, c_name FROM customer ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)")
def _(s: Source):
    return sampling.order_by_suffix(s.table("customer").select("c_custkey", "c_name"), "c_name")


@query("k2_top1", "SELECT state, band, chip_r, chip_c, CAST(pixel_count AS BIGINT) AS pixel_count FROM chips QUALIFY row_number() OVER (PARTITION BY state, band ORDER BY pixel_count DESC, chip_r, chip_c) = 1", "chips")
def _(s: Source):
    return sampling.top1(s.view("chips"), ["state", "band"], [F.col("pixel_count").desc(), F.col("chip_r"), F.col("chip_c")]).select("state", "band", "chip_r", "chip_c", F.col("pixel_count").cast("long"))


@query("k3_best_with_ties", "SELECT state, band, chip_r, chip_c, CAST(pixel_count AS BIGINT) AS pixel_count FROM chips QUALIFY rank() OVER (PARTITION BY state, band ORDER BY pixel_count DESC) = 1", "chips")
def _(s: Source):
    return sampling.best_with_ties(s.view("chips"), ["state", "band"], "pixel_count").select("state", "band", "chip_r", "chip_c", F.col("pixel_count").cast("long"))


@query("k4_drop_worst", "SELECT ref, pred, n FROM p WHERE (ref, pred) <> (SELECT (ref, pred) FROM p WHERE ref IN (SELECT ref FROM p GROUP BY ref HAVING count(*) > 1) ORDER BY n, ref, pred LIMIT 1)".join(["WITH p AS (SELECT ref, pred, count(*) AS n FROM labels2 GROUP BY 1, 2) ", ""]), "labels2")
def _(s: Source):
    return sampling.drop_worst_duplicate(labels.pair_counts(s.view("labels2"), "ref", "pred"), "ref", "n")


@query("k4_drop_worst_dedup", "WITH p AS (SELECT ref, pred, count(*) AS n FROM labels2 GROUP BY 1, 2) SELECT ref, pred, n FROM p QUALIFY row_number() OVER (PARTITION BY ref ORDER BY n DESC, pred) = 1", "labels2")
def _(s: Source):
    return sampling.drop_worst_duplicate(labels.pair_counts(s.view("labels2"), "ref", "pred"), "ref", "n", mode="dedup")


@query("k5_shuffle_pairs", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS place FROM part")
def _(s: Source):
    """The shuffled rows with their places, which the order of a result alone would not show."""
    shuffled = sampling.shuffle_pairs(s.table("part").select("p_partkey", "p_name"), "p_partkey", 42)
    return sampling.ranked(shuffled, [], sampling.shuffle_order("p_partkey", 42), "place")


# --- set operations ----------------------------------------------------------

@query("u1_union_with_source", "SELECT c_custkey AS k, c_acctbal AS bal, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier")
def _(s: Source):
    return sets.union_with_source({"customer": s.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "supplier": s.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))})


@query("u2_subtract", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def _(s: Source):
    return sets.subtract(s.table("customer").select("c_custkey"), s.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("u3_distinct", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(s: Source):
    return sets.distinct_rows(s.table("lineitem"), ["l_suppkey", "l_returnflag"])


@query("u4_to_long", "SELECT r, c, 'red' AS name, round(red, 6) AS value FROM pixels UNION ALL SELECT r, c, 'bnr', round(bnr, 6) FROM pixels", "pixels")
def _(s: Source):
    return sets.to_long(s.view("pixels").select("r", "c", R6("red"), R6("bnr")), ["r", "c"], ["red", "bnr"])


@query("u4_to_wide", "SELECT r_name AS state, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS A, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS N, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS R FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(s: Source):
    j = s.table("lineitem").join(s.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(s.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(s.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = j.groupBy(F.col("r_name").alias("state"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return sets.to_wide(counts, ["state"], "l_returnflag", "n", ["A", "N", "R"])


# --- catalogues --------------------------------------------------------------

@query("s1_catalog_query", "SELECT scene_id, datetime FROM scene_catalog WHERE datetime >= TIMESTAMP '1996-01-01 00:00:00' AND datetime <= TIMESTAMP '1996-06-30 23:59:59' AND x0 <= 9.5 AND x1 >= 8.0 AND y0 <= 51.0 AND y1 >= 49.0", "scene_catalog")
def _(s: Source):
    return catalog.catalog_query(s.view("scene_catalog"), "1996-01-01", "1996-06-30", (8.0, 49.0, 9.5, 51.0)).select("scene_id", "datetime")


def _assets(s: Source):
    o = s.table("orders")
    link = lambda b: F.struct(F.concat(F.lit(f"https://host/{b}/"), F.col("o_orderkey").cast("string")).alias("href"), F.lit("image/tiff").alias("type"))
    empty = F.lit(None).cast("struct<href:string,type:string>")
    return o.select("o_orderkey", F.create_map(F.lit("lst"), link("lst"), F.lit("qa"), F.when(F.col("o_orderkey") % 5 == 0, empty).otherwise(link("qa"))).alias("assets"))


@query("s2_sign_assets", "SELECT o_orderkey, 'https://host/lst/' || o_orderkey || '?tok=1' AS lst, CASE WHEN o_orderkey % 5 <> 0 THEN 'https://host/qa/' || o_orderkey || '?tok=1' END AS qa FROM orders")
def _(s: Source):
    return catalog.sign_assets(_assets(s), "tok=1").select("o_orderkey", F.col("assets")["lst"]["href"].alias("lst"), F.col("assets")["qa"]["href"].alias("qa"))


@query("s3_bad_assets", "SELECT o_orderkey, 'qa' AS bad FROM orders WHERE o_orderkey % 5 = 0")
def _(s: Source):
    return catalog.bad_assets(_assets(s)).select("o_orderkey", F.array_join("bad", ",").alias("bad"))


_NAMES = "SELECT o_orderkey, 'tiles/X' || lpad(CAST(o_custkey % 100 AS VARCHAR(9)), 4, '0') || '_Y' || lpad(CAST(o_orderkey % 80 AS VARCHAR(9)), 4, '0') || '/' || strftime(o_orderdate, '%Y%m%d') || '_LEVEL2_' || CASE o_orderkey % 3 WHEN 0 THEN 'BNR' WHEN 1 THEN 'RE1' ELSE 'SW2' END || '.tif' AS path FROM orders"


def _paths(s: Source):
    four = lambda k: F.lpad(k.cast("string"), 4, "0")
    band = F.get(F.array(*(F.lit(b) for b in ("BNR", "RE1", "SW2"))), (F.col("o_orderkey") % 3).cast("int"))
    return s.table("orders").select("o_orderkey", F.concat(F.lit("tiles/X"), four(F.col("o_custkey") % 100), F.lit("_Y"), four(F.col("o_orderkey") % 80), F.lit("/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_LEVEL2_"), band, F.lit(".tif")).alias("path"))


@query("s4_scene_names", f"WITH n AS ({_NAMES}) SELECT o_orderkey, regexp_extract(path, '(X[0-9]{{4}}_Y[0-9]{{4}})', 1) AS tile, CAST(strptime(regexp_extract(path, '/([0-9]{{8}})_', 1), '%Y%m%d') AS DATE) AS scene_date, monthname(strptime(regexp_extract(path, '/([0-9]{{8}})_', 1), '%Y%m%d')) AS month_name, regexp_extract(path, '_([A-Z]{{2}}[A-Z0-9])[.]tif', 1) AS band, CASE o_orderkey % 3 WHEN 0 THEN 'B08' WHEN 1 THEN 'B05' ELSE 'B12' END AS sensor_band FROM n")
def _(s: Source):
    return catalog.parse_scene_name(_paths(s), "path").drop("path")


@query("s5_list_scenes", "SELECT CAST(o_orderkey % 40 AS BIGINT) AS scene, CAST(1 AS BIGINT) AS n_files, TRUE AS filled FROM orders GROUP BY 1")
def _(s: Source):
    """One file a scene, listed among others of another suffix in the same folders."""
    path = fresh_path(s.spark, "scenes")
    rows = s.table("orders").select((F.col("o_orderkey") % 40).alias("scene"), F.col("o_orderkey").cast("string").alias("line")).repartition(8, "scene")
    rows.write.partitionBy("scene").text(path)
    rows.write.partitionBy("scene").mode("append").csv(path)
    files = catalog.list_scenes(s.spark, path, ".csv")
    return files.groupBy(F.regexp_extract("path", r"scene=(\d+)/", 1).cast("long").alias("scene")).agg(F.count(F.lit(1)).alias("n_files"), F.bool_and(F.col("length") > 0).alias("filled"))


@query("s6_scene_counts", "SELECT o_custkey % 50 AS tile, CAST(count(*) FILTER (extract(year FROM o_orderdate) = 1996) AS BIGINT) AS y1996, CAST(count(*) FILTER (extract(year FROM o_orderdate) = 1997) AS BIGINT) AS y1997 FROM orders GROUP BY 1")
def _(s: Source):
    return catalog.scene_counts(s.table("orders").withColumn("tile", F.col("o_custkey") % 50), "tile", "o_orderdate", [1996, 1997])


@query("s7_audit_complete", "SELECT CAST(k AS BIGINT) AS tile, coalesce(n, 0) AS n_found FROM range(0, 160) t(k) LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) USING (k) WHERE coalesce(n, 0) <> 66")
def _(s: Source):
    return catalog.audit_complete(s.table("events").select(F.col("user_id").alias("tile")), ["tile"], s.spark.range(160).toDF("tile"), 66)


@query("s8_check_dates", "WITH p AS (SELECT DISTINCT user_id % 3 AS tile, CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, count(*) AS n FROM p GROUP BY 1) SELECT day FROM n WHERE (SELECT min(n) FROM n) = (SELECT count(DISTINCT tile) FROM p)")
def _(s: Source):
    return catalog.check_dates(s.table("events").select((F.col("user_id") % 3).alias("tile"), F.to_date("ts").alias("day")), "tile", "day")


@query("s9_order_bands", "SELECT band, scene_date, tile, CASE band WHEN 'BLU' THEN 0 WHEN 'GRN' THEN 1 ELSE 2 END AS place FROM (SELECT DISTINCT CAST(ts AS DATE) AS scene_date FROM events), (VALUES ('BLU'), ('GRN'), ('RED')) b(band), (VALUES ('X1'), ('X2')) t(tile) ORDER BY 4, 2, 3")
def _(s: Source):
    days = s.table("events").select(F.to_date("ts").alias("scene_date")).distinct()
    rows = days.select("scene_date", F.explode(F.array(*(F.lit(b) for b in ("RED", "BLU", "GRN", "SW1")))).alias("band")).select("*", F.explode(F.array(F.lit("X2"), F.lit("X1"))).alias("tile"))
    return catalog.order_bands(rows, ["BLU", "GRN", "RED"], days.count(), 2).select("band", "scene_date", "tile", "place")


@query("s14_plan_backfill", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'flux' ELSE 'sharpen' END AS stage FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def _(s: Source):
    o = s.table("orders").select("o_orderkey")
    return catalog.plan_backfill(o, o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 5 = 0"), o.filter("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("s15_extent", "SELECT CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1, min(datetime) AS first, max(datetime) AS last, count(*) AS n FROM scene_catalog", "scene_catalog")
def _(s: Source):
    return catalog.collection_extent(s.view("scene_catalog")).withColumns({k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")})


PARCEL_CONTRACT = T.StructType([T.StructField("field_id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("area_ha", T.DoubleType()), T.StructField("geometry", T.BinaryType())])
