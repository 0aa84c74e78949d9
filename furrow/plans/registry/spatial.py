"""Neighbourhood, chip, label and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import focal, grids, labels, sampling, scoring, vectors
from furrow.plans import pipelines
from furrow.plans.registry.base import Source, query, rounded

R = lambda c, n=6: rounded(c, n).alias(c)

_HOLES = "px AS (SELECT r, c, CASE WHEN (r * 7 + c * 3) % 11 <> 0 THEN red END AS red, CASE WHEN extent >= 0.5 THEN 1 ELSE 0 END AS m FROM pixels)"


def _px(s: Source):
    p = s.view("pixels")
    return p.select("r", "c", F.when((F.col("r") * 7 + F.col("c") * 3) % 11 != 0, F.col("red")).alias("red"), F.when(F.col("extent") >= 0.5, 1).otherwise(0).alias("m"))


@query("w1_training_windows", "SELECT r, c, CAST(i AS INT) AS win_r, CAST(j AS INT) AS win_c FROM pixels, range(0, 8) a(i), range(0, 8) b(j) WHERE i BETWEEN greatest(floor((r - 2) / 8.0), 0) AND floor((r + 2) / 8.0) AND j BETWEEN greatest(floor((c - 2) / 8.0), 0) AND floor((c + 2) / 8.0)", "pixels")
def _(s: Source):
    return grids.assign_windows(s.view("pixels").select("r", "c"), 8)


def _smooth_sql(weight: str, k: int) -> str:
    return f"WITH {_HOLES} SELECT a.r, a.c, CASE WHEN a.red IS NOT NULL THEN round(sum(({weight}) * b.red) / sum({weight}), 5) END AS smooth FROM px a LEFT JOIN px b ON b.r BETWEEN a.r - {k} AND a.r + {k} AND b.c BETWEEN a.c - {k} AND a.c + {k} AND b.red IS NOT NULL GROUP BY a.r, a.c, a.red"


@query("w2_smooth_binomial", _smooth_sql("(2 - abs(a.r - b.r)) * (2 - abs(a.c - b.c))", 1), "pixels")
def _(s: Source):
    return focal.smooth_binomial(_px(s), "red").select("r", "c", R("smooth", 5))


@query("w3_smooth_mean", _smooth_sql("CASE WHEN b.r IS NOT NULL THEN 1.0 END", 2), "pixels")
def _(s: Source):
    return focal.smooth_mean(_px(s), "red", 5).select("r", "c", R("smooth", 5))


@query("w3_smooth_gauss", _smooth_sql("exp(-((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) / 2.0)", 4), "pixels")
def _(s: Source):
    return focal.smooth_gauss(_px(s), "red", 4).select("r", "c", R("smooth", 5))


@query("w4_fill_edges", f"WITH {_HOLES} SELECT a.r, a.c, round(coalesce(a.red, avg(b.red)), 5) AS filled FROM px a LEFT JOIN px b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY a.r, a.c, a.red", "pixels")
def _(s: Source):
    return focal.fill_edges(_px(s), "red").select("r", "c", R("filled", 5))


@query("w5_dilate", f"WITH {_HOLES} SELECT a.r, a.c, CAST(coalesce(max(b.m), 0) AS INT) AS m FROM px a LEFT JOIN px b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c", "pixels")
def _(s: Source):
    return focal.dilate(_px(s), "m")


@query("w5_erode", f"WITH {_HOLES} SELECT a.r, a.c, CAST(CASE WHEN sum(b.m) = 5 THEN 1 ELSE 0 END AS INT) AS m FROM px a LEFT JOIN px b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c", "pixels")
def _(s: Source):
    return focal.erode(_px(s), "m")


@query("w5_open", f"WITH {_HOLES}, e AS (SELECT a.r, a.c, CASE WHEN sum(b.m) = 5 THEN 1 ELSE 0 END AS m FROM px a LEFT JOIN px b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c) SELECT a.r, a.c, CAST(max(b.m) AS INT) AS m FROM e a JOIN e b ON abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.r, a.c", "pixels")
def _(s: Source):
    return focal.opened(_px(s), "m")


@query(
    "w6_slope_aspect",
    """WITH n AS (SELECT a.r, a.c, count(*) AS n, sum((b.c - a.c) * (2 - abs(b.r - a.r)) * b.red) / 8 / 30 AS gx, sum((b.r - a.r) * (2 - abs(b.c - a.c)) * b.red) / 8 / 30 AS gy
FROM pixels a JOIN pixels b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY 1, 2)
SELECT r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END, 5) AS aspect FROM n WHERE n = 8""",
    "pixels",
)
def _(s: Source):
    return focal.slope_aspect(s.view("pixels").select("r", "c", "red"), "red", 30.0).select("r", "c", R("slope", 5), R("aspect", 5))


_FILL = "v AS (SELECT r, c, red FROM px WHERE red > 0), best AS (SELECT a.r, a.c, arg_min(v.red, (a.r - v.r) * (a.r - v.r) + (a.c - v.c) * (a.c - v.c) + (v.r * 1000 + v.c) / 1e9) AS red FROM px a, v WHERE a.red IS NULL GROUP BY 1, 2)"


@query("w20_fill_nearest", f"WITH {_HOLES}, {_FILL} SELECT px.r, px.c, round(coalesce(px.red, best.red), 6) AS filled FROM px LEFT JOIN best USING (r, c)", "pixels")
def _(s: Source):
    return focal.fill_nearest(_px(s), "red").select("r", "c", R("filled"))


_CC = "WITH RECURSIVE n AS (SELECT r, c, r * 4294967296 + c AS k, {v} AS v FROM {t} WHERE {v} <> 0), e AS (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON {near} AND a.v = b.v), w(k, m) AS (SELECT k, k FROM n UNION SELECT e.b, w.m FROM w JOIN e ON w.k = e.a WHERE w.m < e.b), f AS (SELECT k, min(m) AS component FROM w GROUP BY k)"
_NEAR4 = "abs(a.r - b.r) + abs(a.c - b.c) = 1"
_NEAR8 = "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.k <> b.k"


@query("w7_components_4", _CC.format(v="ref", t="labels2", near=_NEAR4) + " SELECT n.r, n.c, n.v AS ref, component FROM n JOIN f USING (k)", "labels2")
def _(s: Source):
    return labels.label_components(s.view("labels2"), "ref", 4, block=7)


@query("w7_components_8", _CC.format(v="ref", t="labels2", near=_NEAR8) + " SELECT n.r, n.c, n.v AS ref, component FROM n JOIN f USING (k)", "labels2")
def _(s: Source):
    return labels.label_components(s.view("labels2"), "ref", 8, block=9)


_SEG = _CC.format(v="v", t="(SELECT r, c, CASE WHEN extent >= 0.45 AND boundary < 0.42 THEN 1 ELSE 0 END AS v FROM pixels)", near=_NEAR4)


@query("w8_segment_fields", _SEG + " SELECT p.r, p.c, coalesce(component, -1) AS field FROM pixels p LEFT JOIN f ON f.k = p.r * 4294967296 + p.c", "pixels")
def _(s: Source):
    return labels.segment_fields(s.view("pixels"), 0.45, 0.42)


@query(
    "w9_merge_tiles",
    "WITH RECURSIVE e AS (SELECT DISTINCT a.ref AS a, b.ref AS b FROM labels2 a JOIN labels2 b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.ref <> 0 AND b.ref <> 0 AND a.ref <> b.ref AND (floor(a.r / 20) <> floor(b.r / 20) OR floor(a.c / 20) <> floor(b.c / 20))), w(l, m) AS (SELECT DISTINCT ref, ref FROM labels2 UNION SELECT e.b, w.m FROM w JOIN e ON w.l = e.a), f AS (SELECT l, min(m) AS merged FROM w GROUP BY l) SELECT r, c, ref, merged FROM labels2 JOIN f ON ref = l",
    "labels2",
)
def _(s: Source):
    return labels.merge_tiles(s.view("labels2").select("r", "c", "ref"), "ref", 20)


T_EXT, T_BOUND = [0.3 + 0.05 * i for i in range(9)], [0.25 + 0.05 * i for i in range(9)]
_POINTS = ", ".join(f"({x!r}e0, {y!r}e0)" for x in T_EXT for y in T_BOUND)


@query(
    "a11_grid_search",
    f"""WITH RECURSIVE g AS (SELECT * FROM (VALUES {_POINTS}) g(t_ext, t_bound)), z AS (SELECT r, c, CAST(floor(r / 20) AS BIGINT) AS tr, CAST(floor(c / 20) AS BIGINT) AS tc, ref, extent, boundary FROM labels2 JOIN pixels USING (r, c)),
n AS (SELECT t_ext, t_bound, tr, tc, r, c, r * 4294967296 + c + 1 AS k FROM z, g WHERE extent >= t_ext AND boundary < t_bound),
e AS (SELECT t_ext, t_bound, a.k AS a, b.k AS b FROM n a JOIN n b USING (t_ext, t_bound, tr, tc) WHERE abs(a.r - b.r) + abs(a.c - b.c) = 1),
w(t_ext, t_bound, k, m) AS (SELECT t_ext, t_bound, k, k FROM n UNION SELECT e.t_ext, e.t_bound, e.b, w.m FROM w JOIN e ON w.t_ext = e.t_ext AND w.t_bound = e.t_bound AND w.k = e.a WHERE w.m < e.b),
f AS (SELECT t_ext, t_bound, k, min(m) AS pred FROM w GROUP BY ALL), l AS (SELECT g.t_ext, g.t_bound, z.*, coalesce(pred, 0) AS pred FROM z CROSS JOIN g LEFT JOIN f ON f.t_ext = g.t_ext AND f.t_bound = g.t_bound AND f.k = r * 4294967296 + c + 1),
p AS (SELECT t_ext, t_bound, tr, tc, ref, pred, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT t_ext, t_bound, tr, tc, ref, CAST(sum(n) AS BIGINT) AS sa FROM p GROUP BY ALL), b AS (SELECT t_ext, t_bound, tr, tc, pred, CAST(sum(n) AS BIGINT) AS sb FROM p GROUP BY ALL),
s AS (SELECT p.*, sa, sb, n / (sa + sb - n) AS iou FROM p JOIN a USING (t_ext, t_bound, tr, tc, ref) JOIN b USING (t_ext, t_bound, tr, tc, pred) WHERE ref <> 0 AND pred <> 0),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY t_ext, t_bound, tr, tc, ref ORDER BY iou DESC, pred) = 1),
m AS (SELECT tr, tc, ref, CAST(floor(avg(r)) AS BIGINT) AS r, CAST(floor(avg(c)) AS BIGINT) AS c FROM z WHERE ref <> 0 GROUP BY ALL)
SELECT (a.tr * 20) || '_' || (a.tc * 20) AS row_col_start, a.t_ext, a.t_bound, CAST(a.ref AS BIGINT) AS ref, a.sa AS field_size, round(coalesce(best.iou, 0), 6) AS max_iou, best.pred AS best_pred, round(coalesce(s.iou, 0), 6) AS centre_iou, m.r AS centre_r, m.c AS centre_c, l.pred AS centre_pred, round(best.n / best.sb, 6) AS ratio_pred, round(best.n / a.sa, 6) AS ratio_true
FROM a JOIN m ON m.tr = a.tr AND m.tc = a.tc AND m.ref = a.ref LEFT JOIN best ON best.t_ext = a.t_ext AND best.t_bound = a.t_bound AND best.tr = a.tr AND best.tc = a.tc AND best.ref = a.ref
LEFT JOIN l ON l.t_ext = a.t_ext AND l.t_bound = a.t_bound AND l.r = m.r AND l.c = m.c LEFT JOIN s ON s.t_ext = a.t_ext AND s.t_bound = a.t_bound AND s.tr = a.tr AND s.tc = a.tc AND s.ref = a.ref AND s.pred = l.pred""",
    "labels2 pixels",
)
def _(s: Source):
    """Nine by nine thresholds in tiles of 20 cells, each of four blocks."""
    cells = s.view("labels2").select("r", "c", "ref").join(s.view("pixels"), ["r", "c"])
    found = labels.grid_search_iou(cells, T_EXT, T_BOUND, 20, block=10)
    return found.withColumns({c: rounded(c, 6) for c in ("max_iou", "centre_iou", "ratio_pred", "ratio_true")})


@query(
    "w10_border_distance",
    """WITH d AS (SELECT a.r, a.c, a.ref, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM labels2 a, (SELECT g.r, g.c, coalesce(l.ref, -1) AS ref FROM (SELECT x.i AS r, y.i AS c FROM range(-1, 41) x(i), range(-1, 41) y(i)) g LEFT JOIN labels2 l ON l.r = g.r AND l.c = g.c) b WHERE a.ref <> 0 AND b.ref <> a.ref GROUP BY 1, 2, 3)
SELECT r, c, ref, round(sqrt(d2) / max(sqrt(d2)) OVER (PARTITION BY ref), 6) AS dist FROM d""",
    "labels2",
)
def _(s: Source):
    return labels.border_distance(s.view("labels2"), "ref").select("r", "c", "ref", R("dist"))


@query("w11_proximity", f"WITH {_HOLES}, o AS (SELECT r, c FROM px WHERE m = 1 AND (r + c) % 5 = 0) SELECT a.r, a.c, round(20 * (SELECT CASE WHEN min((a.r - o.r) * (a.r - o.r) + (a.c - o.c) * (a.c - o.c)) <= 36 THEN sqrt(min((a.r - o.r) * (a.r - o.r) + (a.c - o.c) * (a.c - o.c))) END FROM o), 6) AS dist FROM px a", "pixels")
def _(s: Source):
    df = _px(s).withColumn("m", F.when((F.col("r") + F.col("c")) % 5 == 0, F.col("m")).otherwise(0))
    return labels.proximity(df, "m", 20.0, 6).select("r", "c", R("dist"))


def _parcels(s: Source):
    p = s.view("parcels").withColumns({k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")})
    return p.select("field_id", "category", "area_ha", vectors.box_ring("x0", "y0", "x1", "y1").alias("ring"))


@query("w12_polygon_edges", "SELECT field_id, CAST(seg AS INT) AS seg, CAST(CASE seg WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS DOUBLE) AS x0, CAST(CASE seg WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS DOUBLE) AS y0, CAST(CASE seg WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS DOUBLE) AS x1, CAST(CASE seg WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END AS DOUBLE) AS y1 FROM parcels, range(4) t(seg)", "parcels")
def _(s: Source):
    return vectors.polygon_edges(_parcels(s), "field_id")


def _outline_sql(cell: int) -> str:
    """Cells that the four sides of each parcel's box cross."""
    across, down = (f"unnest(range(CAST(floor({k}0 / {cell}.0) AS BIGINT), CAST(ceil({k}1 / {cell}.0) AS BIGINT)))" for k in "xy")
    sides = [f"SELECT field_id, CAST(floor({y} / {cell}.0) AS BIGINT) AS r, {across} AS c FROM parcels" for y in ("y0", "y1")]
    sides += [f"SELECT field_id, {down} AS r, CAST(floor({x} / {cell}.0) AS BIGINT) AS c FROM parcels" for x in ("x0", "x1")]
    return " UNION ".join(sides)


@query("w13_rasterise_lines", _outline_sql(10), "parcels")
def _(s: Source):
    return vectors.rasterise_lines(vectors.polygon_edges(_parcels(s), "field_id"), "field_id", 10.0)


@query("w14_rasterise_polygons", "SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, max(field_id) AS field_id FROM (SELECT field_id, unnest(range(CAST(ceil(y0 / 5.0 - 0.5) AS BIGINT), CAST(ceil(y1 / 5.0 - 0.5) AS BIGINT))) AS r, x0, x1 FROM parcels) t, unnest(range(CAST(ceil(x0 / 5.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 5.0 - 0.5) AS BIGINT))) u(c) GROUP BY 1, 2", "parcels")
def _(s: Source):
    return vectors.rasterise_polygons(_parcels(s), "field_id", 5.0)


@query("w15_subtract_lines", "SELECT r, c FROM labels2 WHERE ref <> 0 AND NOT (r % 6 = 0 OR c % 6 = 0)", "labels2")
def _(s: Source):
    lab = s.view("labels2")
    return vectors.subtract_lines(lab.filter("ref <> 0").select("r", "c"), lab.filter("r % 6 = 0 OR c % 6 = 0"))


@query("w16_label_boundary", "SELECT a.r, a.c, a.ref FROM labels2 a LEFT JOIN labels2 b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.ref = b.ref WHERE a.ref <> 0 GROUP BY 1, 2, 3 HAVING count(b.r) < 4", "labels2")
def _(s: Source):
    return focal.label_boundary(s.view("labels2"), "ref")


_AREA = "SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, max(field_id) AS field_id FROM (SELECT field_id, unnest(range(CAST(ceil(y0 / 5.0 - 0.5) AS BIGINT), CAST(ceil(y1 / 5.0 - 0.5) AS BIGINT))) AS r, x0, x1 FROM parcels) t, unnest(range(CAST(ceil(x0 / 5.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 5.0 - 0.5) AS BIGINT))) u(c) GROUP BY 1, 2"


@query(
    "w17_label_stack",
    # a parcel is seven cells wide at most, so its nearest foreign cell is within eight
    f"""WITH a AS ({_AREA}), o AS (SELECT DISTINCT r, c FROM ({_outline_sql(5)})), g AS (SELECT r, c FROM a UNION SELECT r, c FROM o),
e AS (SELECT g.r, g.c, CAST(count(o.r) > 0 AS INT) AS edge FROM g LEFT JOIN o ON o.r BETWEEN g.r - 1 AND g.r AND o.c BETWEEN g.c - 1 AND g.c GROUP BY 1, 2),
i AS (SELECT a.* FROM a JOIN e USING (r, c) WHERE edge = 0), k AS (SELECT x.i AS dr, y.i AS dc FROM range(-8, 9) x(i), range(-8, 9) y(i)),
d AS (SELECT i.r, i.c, i.field_id, min(dr * dr + dc * dc) AS d2 FROM i CROSS JOIN k LEFT JOIN i b ON b.r = i.r + dr AND b.c = i.c + dc AND b.field_id = i.field_id WHERE b.r IS NULL GROUP BY 1, 2, 3),
n AS (SELECT r, c, sqrt(d2) / max(sqrt(d2)) OVER (PARTITION BY field_id) AS dist FROM d)
SELECT e.r, e.c, CAST(i.r IS NOT NULL AS INT) AS extent, edge, round(coalesce(dist, 0), 6) AS dist FROM e LEFT JOIN i USING (r, c) LEFT JOIN n USING (r, c)""",
    "parcels",
)
def _(s: Source):
    return vectors.label_stack(_parcels(s), "field_id", 5.0).select("r", "c", "extent", "edge", R("dist"))


_FACES = "SELECT ref, count(*) AS faces FROM (SELECT ref, fr, fc FROM (SELECT ref, 2 * r - 1 AS fr, 2 * c AS fc FROM labels2 UNION ALL SELECT ref, 2 * r + 1, 2 * c FROM labels2 UNION ALL SELECT ref, 2 * r, 2 * c - 1 FROM labels2 UNION ALL SELECT ref, 2 * r, 2 * c + 1 FROM labels2) GROUP BY 1, 2, 3 HAVING count(*) = 1) GROUP BY ref"


@query("w18_polygonise", f"SELECT ref, count(*) AS n_cells, round(CAST(count(*) AS DOUBLE) * CAST(0.01 AS DOUBLE), 6) AS area_ha, CAST(min(c) * 10.0 AS DOUBLE) AS x0, CAST(min(r) * 10.0 AS DOUBLE) AS y0, CAST((max(c) + 1) * 10.0 AS DOUBLE) AS x1, CAST((max(r) + 1) * 10.0 AS DOUBLE) AS y1, CAST(any_value(faces) * 10.0 AS DOUBLE) AS perimeter, any_value(faces) AS n_faces FROM labels2 JOIN ({_FACES}) f USING (ref) WHERE ref <> 0 GROUP BY ref", "labels2")
def _(s: Source):
    return vectors.polygonise(s.view("labels2"), "ref", 10.0).withColumn("area_ha", rounded("area_ha", 6))


@query("w18_label_rings", f"SELECT ref, CAST(count(*) * 100.0 AS DOUBLE) AS area, CAST(any_value(faces) * 10.0 AS DOUBLE) AS outline, TRUE AS closed FROM labels2 JOIN ({_FACES}) f USING (ref) WHERE ref <> 0 GROUP BY ref", "labels2")
def _(s: Source):
    """What the rings enclose and how long they are: holes run the other way round, so their area counts against it."""
    rings = vectors.label_rings(s.view("labels2"), "ref", 10.0)
    sides = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda a, i: F.struct(a.alias("a"), F.get("ring", i + 1).alias("b")))
    total = lambda f: F.aggregate(sides, F.lit(0.0), lambda acc, e: acc + f(e["a"], e["b"]))
    area = total(lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)
    length = total(lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))
    return rings.groupBy("ref").agg(F.abs(F.sum(area)).alias("area"), F.sum(length).alias("outline"), F.bool_and(F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"))


@query(
    "w19_outer_chips",
    """WITH k AS (SELECT chip_r, chip_c, sum(pixel_count) % 7 = 0 AS b FROM chips GROUP BY 1, 2),
f AS (SELECT *, coalesce(max(CAST(b AS INT)) OVER (PARTITION BY chip_r ORDER BY chip_c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS f0, coalesce(max(CAST(b AS INT)) OVER (PARTITION BY chip_r ORDER BY chip_c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS f1,
coalesce(max(CAST(b AS INT)) OVER (PARTITION BY chip_c ORDER BY chip_r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS f2, coalesce(max(CAST(b AS INT)) OVER (PARTITION BY chip_c ORDER BY chip_r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS f3 FROM k)
SELECT chip_r, chip_c, b FROM f WHERE NOT (f0 OR f1 OR f2 OR f3)""",
    "chips",
)
def _(s: Source):
    k = s.view("chips").groupBy("chip_r", "chip_c").agg((F.sum("pixel_count") % 7 == 0).alias("b"))
    return sampling.drop_outer_chips(k, "b")


@query("w21_chip_cells", "SELECT r, c, CAST(i * 10 AS BIGINT) AS row_start, CAST(j * 10 AS BIGINT) AS col_start, r - i * 10 AS in_r, c - j * 10 AS in_c FROM pixels, range(0, 4) a(i), range(0, 4) b(j) WHERE r >= i * 10 AND r < i * 10 + 14 AND c >= j * 10 AND c < j * 10 + 14", "pixels")
def _(s: Source):
    return grids.explode_to_chips(s.view("pixels").select("r", "c"), 40, 40, 14, 4)


def _extent(s: Source) -> tuple[int, int]:
    e = s.table("lineitem").agg(F.max("l_orderkey"), F.max("l_partkey")).first()
    return e[0] + 1, e[1] + 1


_SIZE = "e AS (SELECT max(l_orderkey) + 1 AS h, max(l_partkey) + 1 AS w FROM lineitem)"


@query("w21_chip_grid", f"WITH {_SIZE} SELECT r.i * 236 AS row_start, c.i * 236 AS col_start, r.i * 236 + 256 AS row_end, c.i * 236 + 256 AS col_end FROM e, range(0, 100000) r(i), range(0, 10000) c(i) WHERE r.i * 236 + 256 < h AND c.i * 236 + 256 < w")
def _(s: Source):
    return grids.chip_grid(s.spark, *_extent(s), 256, 20)


@query("w21_slice_grid", f"WITH {_SIZE} SELECT i, j, i * (h // 10) AS row_start, (i + 1) * (h // 10) AS row_end, j * (w // 10) AS col_start, (j + 1) * (w // 10) AS col_end FROM e, range(0, 10) a(i), range(0, 10) b(j)")
def _(s: Source):
    return grids.slice_grid(s.spark, *_extent(s), 10)


@query(
    "w22_stitch_chips",
    """WITH k AS (SELECT i * 10 AS row_start, j * 10 AS col_start, r, c, CASE WHEN ref = 0 THEN 0 ELSE extent END AS v FROM pixels JOIN labels2 USING (r, c), range(0, 4) a(i), range(0, 4) b(j) WHERE r >= i * 10 + 2 AND r < i * 10 + 12 AND c >= j * 10 + 2 AND c < j * 10 + 12)
SELECT r, c, round(max(v), 6) AS v FROM k WHERE (row_start, col_start) IN (SELECT (row_start, col_start) FROM k GROUP BY row_start, col_start HAVING sum(v) > 0) GROUP BY 1, 2""",
    "pixels labels2",
)
def _(s: Source):
    chips = grids.explode_to_chips(s.view("pixels").select("r", "c", F.col("extent").alias("v")), 40, 40, 14, 4)
    mask = s.view("labels2").select("r", "c", F.when(F.col("ref") == 0, 0).otherwise(1).alias("mask"))
    return grids.stitch_chips(chips, 14, 4, "v", mask).select("r", "c", R("v"))


@query("w23_with_xy", "SELECT r, c, CAST(1000 + (c + 0.5) * 30 AS DOUBLE) AS x, CAST(5000 - (r + 0.5) * 30 AS DOUBLE) AS y FROM pixels", "pixels")
def _(s: Source):
    return grids.with_xy(s.view("pixels").select("r", "c"), 1000.0, 5000.0, 30.0, -30.0).select("r", "c", F.col("x").cast("double"), F.col("y").cast("double"))


@query("w24_tile_boxes", "SELECT tile, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, count(*) AS n FROM pixels GROUP BY tile", "pixels")
def _(s: Source):
    return grids.tile_boxes(s.view("pixels"))


_CELLS_OF = "SELECT field_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM (SELECT field_id, unnest(range(CAST(ceil((y0 + {d}) / 4.0 - 0.5) AS BIGINT), CAST(ceil((y1 + {d}) / 4.0 - 0.5) AS BIGINT))) AS r, x0 + {d} AS x0, x1 + {d} AS x1 FROM parcels) t, unnest(range(CAST(ceil(x0 / 4.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 4.0 - 0.5) AS BIGINT))) u(c)"


def _overlay_sql(out: str) -> str:
    return f"""WITH ca AS ({_CELLS_OF.format(d=0)}), cb AS ({_CELLS_OF.format(d=8)}), na AS (SELECT field_id, count(*) AS n FROM ca GROUP BY 1), nb AS (SELECT field_id, count(*) AS n FROM cb GROUP BY 1),
o AS (SELECT ca.field_id AS a, cb.field_id AS b, count(*) AS n FROM ca JOIN cb USING (r, c) GROUP BY 1, 2), p AS (SELECT a, b, o.n * 16.0 AS area, least(o.n / na.n, 1) AS overlap_a, least(o.n / nb.n, 1) AS overlap_b, o.n / (na.n + nb.n - o.n) AS iou FROM o JOIN na ON na.field_id = a JOIN nb ON nb.field_id = b) {out}"""


def _overlay(s: Source):
    p = s.view("parcels").withColumns({k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")})
    a = p.select(F.col("field_id").alias("a"), vectors.box_ring("x0", "y0", "x1", "y1").alias("ring"))
    q = p.withColumns({k: F.col(k) + 8 for k in ("x0", "y0", "x1", "y1")})
    b = q.select(F.col("field_id").alias("b"), vectors.box_ring("x0", "y0", "x1", "y1").alias("ring"))
    return vectors.overlay_pairs(a, b, "a", "b", 4.0)


@query("j6_overlay", _overlay_sql("SELECT a, b, CAST(area AS DOUBLE) AS area, round(overlap_a, 6) AS overlap_a, round(overlap_b, 6) AS overlap_b, round(iou, 6) AS iou FROM p"), "parcels")
def _(s: Source):
    return _overlay(s).select("a", "b", "area", R("overlap_a"), R("overlap_b"), R("iou"))


@query(
    "j6_overlay_exact",
    """WITH p AS (SELECT a.field_id AS a, b.field_id AS b, a.x1 - a.x0 AS wa, b.x1 - b.x0 AS wb, (least(a.x1, b.x1 + 13) - greatest(a.x0, b.x0 + 13)) * (least(a.y1, b.y1 - 5) - greatest(a.y0, b.y0 - 5)) AS area
 FROM parcels a JOIN parcels b ON a.x0 < b.x1 + 13 AND b.x0 + 13 < a.x1 AND a.y0 < b.y1 - 5 AND b.y0 - 5 < a.y1)
SELECT a, b, round(CAST(area AS DOUBLE), 6) AS area, round(area / (wa * wa), 6) AS overlap_a, round(area / (wb * wb), 6) AS overlap_b, round(area / (wa * wa + wb * wb - area), 6) AS iou FROM p""",
    "parcels",
)
def _(s: Source):
    """All parcels against all parcels moved 13 to the east and 5 to the south."""
    parcels = _parcels(s).select("field_id", "ring")
    moved = parcels.select(F.col("field_id").alias("b"), F.transform("ring", lambda p: F.struct((p["x"] + 13).alias("x"), (p["y"] - 5).alias("y"))).alias("ring"))
    return vectors.overlay_exact(parcels.withColumnRenamed("field_id", "a"), moved, "a", "b").select("a", "b", *(R(c) for c in ("area", "overlap_a", "overlap_b", "iou")))


_MAPS = {"east": 8, "far": 20}
_CELLS = "SELECT field_id, r, CAST(c AS BIGINT) AS c FROM (SELECT field_id, CAST(unnest(range(CAST(ceil((y0 + d) / 4.0 - 0.5) AS BIGINT), CAST(ceil((y1 + d) / 4.0 - 0.5) AS BIGINT))) AS BIGINT) AS r, x0 + d AS x0, x1 + d AS x1 FROM {t}) t, unnest(range(CAST(ceil(x0 / 4.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 4.0 - 0.5) AS BIGINT))) u(c)"


def _surface_sql(name: str, shift: int) -> str:
    """The surface of one map, from the sampled reference `ra`."""
    return f"""SELECT '{name}' AS map, t_pred, t_ref, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, count(*) AS n FROM (
SELECT * FROM (SELECT a, b, n / na AS overlap_a, n / nb AS overlap_b, n / (na + nb - n) AS iou FROM (SELECT ca.field_id AS a, cb.field_id AS b, count(*) AS n FROM ca JOIN ({_CELLS.format(t=f"(SELECT *, {shift} AS d FROM parcels)")}) cb USING (r, c) GROUP BY 1, 2)
JOIN (SELECT field_id AS a, count(*) AS na FROM ca GROUP BY 1) USING (a) JOIN (SELECT field_id AS b, count(*) AS nb FROM ({_CELLS.format(t="(SELECT *, 0 AS d FROM parcels)")}) GROUP BY 1) USING (b)) QUALIFY row_number() OVER (PARTITION BY a ORDER BY overlap_a DESC, b) = 1) best, g
WHERE overlap_b > t_pred AND overlap_a > t_ref GROUP BY t_pred, t_ref"""


@query(
    "m10_compare_maps",
    f"""WITH k AS (SELECT * FROM parcels WHERE category IS NOT NULL AND category NOT LIKE 'ECONOMY%' QUALIFY row_number() OVER (PARTITION BY x0, y0, x1, y1 ORDER BY field_id) = 1),
q AS (SELECT quantile_cont(area_ha, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM k),
ra AS (SELECT k.*, 0 AS d FROM k, q, range(10) b(i) WHERE (area_ha > q[i + 1] OR i = 0) AND area_ha <= q[i + 2] QUALIFY row_number() OVER (PARTITION BY i ORDER BY field_id) <= 40),
ca AS ({_CELLS.format(t="ra")}), g AS (SELECT x.i / 10.0 AS t_pred, y.i / 10.0 AS t_ref FROM range(6) x(i), range(6) y(i)) """
    + " UNION ALL ".join(_surface_sql(*m) for m in _MAPS.items()),
    "parcels",
)
def _(s: Source):
    p = s.view("parcels").withColumns({k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1", "area_ha")})
    ring = vectors.box_ring("x0", "y0", "x1", "y1").alias("ring")
    reference = p.select("field_id", F.when(F.col("category").startswith("ECONOMY"), "ECONOMY").otherwise(F.col("category")).alias("category"), "area_ha", ring)
    moved = {name: p.withColumns({k: F.col(k) + shift for k in ("x0", "y0", "x1", "y1")}).select("field_id", ring) for name, shift in _MAPS.items()}
    found = pipelines.compare_maps(reference, moved, 4.0, scoring.threshold_grid(s.spark), ["ECONOMY"], 40)
    return found.select("map", "t_pred", "t_ref", R("mean_iou"), R("median_iou"), "n")
