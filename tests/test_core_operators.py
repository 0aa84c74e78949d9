"""Hand-made grids and invariants for operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import DATA
from furrow.functions import formulas
from furrow.operators import composite, focal, graph, grids, labels, masks, sampling, sets, temporal, vectors
from furrow.plans import fluxes, pipelines, registry, sharpen
from furrow.sources import catalog
from furrow.streaming.gaps import stream_fill_et


def cells(spark, picture):
    rows = [(r, c, int(ch)) for r, line in enumerate(picture.split()) for c, ch in enumerate(line) if ch != "."]
    return spark.createDataFrame(rows, "r long, c long, v long")


def by_cell(df, col):
    return {(r.r, r.c): r[col] for r in df.collect()}


# --- graph and labels ---------------------------------------------------------

def test_components_of_a_graph(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 2)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(61)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_hanging_nodes_name_the_least(spark, monkeypatch, rounds):
    """Chains numbered along the path and at random, a hub, loops and nulls, also when the rounds don't settle it."""
    monkeypatch.setattr(graph, "CONTRACTIONS", rounds)
    rng = random.Random(5)
    mixed = rng.sample(range(1000, 2000), 200)
    edges = [(i, i + 1) for i in range(80)] + list(zip(mixed, mixed[1:])) + [(5000 + i, 4999) for i in range(300)] * 2
    edges += [(rng.randrange(7000, 7300), rng.randrange(7000, 7300)) for _ in range(150)] + [(9000, 9000), (None, 9001), (9002, None)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        moved = False
        for a, b in edges:
            if a is not None and b is not None and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                moved = True
        if not moved:
            break
    got = graph.hanging_nodes(spark.createDataFrame(edges, "x long, y long").repartition(16), "x", "y").collect()
    assert sorted(map(tuple, got)) == sorted((x, r) for x, r in root.items() if x is not None and x != r)
    assert graph.hanging_nodes(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2, 3, 100])
def test_label_components(spark, block):
    df = cells(spark, "11022 01020 11011 00100 22222")
    four = by_cell(labels.label_components(df, "v", 4, block), "component")
    key = lambda r, c: r * 2**32 + c
    assert four[(0, 0)] == four[(2, 1)] == key(0, 0)
    assert four[(2, 3)] == key(2, 3) and four[(3, 2)] == key(3, 2) and four[(4, 4)] == key(4, 0)
    eight = by_cell(labels.label_components(df, "v", 8, block), "component")
    assert eight[(2, 3)] == eight[(3, 2)] == eight[(0, 0)] == key(0, 0)
    assert eight[(4, 0)] == key(4, 0) and (0, 2) not in eight


def test_labels_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(r, c, rng.randrange(3)) for r in range(30) for c in range(30)], "r long, c long, v long")
    runs = [by_cell(labels.label_components(df.repartition(n), "v", 4, 8), "component") for n in (1, 7)]
    assert runs[0] == runs[1]
    for (r, c), k in runs[0].items():
        for q in ((r + 1, c), (r, c + 1)):
            if q in runs[0]:
                same = df.filter(f"(r={r} AND c={c}) OR (r={q[0]} AND c={q[1]})").select("v").distinct().count() == 1 if rng.random() < 0.01 else None
                assert same is None or (runs[0][q] == k) == same


def test_overlap_counts(spark):
    df = spark.createDataFrame([(r, c, 1 if c < 4 else 0, 7 if r < 3 else 8) for r in range(6) for c in range(6)], "r long, c long, ref long, pred long")
    pairs = labels.pair_counts(df, "ref", "pred")
    assert pairs.agg(F.sum("n")).first()[0] == 36
    best = labels.best_iou(pairs).collect()
    assert [(r.ref, r.pred, r.n) for r in best] == [(1, 7, 12)] and best[0].iou == pytest.approx(12 / 30)
    assert labels.zonal(df, "ref").first().asDict() == {"ref": 1, "n": 24, "centre_r": 2, "centre_c": 1}


def test_border_distance(spark):
    d = by_cell(labels.border_distance(cells(spark, "00000 01110 01110 01110 00000 00002"), "v"), "dist")
    assert d[(2, 2)] == 1.0 and d[(1, 1)] == 0.5 and d[(5, 4)] == 1.0 and (0, 0) not in d


def test_border_labels_and_boundaries(spark):
    df = cells(spark, "0000 0110 0110 0003")
    assert by_cell(focal.label_boundary(df, "v"), "v").keys() == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}
    assert labels.drop_border_labels(df, "v", 4, 1).select("v").distinct().collect()[0].v == 1


# --- neighbourhoods -----------------------------------------------------------

def test_smoothing_keeps_gaps(spark):
    df = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(c)) for r in range(3) for c in range(3)], "r long, c long, v double")
    s = by_cell(focal.smooth_binomial(df, "v"), "smooth")
    assert s[(1, 1)] is None and s[(0, 0)] == pytest.approx((4 * 0 + 2 * 1 + 2 * 0) / 8)
    assert by_cell(focal.fill_edges(df, "v"), "filled")[(1, 1)] == 1.0


def test_dilate_erode(spark):
    df = cells(spark, "00000 01110 01110 01110 00000")
    assert sum(by_cell(focal.dilate(df, "v"), "v").values()) == 21
    assert by_cell(focal.erode(df, "v"), "v")[(2, 2)] == 1 and sum(by_cell(focal.erode(df, "v"), "v").values()) == 1
    assert sum(by_cell(focal.opened(df, "v"), "v").values()) == 5


def test_slope_of_a_plane(spark):
    df = spark.createDataFrame([(r, c, 10.0 * c) for r in range(4) for c in range(4)], "r long, c long, z double")
    for row in focal.slope_aspect(df, "z", 10.0).collect():
        assert row.slope == pytest.approx(45) and row.aspect == pytest.approx(270)


def test_fill_nearest(spark):
    df = spark.createDataFrame([(0, c, 5.0 if c == 0 else (9.0 if c == 30 else None)) for c in range(31)], "r long, c long, v double")
    f = by_cell(focal.fill_nearest(df, "v"), "filled")
    assert f[(0, 14)] == 5.0 and f[(0, 15)] == 5.0 and f[(0, 16)] == 9.0
    assert focal.fill_nearest(df.withColumn("v", F.lit(None).cast("double")), "v").filter("filled IS NOT NULL").count() == 0


# --- vectors ------------------------------------------------------------------

def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


RINGS = "id long, ring array<struct<x:double,y:double>>"


def test_rasterise(spark):
    df = spark.createDataFrame([(1, ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))), (2, ring((2, 2), (6, 2), (2, 6), (2, 2))), (3, None)], RINGS)
    got = by_cell(vectors.rasterise_polygons(df, "id", 1.0), "id")
    assert got[(0, 0)] == 1 and got[(2, 2)] == 2 and got[(2, 4)] == 2 and (5, 5) not in got and len([k for k in got if got[k] == 1]) == 12
    line = spark.createDataFrame([(1, ring((0.5, 0.5), (3.5, 0.5)))], RINGS)
    edges = vectors.polygon_edges(line, "id")
    assert {(r.r, r.c) for r in vectors.rasterise_lines(edges, "id", 1.0).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3)}
    slanted = vectors.polygon_edges(spark.createDataFrame([(1, ring((0.2, 0.1), (2.7, 2.9)))], RINGS), "id")
    cells_ = {(r.r, r.c) for r in vectors.rasterise_lines(slanted, "id", 1.0).collect()}
    assert {(0, 0), (2, 2)} <= cells_ and all(abs(r - c) <= 1 for r, c in cells_)


def test_polygonise_and_rings(spark):
    df = cells(spark, "11111 10001 10101 10001 11111")
    shape = vectors.polygonise(df, "v", 10.0).first()
    assert shape.n_cells == 17 and shape.n_faces == 20 + 12 + 4 and shape.area_ha == pytest.approx(0.17)
    rings = vectors.label_rings(df, "v", 1.0).collect()
    area = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:])) / 2
    assert sorted(abs(area(r.ring)) for r in rings) == [1, 9, 25] and all(r.ring[0] == r.ring[-1] for r in rings)


# --- grids --------------------------------------------------------------------

def test_chip_modes(spark):
    assert grids.chip_grid(spark, 20, 11, 10, 0).count() == 1  # the last of 20 rows' exact fits is lost
    assert grids.chip_grid(spark, 20, 11, 10, 0, cover=True).count() == 4
    df = spark.range(21).select(F.col("id").alias("r"), F.lit(0).cast("long").alias("c"))
    assert grids.explode_to_chips(df, 21, 10, 10, 2).select("r").distinct().count() == 21


def test_resample_bilinear_between_centres(spark):
    src = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "r long, c long, v double")
    at = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, 1.0)], "k long, x double, y double")
    got = {r.k: r.v for r in grids.resample_bilinear(src, at, 0, 0, 1, 1, "v", ["k"]).collect()}
    assert got[1] == 2.0 and got[2] == pytest.approx(3.0)


def test_mosaic_and_stack(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "r long, c long, v long")
    b = spark.createDataFrame([(0, 1, 2), (0, 2, 2)], "r long, c long, v long")
    assert by_cell(grids.mosaic([a, b], "v"), "v") == {(0, 0): 1, (0, 1): 2, (0, 2): 2}
    assert grids.stack_layers(a, b.withColumnRenamed("v", "w")).count() == 1


# --- time and masks -----------------------------------------------------------

def test_composite_ties_and_empty_days(spark):
    rows = [(1, 2, "2024-01-01 10:00:00", 300.0, 10, 5), (1, 1, "2024-01-01 09:00:00", 300.0, 20, 6), (1, 3, "2024-01-02 09:00:00", 310.0, 50, 7)]
    df = spark.createDataFrame(rows, "pixel long, seq long, ts string, lst double, vza long, vaa long").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r.day): (r.lst, r.vza) for r in composite.best_pixel(df).collect()}
    assert got == {"2024-01-01": (300.0, 20), "2024-01-02": (None, None)}


def test_interpolation_at_the_exact_hour(spark):
    obs = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 10:30:59"), (3, "2024-01-01 11:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    met = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 3.0)], "h string, v double").withColumn("h", F.to_timestamp("h"))
    run = lambda mode: {r.k: r.v for r in temporal.interp_hourly(obs, met, "t", "h", ["v"], mode=mode).collect()}
    assert run("floor") == {1: 1.0, 2: 2.0} and run("ceil") == {1: 1.0, 2: 2.0, 3: 3.0}


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "id long, v long")
    assert [r.v for r in masks.drop_repeated_ids(df, "id").collect()] == [7]
    assert sampling.drop_worst_duplicate(df, "id", "v").count() == 2
    assert {r.v for r in sampling.drop_worst_duplicate(df, "id", "v", "dedup").collect()} == {6, 7}


def test_defaults_only_where_absent(spark):
    got = temporal.with_defaults(spark.createDataFrame([(1, None)], "a long, p double"), {"p": F.lit(9.0), "q": F.lit(8.0)}).first()
    assert got.p is None and got.q == 8.0


def test_quantiles_equal_the_built_in(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice([None, 1.0, 2.0, rng.random() * 9]),) for _ in range(800)], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    expected = df.select(F.percentile("v", F.array(*(F.lit(q) for q in shares)))).first()[0]
    assert sampling.quantiles(df, "v", shares) == pytest.approx(expected)
    assert sampling.quantiles(df.filter("v > 99"), "v", [0.5]) == [None]


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 2)], "k long, x long"), spark.createDataFrame([(2, "s")], "k long, y string")
    assert sets.union_with_source({"a": a, "b": b}).columns == ["k", "x", "source", "y"]
    assert sets.subtract(a, b, ["k"]).count() == 1


# --- catalogues ---------------------------------------------------------------

def test_station_table(spark, tmp_path):
    (tmp_path / "s.txt").write_text("year DOY\ttime T_R1 VZA T_A1 u ea S_dn LAI h_C extra\n2024 60 12.5 300 0 290 2 10 500 1 0.5 7\n 2024 61 0 x 0 290 2 10 500 1 0.5 8\n")
    rows = catalog.read_station(spark, str(tmp_path)).orderBy("DOY").collect()
    assert str(rows[0].ts) == "2024-02-29 12:30:00" and rows[1].T_R1 is None and rows[1].extra == 8
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/s.txt").write_text("year DOY\n2024 1\n")
    with pytest.raises(ValueError, match="T_R1"):
        catalog.read_station(spark, str(tmp_path / "bad"))


def test_assets_and_contract(spark):
    df = spark.sql("SELECT map('a', named_struct('href', 'u', 'type', 't'), 'b', CAST(NULL AS STRUCT<href: STRING, type: STRING>)) AS assets")
    assert catalog.sign_assets(df, "k=1").first().assets["a"].href == "u?k=1"
    assert catalog.bad_assets(df).first().bad == ["b"]
    wanted = T.StructType([T.StructField("assets", T.StringType()), T.StructField("x", T.LongType())])
    assert len(catalog.check_contract(df, wanted)) == 2 and catalog.check_contract(df, df.schema) == []


def test_band_order_is_checked(spark):
    df = spark.createDataFrame([("BLU", "d1", "X")], "band string, scene_date string, tile string")
    assert catalog.order_bands(df, ["BLU"], 1, 1).first().place == 0
    with pytest.raises(ValueError):
        catalog.order_bands(df, ["BLU", "RED"], 1, 1)


def test_files_by_exact_suffix(spark, tmp_path):
    for n in ("b.tif", "a.tif", "c.tiff", "tif"):
        (tmp_path / n).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in catalog.list_scenes(spark, str(tmp_path), ".tif").collect()] == ["a.tif", "b.tif"]


# --- physics ------------------------------------------------------------------

def test_formulas_against_hand_numbers(spark):
    df = spark.createDataFrame([(293.15, 15.0, 1013.25)], "t_a double, ea double, p double")
    row = formulas.HUMIDITY.apply(formulas.AIR.apply(df)).first()
    assert row.lambda_v == pytest.approx(2453780.0) and row.e_sat == pytest.approx(23.37, abs=0.03)
    assert row.rho == pytest.approx(1.197, abs=0.002) and row.rho_w == pytest.approx(997.94, abs=0.01) and row.psicr == pytest.approx(0.669, abs=0.005)
    noon = spark.createDataFrame([(0.0, 0.0, 0.0, 80.0, 12.0)], "lat double, lon double, stdlon double, doy double, hr double")
    assert formulas.SUN.apply(noon).first().sun_zenith < 5
    neutral = spark.sql(f"SELECT {formulas.double(formulas.psi_m('-1e-9'))} AS m, {formulas.double(formulas.psi_h('0.0'))} AS h").first()
    assert neutral.m == pytest.approx(0, abs=1e-3) and neutral.h == pytest.approx(0)


def station(spark, n=1):
    s = registry.base.Source(spark, DATA).view("station").withColumnsRenamed({"t_r1": "t_r", "t_a1": "t_a"})
    return s.withColumns({c: F.col(c).cast("double") for c in s.columns if c != "id"}).filter(f"id % {n} = 0")


def test_energy_balance_closes(spark):
    out = fluxes.run_fluxes(station(spark), ["id"]).toPandas()
    good = out[out.flag != fluxes.FLAG_INVALID]
    assert len(good) > 0.5 * len(out) and set(out.flag) <= {0, 3, 5, 10, 15, 255}
    rn = good.sn_c + good.sn_s + good.ln_c + good.ln_s
    assert np.allclose(rn, good["h"] + good["le"] + good["g"], atol=1e-6)
    assert (good.le_s >= -1e-6)[good.flag.isin([0, 3, 10, 15])].all() and (good.r_a >= 0.1).all()
    assert out[out.flag == 255]["le"].isna().all()


def test_balance_does_not_depend_on_batches(spark):
    df = station(spark, 7)
    runs = [fluxes.run_fluxes(df.repartition(n), ["id"]).orderBy("id").toPandas() for n in (1, 5)]
    assert np.allclose(runs[0].drop(columns="id"), runs[1].drop(columns="id"), equal_nan=True)
    gap = fluxes.run_fluxes(df.withColumn("t_r", F.when(F.col("id") % 2 == 1, F.col("t_r"))), ["id"])
    assert gap.filter("id % 2 = 0 AND flag <> 255").count() == 0


def test_python_and_sql_stability_agree(spark):
    z = [-3.0, -0.5, -0.01, 0.0, 0.2, 2.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select(F.expr(formulas.double(formulas.psi_m("z"))), F.expr(formulas.double(formulas.psi_h("z")))).collect()
    assert np.allclose([r[0] for r in rows], fluxes._psi(np.array(z), False)) and np.allclose([r[1] for r in rows], fluxes._psi(np.array(z), True))


def test_sharpening_recovers_a_linear_scene(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (48, 48))
    x = (x + np.roll(x, 1, 0) + np.roll(x, 1, 1)) / 3
    t = 290 + 12 * x
    fine = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(48) for c in range(48)], "r long, c long, x double")
    low = (t**4).reshape(12, 4, 12, 4).mean(axis=(1, 3)) ** 0.25
    coarse = spark.createDataFrame([(r, c, float(low[r, c])) for r in range(12) for c in range(12)], "r long, c long, lst double")
    got = by_cell(sharpen.sharpen(fine, coarse, 4, ["x"], "lst", window=6), "t_sharp")
    error = np.array([got[(r, c)] - t[r, c] for r in range(48) for c in range(48)])
    assert math.sqrt((error**2).mean()) < 0.4 * t.std()


def test_sharpening_with_any_regressor(spark):
    class Step:
        """A regressor that is no linear form: the mean on either side of one half of the first predictor."""

        def fit(self, x, y, w):
            low = x[:, 0] <= 0.5
            return 0.5, *(float(y[side].mean()) if side.any() else float(y.mean()) for side in (low, ~low))

        def predict(self, model, x):
            return np.where(x[:, 0] <= model[0], model[1], model[2])

    rng = np.random.default_rng(3)
    x = (rng.uniform(0, 1, (12, 12)) > 0.5).repeat(2, 0).repeat(2, 1).astype(float) + rng.uniform(0, 0.1, (24, 24))
    t = np.where(x > 0.5, 300.0, 290.0)
    fine = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(24) for c in range(24)], "r long, c long, x double")
    low = (t**4).reshape(12, 2, 12, 2).mean(axis=(1, 3)) ** 0.25
    coarse = spark.createDataFrame([(r, c, float(low[r, c])) for r in range(12) for c in range(12)], "r long, c long, lst double")
    got = by_cell(sharpen.sharpen(fine, coarse, 2, ["x"], "lst", window=6, regressor=Step()), "t_sharp")
    assert len(got) == 24 * 24 and max(abs(got[r, c] - t[r, c]) for r in range(24) for c in range(24)) < 1e-6


def test_any_model_of_vegetated_rows(spark):
    def still(row):
        return {"flag": np.full(len(row["t_r"]), 7), "steps": np.zeros(len(row["t_r"])), "le_c": row["lai"] * 10}

    df = station(spark, 5)
    out = fluxes.run_fluxes(df, ["id"], model=still, extra=["lai", "skyl"]).toPandas()
    veg = out[out.flag == 7]
    assert len(veg) and np.allclose(veg.le_c, veg.lai * 10) and veg.hf_c.isna().all() and out.skyl.notna().any()
    one = fluxes.run_fluxes(df, ["id"], model="one_source").toPandas()
    good = one[one.flag.isin([10, 15])]
    assert len(good) > 0.9 * len(one) and np.allclose(good.sn_c + good.sn_s + good.ln_s, good["h"] + good["le"] + good["g"], atol=1e-6)


def test_station_results_are_what_the_balance_gives(spark, tmp_path):
    df = station(spark, 5)
    catalog.write_station(fluxes.station_results(df), str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "out"))
    assert back.columns == catalog.STATION_RESULT and back.count() == df.count()
    want = fluxes.run_fluxes(df, ["year", "doy", "hr"]).toPandas().sort_values(["doy", "hr", "le", "h"]).reset_index()
    got = back.toPandas().sort_values(["DOY", "Time", "LE_model", "H_model"]).reset_index()
    for a, b in (("T_S", "t_s"), ("LE_C", "le_c"), ("H_S", "hf_s"), ("G_model", "g"), ("R_A", "r_a"), ("flag", "flag"), ("L", "obukhov"), ("Rn_lw_soil", "ln_s")):
        assert np.allclose(got[a].astype(float), want[b].astype(float), equal_nan=True)
    closed = got[got.flag != 255]
    assert np.allclose(closed.Rn_model, closed.LE_model + closed.H_model + closed.G_model, atol=1e-6)


def test_daily_et_takes_composites_and_ground(spark):
    source = registry.base.Source(spark, DATA)
    weather = source.view("met_hourly").withColumn("ea", 8 + F.col("u100"))
    canopy = source.view("lst_obs").select("pixel").distinct().withColumns({"lai": F.lit(2.0), "h_c": F.lit(0.5)})
    plain, _ = pipelines.et_pipeline(source.view("lst_obs"), weather, canopy, "2000-01-01", "2099-12-31")
    days = [r.day for r in plain.select("day").distinct().orderBy("day").collect()]
    dated = canopy.crossJoin(spark.createDataFrame([(days[0],), (days[-1],)], "comp_date date"))
    some, _ = pipelines.et_pipeline(source.view("lst_obs"), weather, dated, "2000-01-01", "2099-12-31")
    near = {d for d in days if min(abs((d - days[0]).days), abs((d - days[-1]).days)) <= 4}
    assert {r.day for r in some.select("day").distinct().collect()} == near
    flat = canopy.select("pixel", F.when(F.col("pixel") % 3 == 0, 100.0).otherwise(900.0).alias("bnr"), F.lit(1).alias("landcover"), F.lit(200.0).alias("dem"), F.lit(980.0).alias("geopot"))
    wet, _ = pipelines.et_pipeline(source.view("lst_obs"), weather, canopy, "2000-01-01", "2099-12-31", ground=flat)
    assert wet.filter("pixel % 3 = 0").count() == 0 and wet.filter("et IS NOT NULL").count() > 0


def test_distances_and_fills_equal_brute_force(spark):
    """Sparse tables with missing cells, ties and far gaps."""
    rng = random.Random(6)
    for n, share in ((12, 0.5), (15, 0.06), (9, 0.9)):
        rows = [(r, c, rng.choice([None, 0.0, 1.5, 2.5]) if rng.random() > share else None) for r in range(n) for c in range(n) if rng.random() < 0.8]
        rows.append((n + 3, n + 5, None))
        df = spark.createDataFrame(rows, "r long, c long, v double").repartition(3)
        filled = [(r, c, v) for r, c, v in rows if v and v > 0]
        got = {(x.r, x.c): x.filled for x in focal.fill_nearest(df, "v").collect()}
        for r, c, v in rows:
            want = v if v and v > 0 else min((((r - a) ** 2 + (c - b) ** 2, a, b, w) for a, b, w in filled), default=(None,) * 4)[3]
            assert got[r, c] == want
        marks = spark.createDataFrame([(r, c, rng.randrange(3)) for r, c, _ in rows], "r long, c long, v long").cache()
        cells_ = {(x.r, x.c): x.v for x in marks.collect()}
        near = {(x.r, x.c): x.dist for x in labels.proximity(marks, "v", 2.0, 3).collect()}
        for r, c in cells_:
            d2 = min(((r - a) ** 2 + (c - b) ** 2 for (a, b), v in cells_.items() if v == 1), default=99)
            assert near[r, c] == (2.0 * d2**0.5 if d2 <= 9 else None)
        wide = [(a, b) for a in range(-1, n + 6) for b in range(-1, n + 8)]
        d = {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in wide if cells_.get((a, b), 0) != v) ** 0.5 for (r, c), v in cells_.items() if v}
        top = {v: max(d[k] for k in d if cells_[k] == v) for v in {cells_[k] for k in d}}
        found = {(x.r, x.c): x.dist for x in labels.border_distance(marks, "v").collect()}
        assert found == {k: x / top[cells_[k]] for k, x in d.items()}


def test_split_numbers_rows_of_any_stratum(spark):
    rows = [(i, None if i % 5 == 0 else i % 2, i * 7919 % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s long, k long").repartition(7)
    got = {r.id: r.part for r in sampling.split(df, 0.7, ["s"], [F.col("k"), F.col("id")]).collect()}
    for s in (None, 0, 1):
        group = sorted((k, i) for i, x, k in rows if x == s)
        assert [got[i] for _, i in group] == ["train"] * int(len(group) * 0.7) + ["hold"] * (len(group) - int(len(group) * 0.7))


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from furrow import session

    folder = Path(session.scratch_dir(spark).removeprefix("file://"))
    assert session.materialise(spark.range(3), "numbers").count() == 3
    assert any(folder.rglob("*.parquet"))
    session.clear_scratch(spark)
    assert not folder.exists()


def _thermal_scenes(spark, n=4, size=24):
    rng = np.random.default_rng(8)
    rows, low = [], []
    for k in range(n):
        x = rng.uniform(0, 1, (size, size))
        t = 280.0 + 5 * k + (10 - 3 * k) * x + rng.normal(0, 0.3, (size, size))
        rows += [(f"day{k}", r, c, float(x[r, c])) for r in range(size) for c in range(size)]
        coarse = (t**4).reshape(size // 2, 2, size // 2, 2).mean(axis=(1, 3)) ** 0.25
        low += [(f"day{k}", r, c, float(coarse[r, c])) for r in range(size // 2) for c in range(size // 2)]
    return spark.createDataFrame(rows, "day string, r long, c long, x double"), spark.createDataFrame(low, "day string, r long, c long, lst double")


@pytest.mark.parametrize("regressor", [None, "line"])
def test_scenes_are_sharpened_as_each_alone(spark, regressor):
    """Keyed sharpening: every scene as if it were the only one; scenes with a NULL key drop."""

    class Line:
        def fit(self, x, y, w):
            return np.polyfit(x[:, 0], y, 1, w=np.sqrt(w + 1e-9)).tolist()

        def predict(self, model, x):
            return np.polyval(model, x[:, 0])

    model = Line() if regressor else None
    fine, coarse = _thermal_scenes(spark)
    lost = fine.limit(5).withColumn("day", F.lit(None).cast("string"))
    got = {(x.day, x.r, x.c): x.t_sharp for x in sharpen.sharpen(fine.unionByName(lost), coarse, 2, ["x"], "lst", window=6, keys=["day"], regressor=model).collect()}
    assert len(got) == fine.count()
    for day in ("day0", "day3"):
        alone = sharpen.sharpen(*(d.filter(F.col("day") == day).drop("day") for d in (fine, coarse)), 2, ["x"], "lst", window=6, regressor=model)
        assert all(abs(x.t_sharp - got[day, x.r, x.c]) < 1e-9 for x in alone.collect())


def test_only_written_partitions_are_replaced(spark):
    """A rerun of one tile and date leaves all other files as they are; the manifest tells what is left to run."""
    from furrow.session import fresh_path
    from furrow.sources import catalog

    rows = [(t, d, r, c, float(r * c)) for t in ("X0_Y0", "X1 Y/1") for d in ("2024-01-01", "2024-01-02") for r in range(9) for c in range(9)]
    df = spark.createDataFrame(rows, "tile string, date string, r long, c long, v double")
    path = fresh_path(spark, "pixels")
    assert catalog.written_partitions(spark, path).count() == 0
    catalog.write_pixels(df, path, deal=2)
    before = {(x.tile, x.date): x for x in catalog.written_partitions(spark, path).collect()}
    assert set(before) == {(t, d) for t, d, *_ in rows}
    again = df.filter("tile = 'X0_Y0' AND date = '2024-01-02'").withColumn("v", F.col("v") + 1)
    catalog.write_pixels(again, path, deal=2)
    after = {(x.tile, x.date): x for x in catalog.written_partitions(spark, path).collect()}
    assert {k for k in after if after[k].written != before[k].written} == {("X0_Y0", "2024-01-02")}
    assert catalog.read_pixels(spark, path).count() == len(rows)
    requested = spark.createDataFrame([("X0_Y0", "2024-01-01"), ("X9_Y9", "2024-01-01")], "tile string, date string")
    none = requested.limit(0)
    left = catalog.plan_backfill(requested, catalog.written_partitions(spark, path).select("tile", "date"), none, none, ["tile", "date"])
    assert [tuple(x) for x in left.collect()] == [("X9_Y9", "2024-01-01", "sharpen")]


def test_decile_draws_are_not_in_ten_tasks(spark):
    """Ranks of a bin come from ranges: no window over a whole bin is in the plan."""
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 4999).cast("double").alias("size"))
    drawn = sampling.sample_per_decile(df, "id", "size", 200)
    assert drawn.groupBy("bin").count().filter("count <> 200").count() == 0 and drawn.count() == 2000
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_part" in plan and "row_number() windowspecdefinition(bin" not in plan


def test_nearest_sources_take_no_longer_when_far(spark):
    """One source in a wide row costs what a full row costs; distances and ties are those of a full search."""
    import time

    rng = np.random.default_rng(2)
    for n, share in ((60, 0.5), (60, 0.05), (1, 1.0), (90, 0.9)):
        row, column = np.repeat([3, 5, 9], n), np.tile(rng.permutation(n * 2)[:n], 3)
        gap = np.where(rng.random(3 * n) < share, rng.integers(0, 6, 3 * n).astype(float), np.nan)
        from_r = row - gap * rng.choice([-1, 1], 3 * n)
        d2, origin = focal.row_nearest(row, column, gap, from_r, np.ones(3 * n, bool))
        for i in range(3 * n):
            found = [((column[i] - column[j]) ** 2 + gap[j] ** 2, from_r[j], column[j], j) for j in range(3 * n) if row[j] == row[i] and not np.isnan(gap[j])]
            assert (d2[i], origin[i]) == ((min(found)[0], min(found)[3]) if found else (1 << 62, -1))
    width, took = 4000, {}
    for name, filled in (("full", width), ("one", 1)):
        row, column = np.repeat(np.arange(50), width), np.tile(np.arange(width), 50)
        gap = np.where(column < filled, 2.0, np.nan)
        began = time.perf_counter()
        d2, _ = focal.row_nearest(row, column, gap, row - 2.0, np.ones(len(row), bool))
        took[name] = time.perf_counter() - began
    assert (d2 == column.astype(np.int64) ** 2 + 4).all() and took["one"] < 3 * took["full"]


@pytest.mark.parametrize("tile, block, connectivity", [(8, 4, 8), (8, 8, 4), (6, 2, 4)])
def test_grid_search_equals_labels_of_each_point(spark, tile, block, connectivity):
    rng = random.Random(tile * block)
    side = 16
    values = {(r, c): (rng.choice([None, 0.2, 0.4, 0.4, 0.6, 0.8]), rng.choice([0.1, 0.3, 0.5]), rng.choice([None, 0, 1, 1, 2, 3])) for r in range(side) for c in range(side) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, *v) for (r, c), v in values.items()], "r int, c int, extent double, boundary double, ref int").repartition(3)
    got = {(x.row_col_start, x.t_ext, x.t_bound, x.ref): x for x in labels.grid_search_iou(df, [0.4, 0.3, 0.8], [0.2, 0.6], tile, connectivity=connectivity, block=block).collect()}
    steps = focal.FOUR if connectivity == 4 else focal.EIGHT
    n = 0
    for t_ext in (0.3, 0.4, 0.8):
        for t_bound in (0.2, 0.6):
            for tr in range(0, side, tile):
                for tc in range(0, side, tile):
                    here = {k: v for k, v in values.items() if tr <= k[0] < tr + tile and tc <= k[1] < tc + tile}
                    inside = {k for k, (e, b, _) in here.items() if e is not None and e >= t_ext and b < t_bound}
                    label = dict.fromkeys(here, 0)
                    for seed in sorted(inside):
                        todo = [seed] if not label[seed] else []
                        while todo:
                            r, c = todo.pop()
                            if not label[r, c]:
                                label[r, c] = seed[0] * (1 << 32) + seed[1] + 1
                                todo += [(r + i, c + j) for i, j in steps if (r + i, c + j) in inside]
                    for ref in {v[2] for v in here.values() if v[2]}:
                        own = [k for k, v in here.items() if v[2] == ref]
                        iou = {}
                        for p in {label[k] for k in own} - {0}:
                            both, size = sum(label[k] == p for k in own), sum(x == p for x in label.values())
                            iou[p] = (both / (len(own) + size - both), both / size, both / len(own))
                        best = max(iou, key=lambda p: (iou[p][0], -p), default=None)
                        centre = (sum(k[0] for k in own) // len(own), sum(k[1] for k in own) // len(own))
                        at = label.get(centre)
                        x = got[f"{tr}_{tc}", t_ext, t_bound, ref]
                        want = (len(own), iou[best][0] if best else 0.0, best, iou[at][0] if at in iou else 0.0, *centre, at, *(iou[best][1:] if best else (None, None)))
                        assert (x.field_size, x.max_iou, x.best_pred, x.centre_iou, x.centre_r, x.centre_c, x.centre_pred, x.ratio_pred, x.ratio_true) == want
                        n += 1
    assert len(got) == n > 50


def test_models_are_opened_once_a_worker(spark):
    """Chips in batches of any size give the same bands; the model's bytes are opened at most once a worker process."""
    from furrow.operators import grids
    from furrow.plans.registry.products import mixing

    df = spark.createDataFrame([(r, c, float(r), float(c) if r % 3 else None) for r in range(30) for c in range(30) if (r + c) % 7], "r long, c long, a double, b double").repartition(8)
    chips = grids.explode_to_chips(df, 30, 30, 8, 2)
    results = []
    for batch in (1, 3, 1000):
        loads = spark.sparkContext.accumulator(0)
        out = pipelines.infer_chips(chips, ["a", "b"], 8, None, ["x", "y", "z"], model=f"[[1, 0], [0, 1], [2, {batch / batch}]]".encode(), load=mixing, batch=batch, loads=loads)
        results.append(sorted(tuple(r) for r in out.collect()))
        assert 1 <= loads.value <= 4  # local[4]
    assert results[0] == results[1] == results[2] and len(results[0]) == chips.count()
    assert all(z == 2 * x + y for *_, x, y, z in results[0])
    assert pipelines.infer_chips(chips.limit(0), ["a", "b"], 8, lambda image: image, ["x", "y"]).count() == 0


def _stump(x, y, w, bins, least):
    """Best first split by a full search: predictor and threshold."""
    best = None
    for f in range(x.shape[1]):
        for t in np.quantile(x[:, f], np.arange(1, bins) / bins):
            left = x[:, f] <= t
            if left.sum() >= least and (~left).sum() >= least:
                score = sum(np.sum(w[s] * y[s]) ** 2 / np.sum(w[s]) for s in (left, ~left))
                if best is None or score > best[0] + 1e-9:
                    best = score, f, t
    return best[1:]


def test_trees_find_pieces_that_a_line_misses(spark):
    """Two scenes that are linear in pieces: the tree's first splits are those of a full search, and the sharpened cells are right where one ridge is far off."""
    from furrow.plans import tree

    rng = np.random.default_rng(4)
    rows, low, truth = [], [], {}
    for day in range(2):
        x = rng.uniform(0, 1, (48, 48, 2)).repeat(2, 0).repeat(2, 1)
        a, b = x[..., day], x[..., 1 - day]
        t = np.where(a <= 0.5, 300 - 10 * b, 270 + 20 * b)
        x, t = x + rng.normal(0, 1e-4, x.shape), t
        rows += [(day, r, c, float(x[r, c, 0]), float(x[r, c, 1])) for r in range(96) for c in range(96)]
        coarse = (t**4).reshape(48, 2, 48, 2).mean(axis=(1, 3)) ** 0.25
        low += [(day, r, c, float(coarse[r, c])) for r in range(48) for c in range(48)]
        truth[day] = t
    fine, coarse = spark.createDataFrame(rows, "day int, r long, c long, p double, q double"), spark.createDataFrame(low, "day int, r long, c long, lst double")
    train = sharpen.training_rows(fine, coarse, 2, ["p", "q"], "lst", keys=["day"]).cache()
    attach = lambda some, table: some.join(table, "day")
    grown = {m.day: m for m in tree.fit_tree(train, ["p", "q"], ["day"], attach, sharpen.fit_linear, depth=2, bins=16).collect()}
    for day in truth:
        some = train.filter(F.col("day") == day).toPandas()
        feature, threshold = _stump(some[["mean_p", "mean_q"]].to_numpy(), some.y.to_numpy(), some.w.to_numpy(), 16, 10)
        first = grown[day].splits[1]
        assert first.feature == feature == day and abs(first.threshold - threshold) < 1e-9
        assert set(grown[day].leaves) == {4, 5, 6, 7}
    error = {}
    for depth in (0, 3):
        got = sharpen.sharpen(fine, coarse, 2, ["p", "q"], "lst", window=100, keys=["day"], depth=depth).collect()
        assert len(got) == 2 * 96 * 96
        error[depth] = float(np.mean([abs(g.t_sharp - truth[g.day][g.r, g.c]) for g in got]))
    assert error[3] < 0.5 * error[0]


def _clipped(subject, convex):
    """Area of a polygon inside a convex one (counter-clockwise), clipped side by side."""
    out = subject
    for (x0, y0), (x1, y1) in zip(convex, convex[1:] + convex[:1]):
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)  # noqa: B023,E731
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            if side(p) >= 0:
                kept.append(p)
            if (side(p) > 0) != (side(q) > 0) and side(p) != side(q):
                t = side(p) / (side(p) - side(q))
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1]))) / 2


def test_overlay_areas_are_exact(spark):
    """Any simple polygons against convex ones of very different sizes, far from the origin, in both directions of turning."""
    rng = random.Random(12)

    def star(x, y, size, n, convex):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        return [(x + (size if convex else size * rng.uniform(0.3, 1)) * math.cos(t), y + (size if convex else size * rng.uniform(0.3, 1)) * math.sin(t)) for t in turns]

    off = 4_500_000.0
    left = {i: star(off + rng.uniform(0, 100), off + rng.uniform(0, 100), rng.choice([1, 4, 15, 60]), rng.randrange(5, 14), False) for i in range(60)}
    right = {i: star(off + rng.uniform(0, 100), off + rng.uniform(0, 100), rng.choice([2, 7, 40]), rng.randrange(5, 9), True) for i in range(60)}
    left[100] = [(off, off), (off + 10, off), (off + 10, off + 10), (off, off + 10)]
    right[100] = [(off + 10, off), (off + 20, off), (off + 20, off + 10), (off + 10, off + 10)]  # only touches
    right[101] = [(off + 2, off + 2), (off + 4, off + 2), (off + 4, off + 4), (off + 2, off + 4)]  # inside
    rings = lambda some, turn: [(i, [{"x": float(x), "y": float(y)} for x, y in (p + p[:1])[:: -1 if turn and i % 2 else 1]]) for i, p in some.items()]
    kind = "long, ring array<struct<x:double,y:double>>"
    a = spark.createDataFrame([*rings(left, True), (900, None), (901, [{"x": off, "y": off}] * 4)], f"a {kind}").repartition(3)
    b = spark.createDataFrame(rings(right, True), f"b {kind}").repartition(2)
    got = {(r.a, r.b): r for r in vectors.overlay_exact(a, b, "a", "b").collect()}
    inside = lambda p: abs(sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:] + p[:1]))) / 2
    near = lambda p: [(x - off, y - off) for x, y in p]
    n = 0
    for i, p in left.items():
        for j, q in right.items():
            want = _clipped(near(p), near(q))
            if want > 1e-6:
                n += 1
                assert abs(got[i, j].area - want) < 1e-5 * max(1, want)
                assert abs(got[i, j].iou - want / (inside(near(p)) + inside(near(q)) - want)) < 1e-5
    assert n > 200 and all(_clipped(near(left[i]), near(right[j])) > 1e-9 for i, j in got) and (100, 100) not in got
    assert vectors.overlay_exact(a.limit(0), b, "a", "b").count() == 0


def _rings_of(cells_of):
    """{label: rings} by walking each outline with the label to the left, the sharpest left turn first."""
    out = {}
    for label in set(cells_of.values()) - {0}:
        own = {k for k, v in cells_of.items() if v == label}
        step = {}
        for r, c in own:
            for (x0, y0, x1, y1), beside in (((c, r, c + 1, r), (r - 1, c)), ((c + 1, r, c + 1, r + 1), (r, c + 1)), ((c + 1, r + 1, c, r + 1), (r + 1, c)), ((c, r + 1, c, r), (r, c - 1))):
                if beside not in own:
                    step.setdefault((x0, y0), []).append((x1, y1))
        rings = []
        while step:
            at = start = min(step)
            ring, heading = [start], None
            while True:
                to = max(step[at], key=lambda b: 0 if heading is None else heading[0] * (b[1] - at[1]) - heading[1] * (b[0] - at[0]))  # noqa: B023
                step[at].remove(to)
                if not step[at]:
                    del step[at]
                now = (to[0] - at[0], to[1] - at[1])
                ring = [*ring[:-1], to] if now == heading else [*ring, to]
                at, heading = to, now
                if at == start:
                    break
            rings.append(ring)
        out[label] = rings
    return out


@pytest.mark.parametrize("block", [2, 5, vectors.RING_BLOCK])
def test_rings_of_any_length_are_put_together(spark, block):
    """Outlines over many blocks, with holes and parts that touch at corners, are those of one walk."""
    rng = random.Random(block)
    some = {(r, c): rng.choice([0, 1, 1, 1, 2]) for r in range(24) for c in range(24)}
    some |= {(r + 30, c): 7 for r in range(20) for c in range(20) if r in (0, 19) or c in (0, 19) or (r + c) % 9 == 0}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in some.items()], "r int, c int, v int").repartition(4)
    got = {}
    for x in vectors.label_rings(df, "v", 1.0, block).collect():
        got.setdefault(x.v, {})[x.ring_no] = [(int(p.x), int(p.y)) for p in x.ring]
    want = _rings_of(some)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want and max(map(len, want.values())) > 3
    assert vectors.label_rings(df.filter("v = 0"), "v", 1.0).count() == 0


def test_bucketed_layers_are_stacked_without_a_shuffle(spark):
    """Three written layers of one grid: no exchange in the plan, one file a bucket, the rows of plain tables."""
    from furrow.operators import grids
    from furrow.sources import catalog

    layers = [spark.range(4000).select((F.col("id") % 83).alias("r"), F.floor(F.col("id") / 83).cast("long").alias("c"), (F.col("id") * k).alias(f"v{k}")).filter(F.col("id") % 11 != k) for k in (1, 2, 3)]
    names = [f"layer_{k}" for k in range(3)]
    try:
        for layer, name in zip(layers, names, strict=True):
            catalog.write_layer(layer, name, 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stacked = grids.stack_layers(*(catalog.read_layer(spark, n) for n in names))
        plan = stacked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, stacked.collect())) == sorted(map(tuple, grids.stack_layers(*layers).collect()))
        assert len(spark.table(names[0]).inputFiles()) == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- shared folder ----------------------------------------------------------------

def test_passing_tables_go_and_lasting_ones_stay(spark):
    from furrow.session import fresh_path, materialise, passing_tables

    lasting = fresh_path(spark, "lasting")
    with passing_tables(spark):
        inner = materialise(spark.range(5), "inner")
        with passing_tables(spark):
            nested = materialise(inner, "nested")
            kept = materialise(nested, "kept", lasting)
        assert inner.count() == 5
    assert kept.count() == 5
    with pytest.raises(Exception, match="FILE|exist"):
        inner.collect()
    assert "passing" not in fresh_path(spark, "after")


# --- streams ---------------------------------------------------------------------

def test_gaps_filled_in_a_stream(spark, tmp_path):
    """Days out of order, late days, gaps before any coefficient, null and zero references: what batch gives without the late ones."""
    rng = random.Random(5)
    rows = [(p, d, None if rng.random() < 0.4 else rng.uniform(0, 6), rng.choice([None, -1.0, 0.0, 2.0, 3.5])) for p in [None, 1, 2, 3] for d in range(12)]
    days = lambda some: spark.createDataFrame([(p, d, e, r, 1.0) for p, d, e, r in some], "pixel long, d int, et double, et_ref double, us double").withColumn("day", F.timestamp_seconds((20000 + F.col("d").cast("long")) * 86400))
    batches = [[r for r in rows if (r[1] + (r[0] or 0) % 3) // 5 == k] for k in range(3)]
    late = (1, 0, 5.0, 1.0)
    closing = (9, 30, None, None)
    for batch in [*batches, [closing], [late, (9, 31, 1.0, 1.0)]]:
        rng.shuffle(batch)
        days(batch).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(days([]).schema).parquet(f"{tmp_path}/in")
        out = stream_fill_et(stream, "pixel", "day", "et", "et_ref")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    shown = lambda df: sorted((str(r.pixel), r.day, r.kc, r.et_filled) for r in df.collect())
    assert shown(spark.read.parquet(f"{tmp_path}/out")) == shown(temporal.fill_et(days(rows), "pixel", "day", "et", "et_ref"))


# --- what the driver is sent --------------------------------------------------

def _boxes_of(spark, n):
    box = lambda i: [(x + 40.0 * i, y) for x, y in ((0.0, 0.0), (12.0, 0.0), (12.0, 9.0), (0.0, 9.0), (0.0, 0.0))]
    # read from files, as only these have an estimated size
    return labels.materialise(spark.createDataFrame([(i, box(i)) for i in range(n)], "id long, ring array<struct<x:double,y:double>>"), "boxes")


def _plans(monkeypatch, run):
    """The plans, as made from estimates, of all tables that run writes, and of its result."""
    seen = []
    plan = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (labels, vectors):
        kept = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, f=kept: plan(df) or f(df, name))
    plan(run())
    return seen


def test_label_stack_sends_no_cells_through_the_driver(spark, monkeypatch):
    """Explode hides the number of cells from Spark's estimates, so no join may be planned by them."""
    boxes = _boxes_of(spark, 20)
    plans = _plans(monkeypatch, lambda: vectors.label_stack(boxes, "id", 1.0))
    assert len(plans) == 3 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("batch", [3, 10000])
def test_field_distance_does_not_depend_on_batches(spark, batch):
    rng = random.Random(3)
    rows = [(r, c, (1 + r // 40) if rng.random() < 0.9 else 9) for r in range(-20, 60) for c in range(7)]
    df = spark.createDataFrame([*rows, (0, 0, None), rows[5]], "r long, c long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(x.r, x.c, x.v, round(x.dist, 9)) for x in labels.field_distance(df, "v").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {(r, c): v for r, c, v in rows}
    far = {}
    for (r, c), v in at.items():
        far[r, c] = min((r - i) ** 2 + (c - j) ** 2 for i in range(-21, 61) for j in range(-1, 8) if at.get((i, j)) != v) ** 0.5
    most = {v: max(far[p] for p in at if at[p] == v) for v in set(at.values())}
    assert sorted(got) == sorted((r, c, v, round(far[r, c] / most[v], 9)) for (r, c), v in at.items())


def test_overlay_pairs_sends_no_cells_through_the_driver(spark, monkeypatch):
    boxes = _boxes_of(spark, 20)
    plans = _plans(monkeypatch, lambda: vectors.overlay_pairs(boxes, boxes.withColumnRenamed("id", "other"), "id", "other", 1.0))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_overlay_exact_sends_no_boxes_through_the_driver(spark, monkeypatch):
    boxes = _boxes_of(spark, 20)
    plans = _plans(monkeypatch, lambda: vectors.overlay_exact(boxes, boxes.withColumnRenamed("id", "other"), "id", "other"))
    assert len(plans) == 1 and plans[0].count("SortMergeJoin") == 4 and "Broadcast" not in plans[0]


def test_bowen_closure_without_latent_heat(spark, duck):
    """As the ratio h / le goes to infinity, all available energy is sensible heat; without any flux nothing is known."""
    rows = [(100.0, 10.0, 30.0, 0.0), (100.0, 10.0, -30.0, 0.0), (100.0, 10.0, 0.0, 0.0), (100.0, 10.0, 20.0, -20.0), (100.0, 10.0, -13.0, 10.0), (100.0, 10.0, 30.0, 15.0), (100.0, 10.0, None, 5.0), (None, 10.0, 30.0, 0.0), (100.0, 10.0, 30.0, None)]
    df = spark.createDataFrame(rows, "rn double, g double, h double, le double")
    got = [(r.le_closed, r.h_closed) for r in formulas.BOWEN.apply(df.coalesce(1)).collect()]
    assert got[:2] == [(0.0, 90.0), (0.0, 90.0)] and all(map(math.isnan, got[2])) and got[3] == (-20.0, 20.0)
    assert got[4] == pytest.approx((-300.0, 390.0)) and got[5] == pytest.approx((30.0, 60.0)) and got[6:] == [(None, None)] * 3
    plain = "SELECT CASE WHEN h / nullif(le, 0) > -1.3 AND h / nullif(le, 0) < -0.7 THEN le ELSE (rn - g) / (1 + h / le) END FROM (VALUES (100e0, 10e0, 30e0, 0e0), (100e0, 10e0, 0e0, 0e0)) t(rn, g, h, le)"
    assert [repr(x) for x, in duck.execute(plain).fetchall()] == [repr(x) for x, _ in (got[0], got[2])]


# --- the balance against SQL ---------------------------------------------------

def _rows_equal_sql(spark, folder, name, rows):
    """The named query over events of these (id, time, value), and its SQL."""
    import duckdb

    from conftest import assert_same

    path = str(folder / "events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    values = ", ".join(f"({i}, TIMESTAMP '{t}', {i % 1500}, 'view', {v}e0, '')" for i, t, v in rows)
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS event_id, t AS ts, CAST(u AS BIGINT) AS user_id, e AS event_type, v AS value, p AS props FROM (VALUES {values}) x(i, t, u, e, v, p)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert_same(registry.QUERIES[name](spark, str(folder)), con, registry.ORACLES[name])


def test_station_rows_that_wander_equal_sql(spark, tmp_path):
    """Rows whose iteration enlarges the last bits of their inputs before it settles."""
    rows = [
        (22032, "2024-01-07 14:54:22", 14.37), (58632, "2024-01-18 13:58:26", 47.04), (80952, "2024-01-25 06:43:42", 25.17), (94597, "2024-01-29 09:18:35", 14.78),
        (142152, "2024-01-13 14:21:44", 50.24), (173832, "2024-01-23 03:41:23", 25.17), (184751, "2024-01-26 09:42:46", 60.41), (231192, "2024-01-10 08:26:44", 15.06),
    ]
    _rows_equal_sql(spark, tmp_path, "m1_station_fluxes", rows)


def test_functions_of_the_balance_are_the_c_library_s():
    plain = fluxes._library(check=False)
    x = np.random.default_rng(4).uniform(0.001, 1, 20000)
    for name in ("exp", "log", "log10", "sin", "cos", "tan", "atan", "acos"):
        want = [getattr(math, name)(v) for v in x]
        assert getattr(plain, name)(x).tolist() == want and getattr(fluxes.C, name)(x).tolist() == want
    assert plain.pow(40 * x, 0.78).tolist() == fluxes._pow(40 * x, 0.78).tolist() == [math.pow(v, 0.78) for v in 40 * x]
    assert fluxes._pow(x, 2).tolist() == [math.pow(v, 2) for v in x] and math.isnan(plain.log(np.array([-1.0]))[0])


def test_two_source_rows_that_wander_equal_sql(spark, tmp_path):
    rows = [
        (123432, "2024-01-08 01:12:15", 36.97), (136752, "2024-01-11 23:57:54", 38.32), (291552, "2024-01-28 11:23:53", 37.4), (332995, "2024-01-10 21:05:33", 53.98),
        (358915, "2024-01-18 15:57:24", 57.07), (404592, "2024-01-02 09:34:31", 38.15), (418272, "2024-01-06 12:11:52", 39.4), (566994, "2024-01-21 02:34:37", 10.95),
    ]
    _rows_equal_sql(spark, tmp_path, "m3_two_source", rows)
