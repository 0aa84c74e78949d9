"""Column-set queries over station and pixel rows; their SQL twins are written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import canopy
from furrow.functions import formulas as f
from furrow.operators import masks
from furrow.plans.registry.base import Source, query, rounded
from furrow.plans.registry.physics_sql import TWINS

_STATION = (
    "SELECT CAST(id AS BIGINT) AS id, CAST(year AS DOUBLE) AS year, CAST(doy AS DOUBLE) AS doy, CAST(round(hr * 60) AS DOUBLE) / 60e0 AS hr, CAST(t_r1 AS DOUBLE) AS t_r, CAST(t_a1 AS DOUBLE) AS t_a, CAST(u AS DOUBLE) AS u, CAST(ea AS DOUBLE) AS ea, "
    "CAST(s_dn AS DOUBLE) AS s_dn, CAST(lai AS DOUBLE) AS lai, CAST(h_c AS DOUBLE) AS h_c, CAST(vza AS DOUBLE) AS vza, CAST(id % 17 AS BIGINT) AS landcover, CAST(100 + id % 900 AS DOUBLE) AS elev, CAST(47 + (id % 80) / 10.0 AS DOUBLE) AS lat, "
    "CAST(6 + (id % 90) / 10.0 AS DOUBLE) AS lon, CAST(15 AS DOUBLE) AS stdlon, CAST(10 + id % 75 AS DOUBLE) AS sza, CAST(id % 360 AS DOUBLE) AS saa, CAST(id % 30 AS DOUBLE) AS slope, CAST((id * 7) % 360 AS DOUBLE) AS aspect, "
    "CAST(0.2 + (id % 8) / 10.0 AS DOUBLE) AS f_c, CAST(1 AS DOUBLE) AS w_c, CAST(id % 90 AS DOUBLE) AS psi, CAST(10 AS DOUBLE) AS z_u, CAST(10 AS DOUBLE) AS z_t, CAST(0.05 AS DOUBLE) AS leaf_w FROM station"
)


def _rows(s: Source):
    """Station rows as doubles."""
    return s.spark.sql(_STATION.replace("FROM station", "FROM {station}"), station=s.view("station"))


def _register(name: str, chain: f.FormulaSet, extra: dict[str, str], out: list[str], digits: int = 6) -> None:
    """A query that applies a chain to station rows and rounds the named columns."""
    first = f.FormulaSet(extra)

    @query(name, f"WITH s AS ({_STATION}), {TWINS[name]}" if not TWINS[name].startswith("SELECT") else f"WITH s AS ({_STATION}) {TWINS[name]}", "station")
    def _(s: Source):
        return chain.apply(first.apply(_rows(s))).select("id", *(rounded(F.col(c).cast("double"), digits).alias(c) for c in out))


_P = f.PRESSURE.columns
_register("c1_air", f.AIR, _P, ["p", "c_p", "lambda_v", "psicr", "rho", "rho_w", "black_body"])
_register("c2_humidity", f.AIR | f.HUMIDITY, _P, ["e_sat", "e_slope", "mixing", "lapse_moist"])
_register("c3_sun", f.SUN, {}, ["decl", "sun_zenith", "sun_azimuth"], 5)
_register("c3_zenith", f.ZENITH, {}, ["zenith"], 5)
_register("c4_terrain", f.TERRAIN, {"t2m": "t_a", "sp": "1013.25", "dem": "elev", "geopot": "elev * 9.0", "rate": "0.0098", "blend": "100.0"}, ["t_terrain", "p_terrain"])
_register("c5_wind", f.WIND | f.LOG_WIND, {"u100": "u - 3.0", "v100": "u / 2.0", "d_0": "0.65 * h_c", "z_0m": "h_c / 8.0", "z_to": "2.0"}, ["wind", "u_to"])
_register("c6_vegetation", f.LAI_FROM_NDVI | f.LEAF_CONTENT, {"ndvi": "lai / 5.0 - 0.1", "ccc": "lai * 40.0 + 1.0", "cwc": "lai * 0.01"}, ["lai_ndvi", "cab", "cw"])
_register("c8_leaf_optics", f.LEAF_OPTICS, {"cab": "CASE WHEN lai > 0.1 THEN 250.0 - 60.0 * lai END", "cw": "CASE WHEN lai > 0.1 THEN lai / 30.0 END"}, ["rho_vis", "tau_vis", "rho_nir", "tau_nir"])
_register("c9_longwave", f.AIR | f.HUMIDITY | f.LONGWAVE, _P, ["t_surface", "emis_sky", "l_dn"], 5)
_register("c10_incidence", f.SUN | f.INCIDENCE, {"acquired": "CASE WHEN id % 9 = 0 THEN 0 ELSE id END"}, ["incidence"], 4)
_register("c11_diffuse", f.DIFFUSE, _P, ["dir_vis", "dif_vis", "dir_nir", "dif_nir", "f_vis", "skyl_vis", "skyl_nir", "skyl"])
_SPLIT = {**_P, **f.DIFFUSE.columns, "s_dir": "s_dn * (1.0 - skyl)", "s_dif": "s_dn * skyl", "lai_eff": "lai * 0.9", "rho_vis": "0.07", "tau_vis": "0.08", "rho_nir": "0.32", "tau_nir": "0.33", "soil_vis": "0.15", "soil_nir": "0.25"}
_register("c12_net_shortwave", f.NET_SHORTWAVE, _SPLIT, ["k_be", "tau_d", "sn_c", "sn_s"], 5)
_register("c12_net_longwave", f.CANOPY_K | f.NET_LONGWAVE, {"l_dn": "330.0", "emis_c": "0.98", "emis_s": "0.95", "t_canopy": "t_a", "t_soil": "t_r"}, ["ln_c", "ln_s"], 5)
_register("c13_clumping", f.CLUMPING, {}, ["omega0", "omega", "omega_rows"])
_register("c14_roughness", f.ROUGHNESS, {}, ["z_0m", "d_0"])
_NEUTRAL = {"d_0": "0.65 * h_c", "z_0m": "h_c / 8.0", "z_0h": "z_0m", "u_star": "greatest(u * KARMAN / ln((z_u - d_0) / z_0m), 0.01)", "l_mo": "CASE id % 3 WHEN 0 THEN -30.0 WHEN 1 THEN 50.0 END", "dt": "t_r - t_a"}
_register("c15_resistances", f.RESISTANCES, _NEUTRAL, ["u_c", "u_s", "u_d", "r_a", "r_s_kn", "r_s_cm", "r_s_mv", "r_x_kn", "r_x_cm", "r_x_mv"], 5)
_register("c16_stability", f.STABILITY, {**_P, **f.AIR.columns, "d_0": "0.65 * h_c", "z_0m": "h_c / 8.0", "l_mo": "CASE id % 3 WHEN 0 THEN -30.0 WHEN 1 THEN 50.0 END", "h": "t_r - t_a", "le": "s_dn / 4.0", "t_r0": "t_r - 5.0", "t_r1": "t_r", "t_a0": "t_a - 2.0"}, ["psi_m_b", "psi_h_b", "psi_m_d", "psi_h_d", "u_star", "obukhov", "richardson"], 5)
_register("c17_soil_heat", f.SOIL_HEAT, {"rn_s": "s_dn * 0.4"}, ["g_constant", "g_ratio", "g_cosine", "g_sigmoid"])
_register("c18_daily_et", f.AIR | f.DAILY_ET, {**_P, "s_mean": "s_dn / 3.0", "le": "s_dn / 2.5", "s_inst": "s_dn"}, ["le_daily", "et_daily"])
_register("c19_reference_et", f.AIR | f.HUMIDITY | f.REFERENCE_ET, _P, ["s_clear", "cloud", "ln_out", "le_fao", "le_tall", "le_short"], 5)
_register("c20_tilted", f.TILTED, {}, ["kt", "dhi", "dni", "poa"], 5)
_register("c21_component_t", f.COMPONENT_T, {"t_canopy": "t_a", "t_soil": "t_r + 6.0", "omega": "0.8"}, ["f_theta", "t_s", "t_cnp", "flag_t"], 5)
_register("j13_component_temps", f.TWO_VIEWS, {"vza_near": "vza / 9.0", "vza_far": "40.0 + vza / 9.0", "t_near": "t_r", "t_far": "t_r - 1.0"}, ["t_soil2", "t_leaf2"], 3)
_register("a23_bowen", f.BOWEN, {"rn": "s_dn * 0.6", "g": "s_dn * 0.06", "h": "(t_r - t_a) * 15.0", "le": "s_dn / 4.0 - 40.0"}, ["le_closed", "h_closed"], 5)



@query(
    "a21_region_scaling",
    "WITH v AS (SELECT r, c, tile, (bnr - red) / nullif(bnr + red, 0) AS ndvi FROM pixels), l AS (SELECT *, 57e-2 * exp(233e-2 * ndvi) AS lai FROM v) SELECT r, c, round(greatest(least((ndvi - min(ndvi) OVER (PARTITION BY tile)) / nullif(max(ndvi) OVER (PARTITION BY tile) - min(ndvi) OVER (PARTITION BY tile), 0), 1), 0), 6) AS f_g, round(greatest(least(lai * 12e-1 / max(lai) OVER (PARTITION BY tile), 12e-1), 0), 6) AS h_canopy FROM l",
    "pixels",
)
def _(s: Source):
    v = masks.with_ndvi(s.view("pixels"), "red", "bnr").withColumn("lai", 0.57 * F.exp(2.33 * F.col("ndvi")))
    out = canopy.with_canopy_height(canopy.with_fg_gutman(v, "ndvi", "tile"), "lai", "tile")
    return out.select("r", "c", rounded("f_g", 6).alias("f_g"), rounded("h_canopy", 6).alias("h_canopy"))


def _steps_sql(n: int) -> str:
    out = f"SELECT id, lai, fapar, theta, lai AS pai, 1e0 AS fg, 0e0 AS fipar FROM (SELECT id, lai, 5e-2 + lai / 5e0 AS fapar, radians(sza) AS theta FROM ({_STATION}) s0) z"
    cosine = "greatest(least(cos(theta), 1e0), 1e-2)"
    for _ in range(n):
        fip = f"greatest(least(1e0 - exp(-5e-1 * pai / {cosine}), 1e0), 1e-6)"
        out = f"SELECT id, lai, fapar, theta, lai / greatest(least(fapar / fipar, 1e0), 1e-2) AS pai, greatest(least(fapar / fipar, 1e0), 1e-2) AS fg, fipar FROM (SELECT id, lai, fapar, theta, {fip} AS fipar FROM ({out}) a) b"
    return out


@query("c7_green_fraction", f"SELECT id, round(fg, 5) AS f_green, round(fipar, 5) AS fipar, round(pai, 5) AS pai FROM ({_steps_sql(20)}) q", "station")
def _(s: Source):
    rows = _rows(s).withColumns({"fapar": 0.05 + F.col("lai") / 5.0, "theta": F.radians("sza")})
    out = canopy.with_green_fraction(rows, "lai", "fapar", "theta")
    return out.select("id", *(rounded(c, 5).alias(c) for c in ("f_green", "fipar", "pai")))


@query(
    "c22_flags",
    "WITH v AS (SELECT event_id, CAST(ceil(value / 50) % 10 AS BIGINT) + CAST(ceil((user_id % 10) / 10e0 * 10) % 10 AS BIGINT) * 10 AS code, value FROM events) SELECT event_id, code, code % 3 = 0 AS in_domain, value BETWEEN 10 AND 200 AS in_range FROM v",
)
def _(s: Source):
    df = s.table("events").select("event_id", "value", (F.col("value") / 500).alias("b1"), ((F.col("user_id") % 10) / 10.0).cast("double").alias("b2"))
    domains = s.spark.range(0, 100, 3).toDF("code")
    return canopy.with_flags(df, ["b1", "b2"], domains, "value", 10, 200).select("event_id", "code", "in_domain", "in_range")


WEIGHTS = {"in_off": [0.0, 0.0], "in_gain": [0.004, 0.013], "w1": [[0.5, -0.3], [0.2, 0.8], [-0.7, 0.1]], "b1": [0.1, -0.2, 0.05], "w2": [0.6, -0.4, 0.3], "b2": 0.02, "out_off": 1.0, "out_gain": 2.0}


@query(
    "c23_score_network",
    "WITH x AS (SELECT event_id, value * 4e-3 - 1 AS a, user_id * 13e-3 - 1 AS b FROM events) SELECT event_id, round((6e-1 * tanh(5e-1 * a - 3e-1 * b + 1e-1) - 4e-1 * tanh(2e-1 * a + 8e-1 * b - 2e-1) + 3e-1 * tanh(-7e-1 * a + 1e-1 * b + 5e-2) + 2e-2 + 1) / 2 + 1, 6) AS scored FROM x",
)
def _(s: Source):
    schema = "in_off array<double>, in_gain array<double>, w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double, out_off double, out_gain double"
    weights = s.spark.createDataFrame([tuple(WEIGHTS.values())], schema)
    return canopy.score_network(s.table("events"), weights, ["value", "user_id"]).select("event_id", rounded("scored", 6).alias("scored"))
