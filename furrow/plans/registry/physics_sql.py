"""SQL twins of the column-set queries, written from the published equations.

Nothing here is generated from `functions.formulas`: constants are spelled again,
equations are in other forms, spectra and sky angles are rows or lists instead of
unrolled columns. `s` is the table of station rows. Each entry gives the columns that its
query shows.
"""

from __future__ import annotations

_PRESSURE = "1013.25 * pow(1 - 2.225577e-5 * elev, 5.25588)"
#: Air of a row: pressure, humidity by mass, heat capacity, latent heat, density, psychrometric constant.
_AIR = f"""a0 AS (SELECT *, {_PRESSURE} AS p, t_a - 273.15 AS t FROM s),
a1 AS (SELECT *, 0.622 * ea / (p - 0.378 * ea) AS q, 2501000 - 2361 * t AS lv FROM a0),
air AS (SELECT *, 1003.5 + 861.5 * q AS cp, 100 * (p - 0.378 * ea) / (287.04 * t_a) AS density FROM a1)"""
_WATER = "(999.83952 + t * (16.945176 + t * (-7.9870401e-3 + t * (-46.170461e-6 + t * (105.56302e-9 - 280.54253e-12 * t))))) / (1 + 16.897850e-3 * t)"
_SUN = """g0 AS (SELECT *, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS dec, radians(lat) AS phi FROM s),
g1 AS (SELECT *, radians(15 * (hr - 12) + (0.258 * cos(dec) - 7.416 * sin(dec) - 3.648 * cos(2 * dec) - 9.228 * sin(2 * dec)) / 4 - (stdlon - lon)) AS w FROM g0),
g2 AS (SELECT *, acos(greatest(-1, least(1, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(w)))) AS zen FROM g1),
sun AS (SELECT *, acos(greatest(-1, least(1, (sin(dec) * cos(phi) - cos(w) * cos(dec) * sin(phi)) / nullif(sin(zen), 0)))) AS half FROM g2)"""
_AZIMUTH = "CASE WHEN w > 0 THEN 2 * pi() - half ELSE half END"
#: Potential beams (Weiss and Norman), their split, and the diffuse shares.
_BEAMS = f"""b0 AS (SELECT *, {_PRESSURE} AS p, cos(radians(sza)) AS mu FROM s),
b1 AS (SELECT *, 1320 * pow(10, -1.195 + 0.4459 * log10(mu) - 0.0345 * log10(mu) * log10(mu)) AS vapour, greatest(0, 599.94 * mu * exp(-0.185 * p / 1313.25 / mu)) AS bv FROM b0),
b2 AS (SELECT *, greatest(0, 0.4 * (599.94 * mu - bv)) AS dv, greatest(0, mu * (720.06 * exp(-0.06 * p / 1313.25 / mu) - vapour)) AS bn, greatest(0, 0.6 * (720.06 * mu - bv - vapour)) AS dn FROM b1),
b3 AS (SELECT *, greatest(bv + dv, 1e-6) AS pv, greatest(bn + dn, 1e-6) AS pn FROM b2),
b4 AS (SELECT *, least(1, s_dn / (pv + pn)) AS clear, pv / (pv + pn) AS fv FROM b3),
b5 AS (SELECT *, 1 - greatest(0, least(1, bv / pv * (1 - pow((0.9 - least(0.9, clear)) / 0.7, 0.6667)))) AS kv, 1 - greatest(0, least(1, bn / pn * (1 - pow((0.88 - least(0.88, clear)) / 0.68, 0.6667)))) AS kn FROM b4),
beams AS (SELECT *, kv * fv + kn * (1 - fv) AS sky FROM b5)"""
#: 1 + 1.774 * 2.182 ** -0.733 normalises the extinction of a spherical canopy.
_SPHERE = "(1 + 1.774 * pow(2.182, -0.733))"


def _extinction(theta: str) -> str:
    """Of a spherical canopy: sqrt(1 + tan^2) is the secant."""
    return f"(1 / cos({theta}) / {_SPHERE})"


_DIFFUSE_K = f"2 * list_sum(list_transform(range(0, 90, 5), lambda d: exp(-lai * {_extinction('radians(d)')}) * sin(radians(2 * d)) / 2 * pi() / 36))"


def _layer(k: str, depth: str, root: str, ground: str) -> tuple[str, str]:
    """Transmittance and albedo of a canopy layer over a ground (Campbell and Norman, chapter 15)."""
    r = f"(2 * {k} / ({k} + 1) * (1 - {root}) / (1 + {root}))"
    e = f"exp(-{root} * {k} * {depth})"
    back = f"(({r} - {ground}) / ({r} * {ground} - 1) * {e} * {e})"
    return f"({r} * {r} - 1) * {e} / ({r} * {ground} - 1 + {r} * ({r} - {ground}) * {e} * {e})", f"({r} + {back}) / (1 + {r} * {back})"


def _monin(z: str, stable: str, unstable: str) -> str:
    return f"CASE WHEN {z} IS NULL THEN 0 WHEN {z} < 0 THEN {unstable} ELSE {stable} END"


_STABLE = "-6.1 * ln({z} + pow(1 + pow(abs({z}), 2.5), 1 / 2.5))"


def _psi_heat(z: str) -> str:
    return _monin(z, _STABLE.format(z=z), f"0.943 / 0.78 * ln(1 + pow(abs({z}), 0.78) / 0.33)")


def _psi_momentum(z: str) -> str:
    y, third, x = f"least(abs({z}), 1 / (0.41 * 0.41 * 0.41))", "pow(0.33, 0.333333)", f"pow(abs({z}) / 0.33, 0.333333)"
    unstable = (
        f"ln((0.33 + {y}) / 0.33) - 1.23 * pow({y}, 0.333333) + 0.205 * {third} * ln((1 + {x}) * (1 + {x}) / (1 - {x} + {x} * {x})) "
        f"+ sqrt(3) * 0.41 * {third} * (atan((2 * {x} - 1) / sqrt(3)) + pi() / 6)"
    )
    return _monin(z, _STABLE.format(z=z), unstable)


def _shown(columns: dict[str, str], digits: int, source: str) -> str:
    return f"SELECT id, {', '.join(f'round(CAST({e} AS DOUBLE), {digits}) AS {c}' for c, e in columns.items())} FROM {source}"


TWINS: dict[str, str] = {
    "c1_air": f"{_AIR} " + _shown({"p": "p", "c_p": "cp", "lambda_v": "lv", "psicr": "cp * p / (0.622 * lv)", "rho": "density", "rho_w": _WATER, "black_body": "5.670373e-8 * t_a * t_a * t_a * t_a"}, 6, "air"),
    "c2_humidity": f"{_AIR}, m AS (SELECT *, 0.622 * ea / (p - ea) AS r FROM air) "
    + _shown({"e_sat": "6.112 * exp(17.67 * t / (t + 243.5))", "e_slope": "2503.0584 * exp(17.27 * t / (t + 237.3)) / ((t + 237.3) * (t + 237.3))", "mixing": "r", "lapse_moist": "9.8 * (1 + lv * r / (287.04 * t_a)) / (cp + lv * lv * r * 0.622 / (287.04 * t_a * t_a))"}, 6, "m"),
    "c3_sun": f"{_SUN} " + _shown({"decl": "dec", "sun_zenith": "degrees(zen)", "sun_azimuth": f"degrees({_AZIMUTH})"}, 5, "sun"),
    "c3_zenith": """z0 AS (SELECT *, 365 * (year - 1977) + doy + 28123 AS k FROM s),
z1 AS (SELECT *, radians(0.9856 * k - 1) AS m FROM z0),
z2 AS (SELECT *, asin(sin(radians(23.44)) * sin(radians(0.9856479 * k - 79.828) + 0.01674 * (2 * sin(m) + 1.25 * 0.01674 * sin(2 * m)))) AS dec FROM z1) """
    + _shown({"zenith": "degrees(least(pi() / 2 - 1e-7, acos(cos(radians(lat)) * cos(dec) * cos(radians(15 * hr - 180)) + sin(radians(lat)) * sin(dec))))"}, 5, "z2"),
    "c4_terrain": "h AS (SELECT *, elev + 98 - elev * 9 / 9.80665 AS up FROM s), t AS (SELECT *, t_a - 0.0098 * up AS warm FROM h) "
    + _shown({"t_terrain": "warm", "p_terrain": "CASE WHEN warm > 0.0065 * up THEN 1013.25 * exp(ln(1 - 0.0065 * up / warm) * (9.80665 * 0.0289644 / 8.3144598 / 0.0065)) END"}, 6, "t"),
    "c5_wind": _shown({"wind": "greatest(1, sqrt(pow(u - 3, 2) + pow(u, 2) / 4))", "u_to": "u * (ln(2 - 0.65 * h_c) - ln(h_c / 8)) / (ln(z_u - 0.65 * h_c) - ln(h_c / 8))"}, 6, "s"),
    "c6_vegetation": _shown({"lai_ndvi": "0.57 * exp(2.33 * lai / 5 - 0.233)", "cab": "CASE WHEN lai > 0.1 THEN 40 + 1 / lai END", "cw": "CASE WHEN lai > 0.1 THEN 0.01 END"}, 6, "s"),
    "c8_leaf_optics": "o AS (SELECT *, greatest(0, least(200, 250 - 60 * lai)) AS green, greatest(0, least(0.1, lai / 30)) AS water FROM s) "
    + _shown({"rho_vis": "CASE WHEN lai > 0.1 THEN 0.05 + 0.45 / exp(0.015 * green) ELSE 0.05 END", "tau_vis": "CASE WHEN lai > 0.1 THEN 0.05 + 0.35 / exp(0.02 * green) ELSE 0.05 END", "rho_nir": "CASE WHEN lai > 0.1 THEN 0.4 + 0.3 / exp(20 * water) ELSE 0.4 END", "tau_nir": "CASE WHEN lai > 0.1 THEN 0.3 + 0.2 / exp(25 * water) ELSE 0.3 END"}, 6, "o"),
    "c9_longwave": f"{_AIR}, m AS (SELECT *, 0.622 * ea / (p - ea) AS r FROM air), n AS (SELECT *, t_a + (z_t - h_c) * 9.8 * (1 + lv * r / (287.04 * t_a)) / (cp + lv * lv * r * 0.622 / (287.04 * t_a * t_a)) AS low FROM m) "
    + _shown({"t_surface": "low", "emis_sky": "1.24 * exp(ln(ea / low) / 7)", "l_dn": "1.24 * exp(ln(ea / low) / 7) * 5.670373e-8 * pow(low, 4)"}, 5, "n"),
    # the angle between two unit vectors: sun and slope normal (east, north, up)
    "c10_incidence": f"{_SUN}, v AS (SELECT *, {_AZIMUTH} AS az, radians(slope) AS sl, radians(aspect) AS asp FROM sun) "
    + _shown({"incidence": "CASE WHEN id % 9 <> 0 THEN degrees(acos(greatest(-1, least(1, sin(zen) * sin(az) * sin(sl) * sin(asp) + sin(zen) * cos(az) * sin(sl) * cos(asp) + cos(zen) * cos(sl))))) END"}, 4, "v"),
    "c11_diffuse": f"{_BEAMS} " + _shown({"dir_vis": "bv", "dif_vis": "dv", "dir_nir": "bn", "dif_nir": "dn", "f_vis": "fv", "skyl_vis": "kv", "skyl_nir": "kn", "skyl": "sky"}, 6, "beams"),
    # one row a band
    "c12_net_shortwave": f"""{_BEAMS}, k AS (SELECT *, {_DIFFUSE_K} AS td, {_extinction("radians(least(sza, 89))")} AS kb FROM beams),
n AS (SELECT *, -ln(td) / nullif(lai, 0) AS kd FROM k),
bands AS (SELECT n.*, CASE WHEN name = 'vis' THEN fv ELSE 1 - fv END AS share, sqrt(1 - leaf) AS root, ground FROM n, (VALUES ('vis', 0.15, 0.15), ('nir', 0.65, 0.25)) AS b(name, leaf, ground)),
layers AS (SELECT id, kb, td, share, ground, s_dn * (1 - sky) * share AS direct, s_dn * sky * share AS diffuse, {", ".join(f"{e} AS {c}" for c, e in zip(("tb", "ab", "tf", "af"), (*_layer("kb", "(0.9 * lai)", "root", "ground"), *_layer("kd", "lai", "root", "ground"))))} FROM bands),
sums AS (SELECT id, min(kb) AS kb, min(td) AS td, sum((1 - tb) * (1 - ab) * direct + (1 - tf) * (1 - af) * diffuse) AS canopy, sum((1 - ground) * (tb * direct + tf * diffuse)) AS soil FROM layers GROUP BY id) """
    + _shown({"k_be": "kb", "tau_d": "td", "sn_c": "canopy", "sn_s": "soil"}, 5, "sums"),
    "c12_net_longwave": f"""k AS (SELECT *, -ln({_DIFFUSE_K}) / nullif(lai, 0) AS kd, 0.98 * 5.670373e-8 * pow(t_a, 4) AS leaves, 0.95 * 5.670373e-8 * pow(t_r, 4) AS floor_ FROM s),
l AS (SELECT *, {_layer("kd", "lai", "sqrt(0.98)", "0.05")[0]} AS through, {_layer("kd", "lai", "sqrt(0.98)", "0.05")[1]} AS albedo FROM k) """
    + _shown({"ln_c": "(1 - through) * ((1 - albedo) * (330 + floor_) - 2 * leaves)", "ln_s": "0.95 * (330 * through + leaves * (1 - through)) - floor_"}, 5, "l"),
    "c13_clumping": f"""c0 AS (SELECT *, nullif(lai, 0) / f_c AS dense, 1 / {_SPHERE} AS k0, {_extinction("radians(vza)")} AS kv, least(1, f_c + f_c * tan(radians(vza)) * abs(sin(radians(psi)))) AS wide FROM s),
c1 AS (SELECT *, -ln(greatest(1e-36, 1 - f_c * (1 - exp(-k0 * dense)))) / (dense * k0) AS zero FROM c0) """
    + _shown({"omega0": "zero", "omega": "1 / (1 + (1 / zero - 1) * exp(-2.2 * pow(radians(vza), 3.34)))", "omega_rows": "-ln(1 - wide * (1 - exp(-kv * dense))) / (dense * kv)"}, 6, "c1"),
    # classes as a table: their cover and frontal area per cover
    "c14_roughness": """kinds(landcover, rate, front, fixed_z, fixed_d) AS (VALUES (0, 0, 0, 0.01, NULL), (1, 0.5, 2 / pi(), NULL, NULL), (2, 1, 1, NULL, NULL), (3, 0.5, 2 / pi(), NULL, NULL), (4, 1, 1, NULL, NULL), (5, 1, 1, NULL, NULL), (6, 0.5, 1, NULL, NULL), (7, 0.5, 1, NULL, NULL), (8, 1, 1, NULL, NULL), (9, 0, 0, NULL, 0.65), (10, 0, 0, NULL, 0.65), (11, 0, 0, NULL, NULL), (12, 0, 0, NULL, 0.65), (13, 0, 0, 0.01, NULL), (14, 0, 0, NULL, 0.65), (15, 0, 0, 0.01, NULL), (16, 0, 0, 0.01, NULL)),
r0 AS (SELECT s.*, fixed_z, fixed_d, front * w_c * (1 - exp(-rate * lai)) AS lam FROM s JOIN kinds USING (landcover)),
r1 AS (SELECT *, CASE WHEN lam > 0.152 THEN 0.00368 + 0.0537 * pow(lam, -0.51) * (1 - exp(-10.9 * pow(lam, 0.874))) ELSE 0.00086 + 5.86 * pow(lam, 1.33) * exp(-10.9 * pow(lam, 1.12)) END AS zf, CASE WHEN lam > 0 THEN 1 - (1 - exp(-sqrt(15 * lam))) / sqrt(15 * lam) ELSE 0.65 END AS df,
CASE WHEN lai <= 0 THEN 1 WHEN lai < 0.8775 THEN 2.1713 + 0.3299 * lai * sqrt(lai) ELSE 1 + 1.6771 / exp(0.1717 * lai) END AS fz, CASE WHEN lai <= 0 THEN 1 ELSE 1 - 0.3991 / exp(0.1779 * lai) END AS fd FROM r0) """
    + _shown({"z_0m": "CASE WHEN fixed_z IS NOT NULL THEN fixed_z WHEN fixed_d IS NOT NULL THEN h_c / 8 ELSE h_c * zf * fz END", "d_0": "CASE WHEN fixed_z IS NOT NULL THEN 0 WHEN fixed_d IS NOT NULL THEN h_c * fixed_d ELSE h_c * df * fd END"}, 6, "r1"),
    "c15_resistances": f"""v0 AS (SELECT *, h_c / 8 AS z0, CASE id % 3 WHEN 0 THEN -30 WHEN 1 THEN 50 END AS l FROM s),
v1 AS (SELECT *, greatest(0.01, 0.41 * u / ln((z_u - 0.65 * h_c) / z0)) AS us, 0.28 * pow(lai * lai * h_c / leaf_w, 1.0 / 3) AS decay, (z_t - 0.65 * h_c) / l AS zt, z0 / l AS zh FROM v0),
v2 AS (SELECT *, us / 0.41 * ln(2.8) AS top FROM v1),
v3 AS (SELECT *, top * exp(decay * (0.05 / h_c - 1)) AS low, top * exp(-0.225 * decay) AS mid FROM v2) """
    + _shown(
        {
            "u_c": "top", "u_s": "low", "u_d": "mid",
            "r_a": f"(ln((z_t - 0.65 * h_c) / z0) - ({_psi_heat('zt')}) + ({_psi_heat('zh')})) / us / 0.41",
            "r_s_kn": "1 / (0.012 * low + 0.0038 * pow(greatest(0, t_r - t_a), 1.0 / 3))",
            "r_s_cm": "(exp(2 - 0.02 / h_c) - exp(2 - 2 * 0.775)) / (0.82 * 0.35 * us)",
            "r_s_mv": "10 / us", "r_x_kn": "90 * sqrt(leaf_w / mid) / nullif(lai, 0)",
            "r_x_cm": "150 / (nullif(lai, 0) * (1 - exp(-1.5))) * sqrt(leaf_w / top)", "r_x_mv": "(130 * sqrt(leaf_w * us)) / nullif(lai, 0) + 0.36 / us",
        },
        5,
        "v3",
    ),
    "c16_stability": f"""{_AIR}, y0 AS (SELECT *, CASE id % 3 WHEN 0 THEN -30 WHEN 1 THEN 50 END AS l FROM air),
y1 AS (SELECT *, (z_u - 0.65 * h_c) / l AS zl, h_c / 8 / l AS z0l FROM y0),
y2 AS (SELECT *, {_psi_momentum("zl")} AS pm, {_psi_heat("zl")} AS ph, {_psi_momentum("z0l")} AS pm0, pow(1 + 16 * greatest(0, -zl), 0.25) AS x FROM y1),
y3 AS (SELECT *, 0.41 * u / (ln(8 * (z_u / h_c - 0.65)) - pm + pm0) AS us, t_r - t_a + 0.61 * t_a * cp * s_dn / 4 / lv AS hv FROM y2) """
    + _shown(
        {
            "psi_m_b": "pm", "psi_h_b": "ph",
            "psi_m_d": "CASE WHEN zl IS NULL THEN 0 WHEN zl < 0 THEN ln((1 + x * x) * (1 + x) * (1 + x) / 8) - 2 * atan(x) + pi() / 2 ELSE -5 * zl END",
            "psi_h_d": "CASE WHEN zl IS NULL THEN 0 WHEN zl < 0 THEN ln((1 + x * x) * (1 + x * x) / 4) ELSE -5 * zl END",
            "u_star": "us", "obukhov": "-us * us * us * t_a * density * cp / (0.41 * 9.8 * nullif(hv, 0))",
            "richardson": "9.8 * (z_u - 0.65 * h_c) / t_a * -3 / (u * u)",
        },
        5,
        "y3",
    ),
    "c17_soil_heat": "n AS (SELECT *, 0.4 * s_dn AS net FROM s) "
    + _shown({"g_constant": "50", "g_ratio": "0.35 * net", "g_cosine": "0.35 * net * cos(radians(15 * hr - 135))", "g_sigmoid": "0.35 * net / 2 * ((exp(2 * (hr - 10)) - 1) / (exp(2 * (hr - 10)) + 1) - (exp(2 * (hr - 14)) - 1) / (exp(2 * (hr - 14)) + 1))"}, 6, "n"),
    "c18_daily_et": f"{_AIR}, e AS (SELECT *, s_dn / 3 / nullif(s_dn, 0) * s_dn / 2.5 AS day FROM air) " + _shown({"le_daily": "day", "et_daily": f"86400000 * day / (({_WATER}) * lv)"}, 6, "e"),
    # FAO-56 and ASCE: grass of 0.12 m, tall crop of 0.5 m
    "c19_reference_et": f"""{_AIR}, f0 AS (SELECT *, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS dec, radians(lat) AS phi, 10 * 2503.0584 * exp(17.27 * t / (t + 237.3)) / pow(t + 237.3, 2) AS slope_mb, 6.112 * exp(17.67 * t / (t + 243.5)) - ea AS vpd, cp * p / (0.622 * lv) AS psy FROM air),
f1 AS (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(dec)))) AS set_ FROM f0),
f2 AS (SELECT *, (0.75 + elev / 50000) * 1367 / pi() * (1 + 0.033 * cos(2 * pi() / 365 * doy)) * (set_ * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(set_)) AS cs FROM f1),
f3 AS (SELECT *, greatest(0.05, least(1, 1.35 * s_dn / cs - 0.35)) AS fcd FROM f2),
f4 AS (SELECT *, 5.670373e-8 * pow(t_a, 4) * fcd * (0.34 - 0.14 * sqrt(ea / 10)) AS out_ FROM f3),
f5 AS (SELECT *, 0.77 * s_dn - out_ AS net, ln((z_t - 0.08) / 0.001476) * ln((z_u - 0.08) / 0.01476) / (0.41 * 0.41 * u) AS ra, u * ln(1.665 / 0.0615) / ln((z_u - 0.335) / 0.0615) AS ut, u * ln(1.9196 / 0.01476) / ln((z_u - 0.0804) / 0.01476) AS ug FROM f4) """
    + _shown(
        {
            "s_clear": "cs", "cloud": "fcd", "ln_out": "out_",
            "le_fao": "(slope_mb * net + density * cp * vpd / ra) / (slope_mb + psy + 70 * psy / ra)",
            "le_tall": "(slope_mb * net + 66 * psy * ut * vpd / t_a) / (slope_mb + 0.25 * psy * ut)",
            "le_short": "(slope_mb * net + 37 * psy * ug * vpd / t_a) / (slope_mb + 0.24 * psy * ug)",
        },
        5,
        "f5",
    ),
    # Erbs' diffuse share of the clearness index; the sky is isotropic
    "c20_tilted": """q0 AS (SELECT *, cos(radians(sza)) AS mu, 2 * pi() * (doy - 1) / 365 AS b, radians(slope) AS sl FROM s),
q1 AS (SELECT *, 1366.1 * (1.00011 + 0.034221 * cos(b) + 0.00128 * sin(b) + 0.000719 * cos(2 * b) + 0.000077 * sin(2 * b)) AS top FROM q0),
q2 AS (SELECT *, greatest(0, least(1, s_dn / (top * greatest(mu, 0.065)))) AS k FROM q1),
q3 AS (SELECT *, s_dn * CASE WHEN k > 0.8 THEN 0.165 WHEN k > 0.22 THEN 0.9511 + k * (-0.1604 + k * (4.388 + k * (-16.638 + 12.336 * k))) ELSE 1 - 0.09 * k END AS dif FROM q2),
q4 AS (SELECT *, CASE WHEN sza > 87 THEN 0 ELSE (s_dn - dif) / mu END AS beam FROM q3) """
    + _shown({"kt": "k", "dhi": "dif", "dni": "beam", "poa": "beam * greatest(0, mu * cos(sl) + sin(radians(sza)) * sin(sl) * cos(radians(saa) - radians(aspect))) + dif * pow(cos(sl / 2), 2) + 0.25 * s_dn * pow(sin(sl / 2), 2)"}, 5, "q4"),
    "c21_component_t": f"""w0 AS (SELECT *, 1 - exp(-0.8 * lai * {_extinction("radians(vza)")}) AS f, t_r * t_r * t_r * t_r AS r4 FROM s),
w1 AS (SELECT *, r4 - f * t_a * t_a * t_a * t_a AS soil, r4 - (1 - f) * pow(t_r + 6, 4) AS leaf FROM w0) """
    + _shown({"f_theta": "f", "t_s": "CASE WHEN soil >= 0 AND f < 1 THEN sqrt(sqrt(soil / (1 - f))) ELSE 1e-6 END", "t_cnp": "CASE WHEN leaf >= 0 AND f > 0 THEN sqrt(sqrt(leaf / f)) ELSE 1e-6 END", "flag_t": "CASE WHEN soil < 0 OR leaf < 0 THEN 255 ELSE 0 END"}, 5, "w1"),
    # the two views as two linear equations in the fourth powers, by Cramer's rule
    "j13_component_temps": f"""x0 AS (SELECT *, 1 - exp(-lai * {_extinction("radians(vza / 9)")}) AS a, 1 - exp(-lai * {_extinction("radians(40 + vza / 9)")}) AS b, pow(t_r, 4) AS n4, pow(t_r - 1, 4) AS f4 FROM s),
x1 AS (SELECT *, (a * f4 - b * n4) / nullif(a - b, 0) AS soil, ((1 - b) * n4 - (1 - a) * f4) / nullif(a - b, 0) AS leaf FROM x0) """
    + _shown({"t_soil2": "CASE WHEN soil > 0 AND leaf > 0 THEN sqrt(sqrt(soil)) END", "t_leaf2": "CASE WHEN soil > 0 AND leaf > 0 THEN sqrt(sqrt(leaf)) END"}, 3, "x1"),
    "a23_bowen": "z AS (SELECT id, 0.54 * s_dn AS have, 15 * (t_r - t_a) AS h, s_dn / 4 - 40 AS le FROM s), y AS (SELECT *, h / nullif(le, 0) AS ratio FROM z) "
    + _shown({"le_closed": "CASE WHEN ratio > -1.3 AND ratio < -0.7 THEN le ELSE have / (1 + h / le) END", "h_closed": "CASE WHEN ratio > -1.3 AND ratio < -0.7 THEN h ELSE have * h / (le + h) END"}, 5, "y"),
}
