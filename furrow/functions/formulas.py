"""Column sets of meteorology, radiation, canopy and surface physics.

A set is an ordered list of named SQL expressions; each may use the input columns and
the names before it. `apply` adds them to a table as one chain of projections, which
Catalyst collapses into generated code: no Python runs on rows. `as_sql` writes the
same chain as a plain nested SELECT for any other engine. Number literals are doubles
in either, and a division whose divisor can be 0 is guarded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Physical constants.
CONSTANTS = {
    "SB": 5.670373e-8,  # Stefan-Boltzmann, W/m2/K4
    "CPD": 1003.5,  # heat capacity of dry air, J/kg/K
    "CPV": 1865.0,  # heat capacity of water vapour
    "EPS": 0.622,  # ratio of molar masses, vapour to dry air
    "RD": 287.04,  # gas constant of dry air
    "GRAV": 9.8,  # gravity in surface-layer formulas
    "GRAV0": 9.80665,  # standard gravity
    "MAIR": 0.0289644,  # molar mass of air, kg/mol
    "RGAS": 8.3144598,  # gas constant
    "LAPSE": 0.0065,  # standard lapse rate, K/m
    "KARMAN": 0.41,
    "PI": 3.141592653589793,
}


def double(expr: str) -> str:
    """Constants filled in, and every number that isn't whole written as a double."""
    for name, value in CONSTANTS.items():
        expr = re.sub(rf"\b{name}\b", repr(value), expr)
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", expr)


@dataclass(frozen=True)
class FormulaSet:
    columns: dict[str, str]

    def apply(self, df: DataFrame) -> DataFrame:
        """df with all columns; those that don't use one another come in one projection, as each costs an analysis."""
        group: dict[str, str] = {}
        for name, expr in self.columns.items():
            if group.keys() & {name, *re.findall(r"[A-Za-z_]\w*", expr)}:
                df, group = df.withColumns({n: F.expr(double(e)) for n, e in group.items()}), {}
            group[name] = expr
        return df.withColumns({n: F.expr(double(e)) for n, e in group.items()})

    def as_sql(self, source: str) -> str:
        for name, expr in self.columns.items():
            source = f"SELECT *, {double(expr)} AS {name} FROM ({source})"
        return source

    def __or__(self, other: "FormulaSet") -> "FormulaSet":
        return FormulaSet({**self.columns, **other.columns})


def sets(**kw: str) -> FormulaSet:
    return FormulaSet(kw)


# Air. Inputs t_a (K), ea (mb), p (mb).
AIR = sets(
    q_air="EPS * ea / (p + (EPS - 1.0) * ea)",
    c_p="(1.0 - q_air) * CPD + q_air * CPV",
    lambda_v="1e6 * (2.501 - 2.361e-3 * (t_a - 273.15))",
    psicr="c_p * p / (EPS * lambda_v)",
    rho="p * 100.0 / (RD * t_a) * (1.0 - (1.0 - EPS) * ea / p)",
    t_c="t_a - 273.15",
    rho_w="(999.83952 + 16.945176 * t_c - 7.9870401e-3 * pow(t_c, 2.0) - 46.170461e-6 * pow(t_c, 3.0) + 105.56302e-9 * pow(t_c, 4.0) - 280.54253e-12 * pow(t_c, 5.0)) / (1.0 + 16.897850e-3 * t_c)",
    black_body="SB * pow(t_a, 4.0)",
)

PRESSURE = sets(p="1013.25 * pow(1.0 - 2.225577e-5 * elev, 5.25588)")

# Humidity, with AIR before it.
HUMIDITY = sets(
    e_sat="6.112 * exp(17.67 * t_c / (t_c + 243.5))",
    e_slope="4098.0 * 0.6108 * exp(17.27 * t_c / (t_c + 237.3)) / pow(t_c + 237.3, 2.0)",
    mixing="EPS * ea / (p - ea)",
    lapse_moist="GRAV * (RD * t_a * t_a + lambda_v * mixing * t_a) / (c_p * RD * t_a * t_a + lambda_v * lambda_v * mixing * EPS)",
)

# Sun. Inputs lat, lon, stdlon (degrees), doy, hr.
SUN = sets(
    decl="0.409 * sin(2.0 * PI * doy / 365.0 - 1.39)",
    eot="0.258 * cos(decl) - 7.416 * sin(decl) - 3.648 * cos(2.0 * decl) - 9.228 * sin(2.0 * decl)",
    hour_angle="radians((hr - (-eot / 60.0 + (stdlon - lon) / 15.0) - 12.0) * 15.0)",
    sin_elev="cos(hour_angle) * cos(decl) * cos(radians(lat)) + sin(decl) * sin(radians(lat))",
    sun_zenith="90.0 - degrees(asin(greatest(least(sin_elev, 1.0), -1.0)))",
    cos_azim="(sin(decl) * cos(radians(lat)) - cos(hour_angle) * cos(decl) * sin(radians(lat))) / nullif(cos(asin(greatest(least(sin_elev, 1.0), -1.0))), 0.0)",
    sun_azimuth="CASE WHEN hour_angle <= 0.0 THEN degrees(acos(greatest(least(cos_azim, 1.0), -1.0))) ELSE 360.0 - degrees(acos(greatest(least(cos_azim, 1.0), -1.0))) END",
)

# Zenith by solar time, just above the horizon at least. Inputs lat, doy, year, hr.
ZENITH = sets(
    kday="(year - 1977.0) * 365.0 + doy + 28123.0",
    anomaly="radians(-1.0 + 0.9856 * kday)",
    delnu="2.0 * 0.01674 * sin(anomaly) + 1.25 * 0.01674 * 0.01674 * sin(2.0 * anomaly)",
    slong="radians(-79.8280 + 0.9856479 * kday) + delnu",
    decl_s="asin(sin(radians(23.44)) * sin(slong))",
    zenith="degrees(least(acos(sin(radians(lat)) * sin(decl_s) + cos(radians(lat)) * cos(decl_s) * cos((hr - 12.0) * PI / 12.0)), PI / 2.0 - 1e-7))",
)

# C4: terrain. Inputs t2m, sp, dem, geopot, rate, blend.
TERRAIN = sets(
    rise="dem + blend - (2.0 + geopot / GRAV0)",
    t_terrain="t2m - rate * rise",
    p_ratio="(t_terrain - LAPSE * rise) / t_terrain",
    p_terrain="CASE WHEN p_ratio > 0.0 THEN sp * pow(p_ratio, GRAV0 * MAIR / (RGAS * LAPSE)) END",
)

# Wind. Inputs u100, v100; log profile from z_u to z_to over d_0, z_0m.
WIND = sets(wind="greatest(sqrt(u100 * u100 + v100 * v100), 1.0)")
LOG_WIND = sets(u_to="u * ln((z_to - d_0) / z_0m) / ln((z_u - d_0) / z_0m)")

# Vegetation proxies. Inputs ndvi; ccc, cwc, lai.
LAI_FROM_NDVI = sets(lai_ndvi="0.57 * exp(2.33 * ndvi)")
LEAF_CONTENT = sets(cab="CASE WHEN lai > 0.1 THEN ccc / lai END", cw="CASE WHEN lai > 0.1 THEN cwc / lai END")

# Leaf optics with defaults where the content is missing. Inputs cab, cw.
LEAF_OPTICS = sets(
    rho_vis="coalesce(0.05 + 0.45 * exp(-0.015 * CASE WHEN cab IS NULL THEN NULL ELSE greatest(least(cab, 200.0), 0.0) END), 0.05)",
    tau_vis="coalesce(0.05 + 0.35 * exp(-0.020 * CASE WHEN cab IS NULL THEN NULL ELSE greatest(least(cab, 200.0), 0.0) END), 0.05)",
    rho_nir="coalesce(0.40 + 0.30 * exp(-20.0 * CASE WHEN cw IS NULL THEN NULL ELSE greatest(least(cw, 0.1), 0.0) END), 0.40)",
    tau_nir="coalesce(0.30 + 0.20 * exp(-25.0 * CASE WHEN cw IS NULL THEN NULL ELSE greatest(least(cw, 0.1), 0.0) END), 0.30)",
)

# Longwave from the sky, with AIR and HUMIDITY before it. Inputs z_t, h_c.
LONGWAVE = sets(
    t_surface="t_a - lapse_moist * (h_c - z_t)",
    emis_sky="1.24 * pow(ea / t_surface, 1.0 / 7.0)",
    l_dn="emis_sky * SB * pow(t_surface, 4.0)",
)

# Angle of incidence on a slope. With SUN before it; inputs slope, aspect (degrees), acquired.
INCIDENCE = sets(
    cos_inc="cos(radians(sun_zenith)) * cos(radians(slope)) + sin(radians(sun_zenith)) * sin(radians(slope)) * cos(radians(sun_azimuth - aspect))",
    incidence="CASE WHEN acquired > 0 THEN degrees(acos(greatest(least(cos_inc, 1.0), -1.0))) END",
)

# C11: potential beams and their split. Inputs s_dn, sza, p. The pressure ratio and the
# near-infrared diffuse beam are as in the calibrated original.
DIFFUSE = sets(
    cosz="cos(radians(sza))",
    sunlit="CASE WHEN sza < 90.0 THEN 1 ELSE 0 END",
    w_abs="CASE WHEN sunlit = 1 THEN 1320.0 * pow(10.0, -1.195 + 0.4459 * log10(cosz) - 0.0345 * pow(log10(cosz), 2.0)) ELSE 0.0 END",
    dir_vis="CASE WHEN sunlit = 1 THEN greatest(1320.0 * (1.0 - 0.5455) * exp(-0.185 * (p / 1313.25) / cosz) * cosz, 0.0) ELSE 0.0 END",
    dif_vis="CASE WHEN sunlit = 1 THEN greatest(0.4 * (1320.0 * (1.0 - 0.5455) * cosz - dir_vis), 0.0) ELSE 0.0 END",
    dir_nir="CASE WHEN sunlit = 1 THEN greatest((1320.0 * 0.5455 * exp(-0.06 * (p / 1313.25) / cosz) - w_abs) * cosz, 0.0) ELSE 0.0 END",
    dif_nir="CASE WHEN sunlit = 1 THEN greatest(0.6 * (1320.0 * 0.5455 * cosz - dir_vis - w_abs), 0.0) ELSE 0.0 END",
    pot_vis="CASE WHEN dir_vis + dif_vis > 0.0 THEN dir_vis + dif_vis ELSE 1e-6 END",
    pot_nir="CASE WHEN dir_nir + dif_nir > 0.0 THEN dir_nir + dif_nir ELSE 1e-6 END",
    clear="least(s_dn / (pot_vis + pot_nir), 1.0)",
    f_vis="greatest(least(pot_vis / (pot_vis + pot_nir), 1.0), 0.0)",
    f_nir="1.0 - f_vis",
    skyl_vis="1.0 - greatest(least(dir_vis / pot_vis * (1.0 - pow((0.9 - least(clear, 0.9)) / 0.7, 0.6667)), 1.0), 0.0)",
    skyl_nir="1.0 - greatest(least(dir_nir / pot_nir * (1.0 - pow((0.88 - least(clear, 0.88)) / 0.68, 0.6667)), 1.0), 0.0)",
    skyl="skyl_vis * f_vis + skyl_nir * f_nir",
)


def extinction(theta: str, x_lad: str = "1.0") -> str:
    """Extinction coefficient of a canopy for a beam from theta (radians)."""
    return f"(sqrt({x_lad} * {x_lad} + pow(tan({theta}), 2.0)) / ({x_lad} + 1.774 * pow({x_lad} + 1.182, -0.733)))"


def diffuse_transmittance(lai: str, step: int = 5) -> str:
    """2 * sum over the sky in steps of degrees of beam transmittance times cos * sin * step."""
    terms = " + ".join(f"exp(-{extinction(f'radians({a}.0)')} * {lai}) * {_weight(a, step)!r}" for a in range(0, 90, step))
    return f"2.0 * ({terms})"


def _weight(angle: int, step: int) -> float:
    import math

    a = math.radians(angle)
    return math.cos(a) * math.sin(a) * math.radians(step)


def canopy_spectra(band: str, rho_leaf: str, tau_leaf: str, rho_soil: str, lai: str = "lai", beam: bool = True) -> FormulaSet:
    """Canopy albedo and transmittance of one band for diffuse light, and for the beam (needs k_be)."""
    out = {
        f"am_{band}": f"sqrt(1.0 - {rho_leaf} - {tau_leaf})",
        f"hc_{band}": f"(1.0 - am_{band}) / (1.0 + am_{band})",
    }
    for kind, k, depth in (("d", "k_d", lai), ("b", "k_be", "lai_eff"))[: 2 if beam else 1]:
        r, e = f"r{kind}_{band}", f"e{kind}_{band}"
        out |= {
            r: f"2.0 * {k} * hc_{band} / ({k} + 1.0)",
            e: f"exp(-am_{band} * {k} * {depth})",
            f"tau{kind}_{band}": f"({r} * {r} - 1.0) * {e} / ({r} * {rho_soil} - 1.0 + {r} * ({r} - {rho_soil}) * {e} * {e})",
            f"g{kind}_{band}": f"({r} - {rho_soil}) / ({r} * {rho_soil} - 1.0) * {e} * {e}",
            f"alb{kind}_{band}": f"({r} + g{kind}_{band}) / (1.0 + {r} * g{kind}_{band})",
        }
    return FormulaSet(out)


# Net radiation of canopy and soil. Inputs lai > 0, lai_eff, sza, s_dir, s_dif, f_vis,
# f_nir, leaf and soil spectra; longwave: t_canopy, t_soil, l_dn, emis_c, emis_s.
CANOPY_K = FormulaSet({"k_be": extinction("radians(least(sza, 89.0))"), "tau_d": diffuse_transmittance("lai"), "k_d": "-ln(tau_d) / nullif(lai, 0.0)"})
NET_SHORTWAVE = (
    CANOPY_K
    | canopy_spectra("vis", "rho_vis", "tau_vis", "soil_vis")
    | canopy_spectra("nir", "rho_nir", "tau_nir", "soil_nir")
    | sets(
        sn_c="(1.0 - taub_vis) * (1.0 - albb_vis) * s_dir * f_vis + (1.0 - taub_nir) * (1.0 - albb_nir) * s_dir * f_nir + (1.0 - taud_vis) * (1.0 - albd_vis) * s_dif * f_vis + (1.0 - taud_nir) * (1.0 - albd_nir) * s_dif * f_nir",
        sn_s="(taub_vis * s_dir + taud_vis * s_dif) * (1.0 - soil_vis) * f_vis + (taub_nir * s_dir + taud_nir * s_dif) * (1.0 - soil_nir) * f_nir",
    )
)
NET_LONGWAVE = canopy_spectra("lw", "(1.0 - emis_c)", "0.0", "(1.0 - emis_s)", beam=False) | sets(
    l_c="emis_c * SB * pow(t_canopy, 4.0)",
    l_s="emis_s * SB * pow(t_soil, 4.0)",
    ln_s="emis_s * taud_lw * l_dn + emis_s * (1.0 - taud_lw) * l_c - l_s",
    ln_c="(1.0 - albd_lw) * (1.0 - taud_lw) * (l_dn + l_s) - 2.0 * (1.0 - taud_lw) * l_c",
)

# Clumping. Inputs lai, f_c, vza, w_c; row azimuth difference psi.
CLUMPING = FormulaSet(
    {
        "k_nadir": extinction("0.0"),
        "f_local": "lai / nullif(f_c, 0.0)",
        "gap": "greatest(f_c * exp(-k_nadir * f_local) + (1.0 - f_c), 1e-36)",
        "omega0": "-ln(gap) / nullif(f_local * k_nadir, 0.0)",
        "omega": "omega0 / (omega0 + (1.0 - omega0) * exp(-2.2 * pow(radians(vza), 3.8 - 0.46 / w_c)))",
        "fc_rows": "least(f_c * (1.0 + tan(radians(vza)) * abs(sin(radians(psi))) / w_c), 1.0)",
        "k_view": extinction("radians(vza)"),
        "gap_rows": "fc_rows * exp(-k_view * f_local) + (1.0 - fc_rows)",
        "omega_rows": "CASE WHEN gap_rows > 0.0 THEN -ln(gap_rows) / nullif(f_local * k_view, 0.0) ELSE 0.0 END",
    }
)

# C14: roughness by land-cover class. Inputs lai, h_c, w_c, landcover.
# Classes: 1, 3 conifers; 2, 4, 5, 8 broadleaved, mixed, woody savanna; 6, 7 shrubs;
# 9, 10, 12, 14 savanna, grass, crop, mosaic; 0, 13, 15, 16 water, urban, snow, barren; 11 wetland.
ROUGHNESS = sets(
    cover="CASE WHEN landcover IN (1, 3, 6, 7) THEN 1.0 - exp(-0.5 * lai) WHEN landcover IN (2, 4, 5, 8) THEN 1.0 - exp(-lai) ELSE 0.0 END",
    frontal="CASE WHEN landcover IN (1, 3) THEN 2.0 / PI * cover * w_c WHEN landcover IN (2, 4, 5, 6, 7, 8) THEN cover * w_c ELSE 0.0 END",
    z0_factor="CASE WHEN frontal > 0.152 THEN 0.0537 / pow(frontal, 0.51) * (1.0 - exp(-10.9 * pow(frontal, 0.874))) + 0.00368 ELSE 5.86 * exp(-10.9 * pow(frontal, 1.12)) * pow(frontal, 1.33) + 0.00086 END",
    d_factor="CASE WHEN frontal > 0.0 THEN 1.0 - (1.0 - exp(-sqrt(15.0 * frontal))) / sqrt(15.0 * frontal) ELSE 0.65 END",
    fz="CASE WHEN lai <= 0.0 THEN 1.0 WHEN lai >= 0.8775 THEN 1.6771 * exp(-0.1717 * lai) + 1.0 ELSE 0.3299 * pow(lai, 1.5) + 2.1713 END",
    fd="CASE WHEN lai <= 0.0 THEN 1.0 ELSE 1.0 - 0.3991 * exp(-0.1779 * lai) END",
    z_0m="CASE WHEN landcover IN (0, 13, 15, 16) THEN 0.01 WHEN landcover IN (9, 10, 12, 14) THEN h_c / 8.0 ELSE z0_factor * fz * h_c END",
    d_0="CASE WHEN landcover IN (0, 13, 15, 16) THEN 0.0 WHEN landcover IN (9, 10, 12, 14) THEN 0.65 * h_c ELSE d_factor * fd * h_c END",
)


def psi_h(z: str) -> str:
    """Stability correction of heat transport for z over the Obukhov length; 0 where it is NULL (neutral)."""
    return f"(CASE WHEN {z} IS NULL THEN 0.0 WHEN {z} >= 0.0 THEN -6.1 * ln({z} + pow(1.0 + pow(greatest({z}, 0.0), 2.5), 0.4)) ELSE (1.0 - 0.057) / 0.78 * ln((0.33 + pow(greatest(-({z}), 0.0), 0.78)) / 0.33) END)"


def psi_m(z: str) -> str:
    """Stability correction of momentum transport."""
    y = f"least(greatest(-({z}), 0.0), pow(0.41, -3.0))"
    x = f"pow(greatest(-({z}), 0.0) / 0.33, 0.333333)"
    c = "0.41 * pow(0.33, 0.333333)"
    unstable = (
        f"ln(0.33 + {y}) - 3.0 * 0.41 * pow({y}, 0.333333) + {c} / 2.0 * ln(pow(1.0 + {x}, 2.0) / (1.0 - {x} + {x} * {x})) + sqrt(3.0) * {c} * atan((2.0 * {x} - 1.0) / sqrt(3.0)) - ln(0.33) + sqrt(3.0) * {c} * PI / 6.0"
    )
    return f"(CASE WHEN {z} IS NULL THEN 0.0 WHEN {z} >= 0.0 THEN -6.1 * ln({z} + pow(1.0 + pow(greatest({z}, 0.0), 2.5), 0.4)) ELSE {unstable} END)"


def psi_dyer(z: str, heat: bool) -> str:
    x = f"pow(1.0 - 16.0 * least({z}, 0.0), 0.25)"
    unstable = f"2.0 * ln((1.0 + {x} * {x}) / 2.0)" if heat else f"ln((1.0 + {x} * {x}) / 2.0) + 2.0 * ln((1.0 + {x}) / 2.0) - 2.0 * atan({x}) + PI / 2.0"
    return f"(CASE WHEN {z} IS NULL THEN 0.0 WHEN {z} >= 0.0 THEN -5.0 * ({z}) ELSE {unstable} END)"


# Stability. Inputs u, z_u, d_0, z_0m, l_mo (NULL: neutral); ustar0, t_a, rho, c_p, lambda_v, h, le; t_r0, t_r1, t_a0.
STABILITY = FormulaSet(
    {
        "zol": "(z_u - d_0) / l_mo",
        "psi_m_b": psi_m("zol"),
        "psi_h_b": psi_h("zol"),
        "psi_m_d": psi_dyer("zol", False),
        "psi_h_d": psi_dyer("zol", True),
        "zol0": "z_0m / l_mo",
        "psi_m0": psi_m("zol0"),
        "u_star": "u * KARMAN / (ln((z_u - d_0) / z_0m) - psi_m_b + psi_m0)",
        "h_virtual": "h + 0.61 * t_a * c_p * le / lambda_v",
        "obukhov": "CASE WHEN h_virtual <> 0.0 THEN -pow(u_star, 3.0) / (KARMAN * GRAV / t_a * (h_virtual / (rho * c_p))) END",
        "richardson": "-(GRAV * (z_u - d_0) / t_a) * ((t_r1 - t_r0 - (t_a - t_a0)) / (u * u))",
    }
)

# Wind in the canopy and resistances. Inputs u_star, h_c, d_0, z_0m, lai, leaf_w, l_mo, z_t, z_0h, dt.
RESISTANCES = FormulaSet(
    {
        "u_c": "ln((h_c - d_0) / z_0m) * u_star / KARMAN",
        "a_profile": "0.28 * pow(lai, 2.0 / 3.0) * pow(h_c, 1.0 / 3.0) * pow(leaf_w, -1.0 / 3.0)",
        "u_s": "u_c * exp(-a_profile * (1.0 - 0.05 / h_c))",
        "u_d": "u_c * exp(-a_profile * (1.0 - (d_0 + z_0m) / h_c))",
        "zt_l": "(z_t - d_0) / l_mo",
        "z0h_l": "z_0h / l_mo",
        "r_a": f"(ln((z_t - d_0) / z_0h) - {psi_h('zt_l')} + {psi_h('z0h_l')}) / (u_star * KARMAN)",
        "r_s_kn": "1.0 / (0.0038 * pow(greatest(dt, 0.0), 1.0 / 3.0) + 0.012 * u_s)",
        "r_s_cm": "h_c * exp(2.0) / (2.0 * KARMAN * u_star * (h_c - d_0)) * (exp(-2.0 * 0.01 / h_c) - exp(-2.0 * (d_0 + z_0m) / h_c))",
        "r_s_mv": "10.0 / u_star",
        "r_x_kn": "90.0 / nullif(lai, 0.0) * sqrt(leaf_w / u_d)",
        "r_x_cm": "1.0 / nullif(lai * (2.0 * 0.01 / 3.0) * sqrt(u_c / leaf_w) * (1.0 - exp(-1.5)), 0.0)",
        "r_x_mv": "130.0 / nullif(lai, 0.0) * sqrt(leaf_w * u_star) + 0.36 / u_star",
    }
)

# C17: soil heat flux from net radiation of the soil and decimal hour.
SOIL_HEAT = sets(
    g_constant="50.0",
    g_ratio="0.35 * rn_s",
    g_cosine="rn_s * 0.35 * cos(2.0 * PI * (hr - 12.0 + 3.0) / 24.0)",
    g_sigmoid="rn_s * 0.35 * 0.5 * (tanh(hr - 10.0) - tanh(hr - 14.0))",
)

# Daily ET in mm from an instantaneous latent flux. Inputs s_mean, le, s_inst, lambda_v, rho_w.
DAILY_ET = sets(le_daily="s_mean * le / nullif(s_inst, 0.0)", et_daily="le_daily / (rho_w * lambda_v) * 1e3 * 24.0 * 3600.0")

# Reference ET, with AIR and HUMIDITY before it. Inputs u, s_dn, z_u, z_t, doy, lat, elev.
CLEAR_SKY = sets(
    decl_r="0.409 * sin(2.0 * PI * doy / 365.0 - 1.39)",
    sunset="acos(greatest(least(-tan(radians(lat)) * tan(decl_r), 1.0), -1.0))",
    s_extra="1367.0 / PI * (1.0 + 0.033 * cos(2.0 * PI * doy / 365.0)) * (sunset * sin(radians(lat)) * sin(decl_r) + cos(radians(lat)) * cos(decl_r) * sin(sunset))",
    s_clear="(0.75 + 2e-5 * elev) * s_extra",
    cloud="greatest(least(1.35 * s_dn / nullif(s_clear, 0.0) - 0.35, 1.0), 0.05)",
    ln_out="SB * cloud * (0.34 - 0.14 * sqrt(ea * 0.1)) * pow(t_a, 4.0)",
)
REFERENCE_ET = (
    CLEAR_SKY
    | sets(
        delta="10.0 * e_slope",
        rn_ref="s_dn * 0.77 - ln_out",
        d_fao="0.12 * 2.0 / 3.0",
        z0_fao="0.12 * 0.123",
        us_fao="u * KARMAN / ln((z_u - d_fao) / z0_fao)",
        ra_fao="ln((z_t - d_fao) / (0.1 * z0_fao)) / (us_fao * KARMAN)",
        le_fao="(delta * rn_ref + rho * c_p * (e_sat - ea) / ra_fao) / (delta + psicr * (1.0 + 70.0 / ra_fao))",
        u2_tall="u * ln((2.0 - 0.5 * 0.67) / (0.5 * 0.123)) / ln((z_u - 0.5 * 0.67) / (0.5 * 0.123))",
        le_tall="(delta * rn_ref + psicr * 66.0 * u2_tall * (e_sat - ea) / t_a) / (delta + psicr * 0.25 * u2_tall)",
        u2_short="u * ln((2.0 - 0.12 * 0.67) / (0.12 * 0.123)) / ln((z_u - 0.12 * 0.67) / (0.12 * 0.123))",
        le_short="(delta * rn_ref + psicr * 37.0 * u2_short * (e_sat - ea) / t_a) / (delta + psicr * 0.24 * u2_short)",
    )
)

# C20: irradiance on a slope: clearness split (Erbs) and isotropic sky, ground albedo 0.25.
# Inputs s_dn, sza, saa, slope, aspect, doy.
TILTED = sets(
    cos_z="greatest(cos(radians(sza)), 0.065)",
    s_top="1366.1 * (1.00011 + 0.034221 * cos(2.0 * PI * (doy - 1.0) / 365.0) + 0.00128 * sin(2.0 * PI * (doy - 1.0) / 365.0) + 0.000719 * cos(4.0 * PI * (doy - 1.0) / 365.0) + 0.000077 * sin(4.0 * PI * (doy - 1.0) / 365.0))",
    kt="greatest(least(s_dn / (s_top * cos_z), 1.0), 0.0)",
    df="CASE WHEN kt <= 0.22 THEN 1.0 - 0.09 * kt WHEN kt <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * pow(kt, 3.0) + 12.336 * pow(kt, 4.0) ELSE 0.165 END",
    dhi="df * s_dn",
    dni="CASE WHEN sza > 87.0 THEN 0.0 ELSE (s_dn - dhi) / cos(radians(sza)) END",
    cos_tilt="cos(radians(sza)) * cos(radians(slope)) + sin(radians(sza)) * sin(radians(slope)) * cos(radians(saa - aspect))",
    poa="dni * greatest(cos_tilt, 0.0) + dhi * (1.0 + cos(radians(slope))) / 2.0 + s_dn * 0.25 * (1.0 - cos(radians(slope))) / 2.0",
)

# Component temperatures. Inputs t_r, t_canopy, t_soil, lai, omega, vza; 255 flags an impossible mix.
COMPONENT_T = FormulaSet(
    {
        "f_theta": f"1.0 - exp(-{extinction('radians(vza)')} * omega * lai)",
        "ts4": "pow(t_r, 4.0) - f_theta * pow(t_canopy, 4.0)",
        "t_s": "CASE WHEN ts4 >= 0.0 AND f_theta < 1.0 THEN pow(ts4 / (1.0 - f_theta), 0.25) ELSE 1e-6 END",
        "tc4": "pow(t_r, 4.0) - (1.0 - f_theta) * pow(t_soil, 4.0)",
        "t_cnp": "CASE WHEN tc4 >= 0.0 AND f_theta > 0.0 THEN pow(tc4 / f_theta, 0.25) ELSE 1e-6 END",
        "flag_t": "CASE WHEN ts4 >= 0.0 AND tc4 >= 0.0 THEN 0 ELSE 255 END",
    }
)

# Component temperatures from two views, NULL where either fourth power isn't positive.
TWO_VIEWS = FormulaSet(
    {
        "f_near": f"1.0 - exp(-{extinction('radians(vza_near)')} * lai)",
        "f_far": f"1.0 - exp(-{extinction('radians(vza_far)')} * lai)",
        "soil4": "(f_far * pow(t_near, 4.0) - f_near * pow(t_far, 4.0)) / nullif(f_far - f_near, 0.0)",
        "leaf4": "(pow(t_near, 4.0) - (1.0 - f_near) * soil4) / nullif(f_near, 0.0)",
        "t_soil2": "CASE WHEN soil4 > 0.0 AND leaf4 > 0.0 THEN pow(greatest(soil4, 0.0), 0.25) END",
        "t_leaf2": "CASE WHEN soil4 > 0.0 AND leaf4 > 0.0 THEN pow(greatest(leaf4, 0.0), 0.25) END",
    }
)

# Bowen-ratio closure outside (-1.3, -0.7). Inputs rn, g, h, le. Where le is 0 the
# ratio has no end and all energy is sensible heat; no fluxes at all have no ratio: NaN.
BOWEN = sets(
    bowen="h / nullif(le, 0.0)",
    le_closed="CASE WHEN bowen > -1.3 AND bowen < -0.7 THEN le WHEN le = 0.0 AND h = 0.0 THEN (rn - g) * CAST('NaN' AS DOUBLE) WHEN le = 0.0 THEN (rn - g) * h * 0.0 ELSE (rn - g) / (1.0 + bowen) END",
    h_closed="CASE WHEN bowen > -1.3 AND bowen < -0.7 THEN h ELSE rn - g - le_closed END",
)
