"""Surface energy balance of station or pixel rows: one-source for bare rows, two-source for the others.

Inputs with a closed form and the iteration over the Obukhov length run in Python, on Arrow
batches, vectorised over the batch. Each row stops by itself, so a result does not depend
on how rows are batched or partitioned.

Some rows wander before they settle, and enlarge the last bit of any input to whole
digits. So every operation comes in the order of the published balance (and of its SQL),
and functions are those of the C library, which engines share: expressions of Spark round
some powers, sines and logarithms the other way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import formulas as f
from furrow.functions.formulas import CONSTANTS as K
from furrow.operators.masks import split_vegetation
from furrow.operators.temporal import with_defaults

# Limits and flags of the balance.
MAX_STEPS = 15
TOLERANCE = 1e-3
LEAST_WIND, LEAST_RESISTANCE = 0.01, 0.1
FLAG_ALL, FLAG_NO_SOIL_LE, FLAG_NO_LE, FLAG_BARE, FLAG_BARE_NO_LE, FLAG_INVALID = 0, 3, 5, 10, 15, 255

#: What inputs() reads; p, sza and l_dn may be NaN and are then derived.
RAW = ["t_r", "t_a", "u", "ea", "s_dn", "lai", "h_c", "vza", "doy", "hr", "p", "sza", "l_dn", "elev", "lat", "lon", "stdlon", "f_c", "f_g", "w_c", "z_u", "z_t", "leaf_w", "x_lad", "alpha", "g_ratio", "emis_c", "emis_s", "rho_vis", "tau_vis", "rho_nir", "tau_nir", "soil_vis", "soil_nir", "z_0m", "d_0", "bare"]
INPUTS = ["t_r", "t_a", "u", "ea", "p", "rho", "c_p", "lambda_v", "psicr", "e_slope", "l_dn", "sn_c", "sn_s", "lai", "f_local", "f_theta", "f_g", "h_c", "emis_c", "emis_s", "z_0m", "d_0", "z_u", "z_t", "leaf_w", "x_lad", "alpha", "g_ratio", "tau_lw", "alb_lw", "bare"]
OUTPUTS = ["flag", "sn_c", "sn_s", "t_s", "t_c", "t_ac", "ln_s", "ln_c", "le_c", "hf_c", "le_s", "hf_s", "g", "r_s", "r_x", "r_a", "u_star", "obukhov", "steps"]


def _library(names: Sequence[str] = ("exp", "log", "log10", "sin", "cos", "tan", "atan", "acos", "pow"), check: bool = True) -> SimpleNamespace:
    """Functions of the C library on arrays: numpy's where a check finds the same bits, else the library's value by value.

    Where vectors are wide, numpy has functions of its own that round some values the other way.
    """
    found, x = {}, np.linspace(0.001, 1, 4096)
    for name in names:
        two = name == "pow"
        one_value = getattr(ctypes.CDLL(None), name)
        one_value.restype, one_value.argtypes = ctypes.c_double, [ctypes.c_double] * (2 if two else 1)
        each = np.frompyfunc(one_value, 2 if two else 1, 1)
        plain = lambda *v, each=each: np.asarray(each(*v)).astype(float)
        ours = getattr(np, {"atan": "arctan", "acos": "arccos", "pow": "power"}.get(name, name))
        probe = (50 * x, 5 * x[::-1]) if two else (x,)
        found[name] = ours if check and np.array_equal(ours(*probe), plain(*probe)) else plain
    return SimpleNamespace(**found)


C = _library()
#: Karman's constant times gravity, as a decimal product.
BUOYANCY = 4.018


def _pow(x, y) -> np.ndarray:
    """The C library's power, also for exponents that numpy replaces by products."""
    x, y = np.broadcast_arrays(x, y)
    return C.pow(np.array(x, float), np.array(y, float))


def _decimal(x: np.ndarray) -> np.ndarray:
    """Differences of decimals like 1 - 0.95 without the binary rest."""
    return np.round(x, 12)


def _psi(z: np.ndarray, heat: bool) -> np.ndarray:
    """Stability corrections; z 0 is neutral."""
    out = np.zeros_like(z)
    up = ~(z < 0)
    s = z[up]
    out[up] = -6.1 * C.log(s + _pow(1 + _pow(np.abs(s), 2.5), 0.4))
    y = np.abs(z[~up])
    if heat:
        out[~up] = 0.943 / 0.78 * C.log(1 + _pow(y, 0.78) / 0.33)
    else:
        third, x = _pow(0.33, 0.333333), _pow(y / 0.33, 0.333333)
        y = np.minimum(y, 1 / 0.068921)
        out[~up] = C.log((0.33 + y) / 0.33) - 1.23 * _pow(y, 0.333333) + 0.205 * third * C.log((1 + x) * (1 + x) / (1 - x + x * x)) + np.sqrt(3) * 0.41 * third * (C.atan((2 * x - 1) / np.sqrt(3)) + np.pi / 6)
    return out


def _extinction(theta: np.ndarray, x_lad: np.ndarray) -> np.ndarray:
    """Extinction coefficient of a canopy for a beam from theta (radians); of spherical leaves by the secant."""
    wide = x_lad + 1.774 * _pow(x_lad + 1.182, -0.733)
    return np.where(x_lad == 1, 1 / C.cos(theta) / wide, np.sqrt(x_lad * x_lad + _pow(C.tan(theta), 2)) / wide)


def _layer(k, depth, root, ground) -> tuple[np.ndarray, np.ndarray]:
    """Transmittance and albedo of a canopy layer over a ground."""
    r = 2 * k / (k + 1) * (1 - root) / (1 + root)
    e = C.exp(-root * k * depth)
    back = (r - ground) / (r * ground - 1) * e * e
    return (r * r - 1) * e / (r * ground - 1 + r * (r - ground) * e * e), (r + back) / (1 + r * back)


def inputs(row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """INPUTS of rows that have RAW: air, sun, sky, and the canopy of rows that aren't bare."""
    r = dict(row)
    t_a, ea, t = r["t_a"], r["ea"], r["t_a"] - 273.15
    p = r["p"] = np.where(np.isnan(r["p"]), 1013.25 * _pow(1 - 2.225577e-3 * (r["elev"] / 100), 5.25588), r["p"])
    q, lv, mixing = 0.622 * ea / (p - 0.378 * ea), 2501000 - 2361 * t, 0.622 * ea / (p - ea)
    cp = 1003.5 + 861.5 * q
    r |= {"lambda_v": lv, "c_p": cp, "rho": 100 * (p - 0.378 * ea) / (287.04 * t_a), "psicr": cp * p / (0.622 * lv), "e_slope": 2503.0584 * C.exp(17.27 * t / (t + 237.3)) / _pow(t + 237.3, 2)}
    # sun
    dec, lat = 0.409 * C.sin(2 * np.pi / 365 * r["doy"] - 1.39), np.radians(r["lat"])
    angle = 15 * (r["hr"] - 12) + (0.258 * C.cos(dec) - 7.416 * C.sin(dec) - 3.648 * C.cos(2 * dec) - 9.228 * C.sin(2 * dec)) / 4 - (r["stdlon"] - r["lon"])
    height = C.sin(lat) * C.sin(dec) + C.cos(lat) * C.cos(dec) * C.cos(np.radians(angle))
    sza = np.where(np.isnan(r["sza"]), np.degrees(C.acos(np.maximum(-1, np.minimum(1, height)))), r["sza"])
    mu, day = C.cos(np.radians(sza)), sza < 90
    # longwave of the sky
    low = t_a - (r["h_c"] - r["z_t"]) * 9.8 * (1 + lv * mixing / (287.04 * t_a)) / (cp + lv * lv * mixing * 0.622 / (287.04 * t_a * t_a))
    sky = 1.24 * _pow(ea / low, 1 / 7) * K["SB"] * _pow(low, 4)
    r["l_dn"] = np.where(np.isnan(r["l_dn"]), sky, r["l_dn"])
    # potential beams and their split
    vapour = np.where(day, 1320 * _pow(10, -1.195 + 0.4459 * C.log10(mu) - 0.0345 * _pow(C.log10(mu), 2)), 0)
    beam_vis = np.where(day, np.maximum(0, 599.94 * mu * C.exp(-0.185 * p / 1313.25 / mu)), 0)
    dif_vis = np.where(day, np.maximum(0, 0.4 * (599.94 * mu - beam_vis)), 0)
    beam_nir = np.where(day, np.maximum(0, mu * (720.06 * C.exp(-0.06 * p / 1313.25 / mu) - vapour)), 0)
    dif_nir = np.where(day, np.maximum(0, 0.6 * (720.06 * mu - beam_vis - vapour)), 0)
    vis, nir = (np.where(x > 0, x, 1e-6) for x in (beam_vis + dif_vis, beam_nir + dif_nir))
    clear, f_vis = np.minimum(1, r["s_dn"] / (vis + nir)), vis / (vis + nir)
    diffuse = lambda beam, total, top, span: 1 - np.maximum(0, np.minimum(1, beam / total * (1 - _pow((top - np.minimum(top, clear)) / span, 0.6667))))
    shade = diffuse(beam_vis, vis, 0.9, 0.7) * f_vis + diffuse(beam_nir, nir, 0.88, 0.68) * (1 - f_vis)
    s_dn, bare = r["s_dn"], r["bare"].astype(bool)
    # canopy
    lai, f_c, x_lad = r["lai"], r["f_c"], r["x_lad"]
    dense = lai / f_c
    nadir, view, sun = _extinction(np.zeros_like(lai), x_lad), _extinction(np.radians(r["vza"]), x_lad), _extinction(np.radians(np.minimum(sza, 89)), x_lad)
    through = np.zeros_like(lai)
    for d in range(0, 90, 5):
        through = through + C.exp(-lai * _extinction(np.radians(np.full_like(lai, d)), x_lad)) * C.sin(np.radians(np.full_like(lai, 2 * d))) / 2 * np.pi / 36
    k_d = -C.log(2 * through) / lai
    clump = -C.log(np.maximum(1e-36, 1 - f_c * (1 - C.exp(-nadir * dense)))) / (dense * nadir)
    seen = lambda theta: 1 + (1 / clump - 1) * C.exp(-2.2 * _pow(np.radians(theta), _decimal(3.8 - 0.46 / r["w_c"])))
    eff = dense / seen(np.minimum(sza, 89))
    sn_c, sn_s = np.zeros_like(lai), np.zeros_like(lai)
    for share, leaf, ground in ((f_vis, _decimal(1 - r["rho_vis"] - r["tau_vis"]), r["soil_vis"]), (1 - f_vis, _decimal(1 - r["rho_nir"] - r["tau_nir"]), r["soil_nir"])):
        beam, beam_albedo = _layer(sun, eff, np.sqrt(leaf), ground)
        sky_, sky_albedo = _layer(k_d, lai, np.sqrt(leaf), ground)
        sn_c = sn_c + ((1 - beam) * (1 - beam_albedo) * s_dn * (1 - shade) * share + (1 - sky_) * (1 - sky_albedo) * s_dn * shade * share)
        sn_s = sn_s + _decimal(1 - ground) * (beam * s_dn * (1 - shade) * share + sky_ * s_dn * shade * share)
    tau_lw, alb_lw = _layer(k_d, lai, np.sqrt(r["emis_c"]), _decimal(1 - r["emis_s"]))
    r |= {
        "f_local": np.where(bare, 0, dense), "f_theta": np.where(bare, 0, 1 - C.exp(-view * dense / seen(r["vza"]))), "tau_lw": tau_lw, "alb_lw": alb_lw,
        "sn_c": np.where(bare, 0, sn_c), "sn_s": np.where(bare, (1 - r["soil_vis"] * f_vis - r["soil_nir"] * (1 - f_vis)) * s_dn, sn_s),
    }
    return {c: r[c] for c in INPUTS}


class Air:
    """Turbulent exchange of some rows at given inverse Obukhov lengths (0: neutral)."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.row = row

    def friction(self, inv_l: np.ndarray) -> np.ndarray:
        r = self.row
        log = C.log((r["z_u"] - r["d_0"]) / r["z_0m"]) - _psi((r["z_u"] - r["d_0"]) * inv_l, False) + _psi(r["z_0m"] * inv_l, False)
        return np.maximum(r["u"] * K["KARMAN"] / log, LEAST_WIND)

    def aerodynamic(self, us: np.ndarray, inv_l: np.ndarray) -> np.ndarray:
        r = self.row
        log = C.log((r["z_t"] - r["d_0"]) / r["z_0m"]) - _psi((r["z_t"] - r["d_0"]) * inv_l, True) + _psi(r["z_0m"] * inv_l, True)
        return np.maximum(log / (us * K["KARMAN"]), LEAST_RESISTANCE)

    def inverse_length(self, us: np.ndarray, h: np.ndarray, le: np.ndarray) -> np.ndarray:
        r = self.row
        buoyant = h + 0.61 * r["t_a"] * r["c_p"] * le / r["lambda_v"]
        return -BUOYANCY * buoyant / (r["t_a"] * r["rho"] * r["c_p"] * us * us * us)

    def canopy_wind(self, us: np.ndarray, inv_l: np.ndarray, leaf_area: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Wind at height z inside the canopy, exponential below its top."""
        r = self.row
        top = np.maximum(us / K["KARMAN"] * (C.log((r["h_c"] - r["d_0"]) / r["z_0m"]) - _psi((r["h_c"] - r["d_0"]) * inv_l, False) + _psi(r["z_0m"] * inv_l, False)), LEAST_WIND)
        decay = 0.28 * _pow(leaf_area, 2 / 3) * _pow(r["h_c"] / r["leaf_w"], 1 / 3)
        return np.maximum(top * C.exp(-decay * (1 - z / r["h_c"])), LEAST_WIND)


def _settled(trail: list[np.ndarray]) -> np.ndarray:
    """Rows whose length repeats at a lag of two, or at a lag of three (a cycle), within the tolerance."""
    def close(i: int, j: int) -> np.ndarray:
        a, b = trail[-1 - i], trail[-1 - j]
        # |L_i - L_j| / |L_j| in inverse lengths
        return np.abs(b - a) <= TOLERANCE * np.abs(a)

    out = np.zeros(len(trail[-1]), bool)
    if len(trail) >= 4:
        out |= close(0, 2) & close(1, 3)
    if len(trail) >= 6:
        out |= close(0, 3) & close(1, 4) & close(2, 5)
    return out


def one_source(row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Bare rows: one surface, sensible heat from its temperature, the rest is evaporation."""
    n, air = len(row["t_r"]), Air(row)
    ln = row["emis_s"] * (row["l_dn"] - K["SB"] * _pow(row["t_r"], 4))
    rn = row["sn_s"] + ln
    inv_l = np.zeros(n)
    us = air.friction(inv_l)
    g0 = row["g_ratio"] * rn
    out = {k: np.full(n, np.nan) for k in OUTPUTS}
    live, trail = np.ones(n, bool), [inv_l]
    for step in range(MAX_STEPS):
        ra = air.aerodynamic(us, inv_l)
        h = row["rho"] * row["c_p"] * (row["t_r"] - row["t_a"]) / ra
        le = rn - g0 - h
        dry = le < 0
        h2 = np.where(dry, np.minimum(h, rn - g0), h)
        g2 = np.where(dry, np.maximum(g0, rn - h2), g0)
        le = np.where(dry, 0.0, le)
        new = {"flag": np.where(dry, FLAG_BARE_NO_LE, FLAG_BARE), "t_s": row["t_r"], "ln_s": ln, "le_s": le, "hf_s": h2, "g": g2, "r_a": ra, "u_star": us, "steps": np.full(n, step)}
        for k, v in new.items():
            out[k] = np.where(live, v, out[k])
        inv_l = np.where(live, air.inverse_length(us, h2, le), inv_l)
        us = np.where(live, air.friction(inv_l), us)
        out["obukhov"] = np.where(inv_l != 0, 1 / np.where(inv_l != 0, inv_l, 1), np.inf)
        trail.append(inv_l)
        live &= ~(np.abs(trail[-2] - inv_l) < TOLERANCE * np.abs(inv_l))
        if not live.any():
            break
    for k in ("le_c", "hf_c", "ln_c"):
        out[k][:] = 0.0
    return out


def _leaf_balance(r: dict, ra, rx, rs, h_c) -> np.ndarray:
    """Canopy temperature of the series network: linear solution and one Newton step in the fourth powers."""
    heat = h_c / (r["rho"] * r["c_p"])
    ft, fs = r["f_theta"], 1 - r["f_theta"]
    conduct = 1 / ra + 1 / rs + 1 / rx
    linear = (r["t_a"] / ra + r["t_r"] / (rs * fs) + heat * rx * conduct) / (1 / ra + 1 / rs + ft / (rs * fs))
    soil = linear * (1 + rs / ra) - heat * rx * rs * conduct - r["t_a"] * rs / ra
    slope = 4 * fs * _pow(soil, 3) * (1 + rs / ra) + 4 * ft * _pow(linear, 3)
    return linear + (_pow(r["t_r"], 4) - ft * _pow(linear, 4) - fs * _pow(soil, 4)) / slope


def _longwave(r: dict, t_c, t_s) -> tuple[np.ndarray, np.ndarray]:
    """Net longwave of canopy and soil, with the canopy's diffuse transmittance and albedo."""
    through, albedo = r["tau_lw"], r["alb_lw"]
    leaf, soil = r["emis_c"] * K["SB"] * _pow(t_c, 4), r["emis_s"] * K["SB"] * _pow(t_s, 4)
    return (1 - through) * ((1 - albedo) * (r["l_dn"] + soil) - 2 * leaf), r["emis_s"] * (through * r["l_dn"] + (1 - through) * leaf) - soil


def two_source(row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Vegetated rows: canopy transpiration by Priestley and Taylor, its coefficient cut by 0.1 until the soil does not condense."""
    n = len(row["t_r"])
    out = {k: np.full(n, np.nan) for k in OUTPUTS}
    state = {"inv_l": np.zeros(n)}
    state["us"] = Air(row).friction(state["inv_l"])
    state["t_c"] = np.minimum(row["t_r"], row["t_a"])
    soil4 = _pow(row["t_r"], 4) - row["f_theta"] * _pow(state["t_c"], 4)
    flag = np.where(soil4 >= 0, FLAG_ALL, FLAG_INVALID)
    state["t_s"] = np.where(soil4 >= 0, np.sqrt(np.sqrt(np.abs(soil4) / (1 - row["f_theta"]))), 1e-6)
    steps = np.zeros(n)
    trail = [state["inv_l"].copy()]
    settled = np.zeros(n, bool)
    for step in range(MAX_STEPS):
        open_ = ~settled & (flag != FLAG_INVALID)
        if not open_.any():
            break
        steps[open_] = step
        flag[open_] = FLAG_ALL
        todo, alpha = np.flatnonzero(open_), row["alpha"].copy()
        while len(todo):
            r = {k: v[todo] for k, v in row.items()}
            air, inv_l, us = Air(r), state["inv_l"][todo], state["us"][todo]
            a = alpha[todo]
            flag[todo] = np.where(a <= 0, FLAG_NO_LE, np.where(a < r["alpha"] - 1e-9, FLAG_NO_SOIL_LE, FLAG_ALL))
            ra = air.aerodynamic(us, inv_l)
            at_leaves = air.canopy_wind(us, inv_l, r["f_local"], r["d_0"] + r["z_0m"])
            rx = np.maximum(90 / r["lai"] * np.sqrt(r["leaf_w"] / at_leaves), LEAST_RESISTANCE)
            at_soil = air.canopy_wind(us, inv_l, r["lai"], np.full(len(todo), 0.01))
            soil_resistance = lambda dt: np.maximum(1 / (0.0038 * _pow(np.maximum(dt, 0), 1 / 3) + 0.012 * at_soil), LEAST_RESISTANCE)  # noqa: E731,B023
            rs = soil_resistance(state["t_s"][todo] - state["t_c"][todo])
            ln_c, ln_s = _longwave(r, state["t_c"][todo], state["t_s"][todo])
            rn_c, rn_s = r["sn_c"] + ln_c, r["sn_s"] + ln_s
            h_c = rn_c * (1 - a * r["f_g"] * 10 * r["e_slope"] / (10 * r["e_slope"] + r["psicr"]))
            t_c = _leaf_balance(r, ra, rx, rs, h_c)
            soil4 = _pow(r["t_r"], 4) - r["f_theta"] * _pow(t_c, 4)
            bad = ~(soil4 >= 0)
            flag[todo[bad]] = FLAG_INVALID
            t_s = np.where(bad, 1e-6, np.sqrt(np.sqrt(np.abs(soil4) / (1 - r["f_theta"]))))
            rs = soil_resistance(t_s - t_c)
            t_ac = (r["t_a"] / ra + t_s / rs + t_c / rx) / (1 / ra + 1 / rs + 1 / rx)
            h_s = r["rho"] * r["c_p"] * (t_s - t_ac) / rs
            g = r["g_ratio"] * rn_s
            le_s, le_c = rn_s - g - h_s, rn_c - h_c
            dry = le_c == 0
            h_s = np.where(dry, np.minimum(h_s, rn_s - g), h_s)
            g = np.where(dry, np.maximum(g, rn_s - h_s), g)
            le_s = np.where(dry, 0.0, le_s)
            good = ~bad
            now = todo[good]
            for k, v in (("t_s", t_s), ("t_c", t_c), ("t_ac", t_ac), ("ln_s", ln_s), ("ln_c", ln_c), ("le_c", le_c), ("hf_c", h_c), ("le_s", le_s), ("hf_s", h_s), ("g", g), ("r_s", rs), ("r_x", rx), ("r_a", ra)):
                out[k][now] = v[good]
            state["t_c"][now], state["t_s"][now] = t_c[good], t_s[good]
            new_l = air.inverse_length(us, h_c + h_s, le_c + le_s)
            state["inv_l"][now] = new_l[good]
            state["us"][now] = air.friction(new_l)[good]
            # rows whose soil would condense try a smaller coefficient, down to none
            todo = now[(le_s[good] < 0) & (a[good] > 0)]
            alpha[todo] = np.maximum(alpha[todo] - 0.1, 0.0)
        trail = [*trail[-5:], state["inv_l"].copy()]
        settled |= _settled(trail)
    valid = flag != FLAG_INVALID
    for k in OUTPUTS:
        out[k][~valid] = np.nan
    inv_l = state["inv_l"]
    out |= {"flag": flag, "steps": steps, "u_star": np.where(valid, state["us"], np.nan), "obukhov": np.where(valid & (inv_l != 0), 1 / np.where(inv_l != 0, inv_l, 1), np.nan)}
    return out


def whole_surface(row: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Vegetated rows as one surface that takes up what canopy and soil do; its fluxes are the soil's columns, flags 10 and 15."""
    cover = row["f_theta"]
    return one_source(row | {"sn_s": row["sn_c"] + row["sn_s"], "emis_s": cover * row["emis_c"] + (1 - cover) * row["emis_s"]})


#: Balances of vegetated rows by name; a function of the same form may stand in for a name.
MODELS: dict[str, Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]] = {"two_source": two_source, "one_source": whole_surface}


def solve(frames: Iterator[pd.DataFrame], vegetated: Callable = two_source) -> Iterator[pd.DataFrame]:
    for frame in frames:
        keys = [c for c in frame.columns if c not in RAW]
        parts = []
        bare = frame["bare"].to_numpy(bool)
        for chosen, model in ((bare, one_source), (~bare, vegetated)):
            if chosen.any():
                part = frame[chosen]
                with np.errstate(all="ignore"):
                    row = inputs({c: part[c].to_numpy(float).copy() for c in RAW})
                    del row["bare"]
                    net = {k: row[k].copy() for k in ("sn_c", "sn_s")}
                    found = {c: np.full(len(part), np.nan) for c in OUTPUTS} | model(row) | net
                got = pd.DataFrame(found, index=part.index).replace([np.inf, -np.inf], np.nan)
                parts.append(pd.concat([part[keys], got], axis=1))
        if parts:
            yield pd.concat(parts).sort_index().astype({"flag": "int32", "steps": "int32"})


DEFAULTS: dict[str, float] = {
    "elev": 100.0, "lat": 52.0, "lon": 13.0, "stdlon": 15.0, "f_c": 0.8, "f_g": 1.0, "w_c": 1.0, "psi": 0.0, "landcover": 12,
    "z_u": 10.0, "z_t": 10.0, "leaf_w": 0.1, "x_lad": 1.0, "alpha": 1.26, "g_ratio": 0.35, "emis_c": 0.98, "emis_s": 0.95,
    "rho_vis": 0.07, "tau_vis": 0.08, "rho_nir": 0.32, "tau_nir": 0.33, "soil_vis": 0.15, "soil_nir": 0.25,
}


def run_fluxes(df: DataFrame, keys: list[str], defaults: dict[str, Column] | None = None, model: str | Callable = "two_source", extra: Sequence[str] = ()) -> DataFrame:
    """keys and the balance of rows with t_r, t_a, u, ea, s_dn, lai, h_c, vza, doy, hr; other inputs have defaults.

    Output: net radiation parts, fluxes, temperatures, resistances, flag (0-5 vegetated,
    10 and 15 bare, 255 no solution: fluxes NULL), totals rn, h, le. Rows with a NULL
    required input have flag 255. `model` is the balance of vegetated rows: a name in
    MODELS, or a function from input arrays (INPUTS) to output arrays (those of OUTPUTS
    that it has) of the same length. `extra` names inputs and intermediate columns (as
    sza, l_dn, skyl, z_0m, d_0) that come along as doubles.
    """
    vegetated = MODELS[model] if isinstance(model, str) else model
    # the steps below name columns freely: keys travel under names of their own
    kinds, named, keys = [df.schema[k].dataType.simpleString() for k in keys], keys, [f"_key{i}" for i in range(len(keys))]
    df = df.withColumns(dict(zip(keys, map(F.col, named))))
    full = with_defaults(df, {c: F.lit(v) for c, v in DEFAULTS.items()} | (defaults or {}))
    given = set(full.columns)
    if "p" not in full.columns:
        full = f.PRESSURE.apply(full)
    if "sza" not in full.columns:
        full = f.SUN.apply(full).withColumn("sza", F.col("sun_zenith"))
    if "l_dn" not in full.columns:
        full = f.LONGWAVE.apply(f.HUMIDITY.apply(f.AIR.apply(full)))
    else:
        full = f.HUMIDITY.apply(f.AIR.apply(full))
    full = split_vegetation(f.DIFFUSE.apply(full))
    needed = ["t_r", "t_a", "u", "ea", "s_dn", "h_c", "vza"]
    usable = None
    for c in needed:
        usable = F.col(c).isNotNull() if usable is None else usable & F.col(c).isNotNull()
    bare = full.filter(usable & F.col("bare")).withColumns({"z_0m": F.lit(0.01), "d_0": F.lit(0.0)})
    veg = f.ROUGHNESS.apply(full.filter(usable & ~F.col("bare")).drop("z_0m", "d_0"))
    if set(extra) - set(veg.columns):
        veg = f.CLUMPING.apply(veg.withColumns({"s_dir": F.col("s_dn") * (1 - F.col("skyl")), "s_dif": F.col("s_dn") * F.col("skyl")}))
        beam = f.FormulaSet({"om_sun": "omega0 / (omega0 + (1.0 - omega0) * exp(-2.2 * pow(radians(least(sza, 89.0)), 3.8 - 0.46 / w_c)))", "lai_eff": "f_local * om_sun", "f_theta": "1.0 - exp(-k_view * omega * f_local)"})
        veg = f.NET_SHORTWAVE.apply(beam.apply(veg))
    along = lambda table: [(F.col(c) if c in table.columns else F.lit(None)).cast("double").alias(f"_extra{i}") for i, c in enumerate(extra)]
    # what is derived here is for `extra` only: inputs() derives it for the balance
    columns = [(F.col(c) if c in given or c in ("z_0m", "d_0", "bare") else F.lit(None)).cast("boolean" if c == "bare" else "double").alias(c) for c in RAW]
    both = bare.select(*keys, *along(bare), *columns).unionByName(veg.select(*keys, *along(veg), *columns))
    schema = ", ".join([*(f"{k} {kind}" for k, kind in zip(keys, kinds)), *(f"_extra{i} double" for i in range(len(extra))), *(f"{c} {'int' if c in ('flag', 'steps') else 'double'}" for c in OUTPUTS)])
    solved = both.mapInPandas(lambda frames: solve(frames, vegetated), schema)
    left = full.filter(~usable).select(*keys, *along(full), *((F.lit(FLAG_INVALID).cast("int") if c == "flag" else F.lit(None).cast("int" if c == "steps" else "double")).alias(c) for c in OUTPUTS))
    out = solved.unionByName(left).withColumns({"h": F.col("hf_c") + F.col("hf_s"), "le": F.col("le_c") + F.col("le_s")})
    return out.withColumnsRenamed(dict(zip(keys, named)) | {f"_extra{i}": c for i, c in enumerate(extra)})


def station_results(df: DataFrame, defaults: dict[str, Column] | None = None, model: str | Callable = "two_source") -> DataFrame:
    """The balance of station rows (year, doy, hr and the inputs of run_fluxes) under the column names of a result table."""
    shown = ["year", "doy", "hr", "lai", "f_g", "vza", "sza", "sun_azimuth", "l_dn", "skyl", "z_0m", "d_0"]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    out = run_fluxes(rows, ["_row"], defaults, model, shown).drop("_row")
    names = {
        "year": "Year", "doy": "DOY", "hr": "Time", "lai": "LAI", "f_g": "f_g", "vza": "VZA", "sza": "SZA", "sun_azimuth": "SAA", "l_dn": "L_dn",
        "sn_c": "Rn_sw_veg", "sn_s": "Rn_sw_soil", "ln_c": "Rn_lw_veg", "ln_s": "Rn_lw_soil", "t_c": "T_C", "t_s": "T_S", "t_ac": "T_AC", "le": "LE_model", "h": "H_model",
        "le_c": "LE_C", "hf_c": "H_C", "le_s": "LE_S", "hf_s": "H_S", "g": "G_model", "r_s": "R_S", "r_x": "R_x", "r_a": "R_A", "u_star": "u_friction", "obukhov": "L",
        "skyl": "Skyl", "z_0m": "z_0M", "d_0": "d_0", "flag": "flag",
    }
    net = F.coalesce("sn_c", F.lit(0.0)) + F.coalesce("sn_s", F.lit(0.0)) + F.coalesce("ln_c", F.lit(0.0)) + F.col("ln_s")
    return out.select(*(F.col(c).alias(n) for c, n in names.items()), net.alias("Rn_model"))
