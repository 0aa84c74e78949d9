"""The energy balance as one SQL statement: every iteration of a row is a row of a recursive query.

Written from the published schemes apart from `plans.fluxes`: bare rows step over the
Obukhov length, vegetated ones over the length and, within a step, over the
transpiration coefficient. A row of the recursion is the state in which a trial begins;
the last one of an id gives its results.
"""

from __future__ import annotations

from furrow.plans.registry.physics_sql import _DIFFUSE_K, _SPHERE, _extinction, _layer, _psi_heat, _psi_momentum

#: Columns of the result and their digits; inv_obukhov is 1 / length.
SHOWN = {
    "flag": 0, "sn_c": 2, "sn_s": 2, "t_s": 2, "t_c": 2, "t_ac": 2, "ln_s": 1, "ln_c": 1, "le_c": 1, "hf_c": 1, "le_s": 1, "hf_s": 1,
    "g": 1, "r_s": 1, "r_x": 1, "r_a": 1, "u_star": 3, "inv_obukhov": 3, "steps": 0, "h": 1, "le": 1,
}

#: Rows that have not settled at their last step have no digits left that two engines share, but for these columns.
LAST, SURE = 14, ("sn_c", "sn_s", "steps")

#: Rows of the station view with this leaf area, cover and filter.
_STATION = """SELECT id, CAST(doy AS DOUBLE) AS doy, CAST(round(hr * 60) AS DOUBLE) / 60 AS hr, CAST(t_r1 AS DOUBLE) AS t_r, CAST(t_a1 AS DOUBLE) AS t_a, CAST(u AS DOUBLE) AS u, CAST(ea AS DOUBLE) AS ea, CAST(s_dn AS DOUBLE) AS s_dn,
CAST({lai} AS DOUBLE) AS lai, CAST(h_c AS DOUBLE) AS h_c, CAST(vza AS DOUBLE) AS vza, CAST({f_c} AS DOUBLE) AS f_c, 1013.25 * pow(1 - 2.225577e-3, 5.25588) AS p FROM station WHERE {where}"""
_INPUT = """i0 AS ({rows}),
i1 AS (SELECT *, t_a - 273.15 AS t, 0.409 * sin(2 * pi() / 365 * doy - 1.39) AS dec, coalesce(t_r + t_a + u + ea + s_dn + h_c + vza, NULL) IS NOT NULL AS usable, f_c <= 0.01 OR coalesce(lai, 0) <= 0 AS bare FROM i0),
i2 AS (SELECT *, 0.622 * ea / (p - 0.378 * ea) AS q, 2501000 - 2361 * t AS lv, 0.622 * ea / (p - ea) AS r,
 sin(radians(52)) * sin(dec) + cos(radians(52)) * cos(dec) * cos(radians(15 * (hr - 12) + (0.258 * cos(dec) - 7.416 * sin(dec) - 3.648 * cos(2 * dec) - 9.228 * sin(2 * dec)) / 4 - 2)) AS mu0 FROM i1),
i3 AS (SELECT *, 1003.5 + 861.5 * q AS cp, 100 * (p - 0.378 * ea) / (287.04 * t_a) AS rho, 2503.0584 * exp(17.27 * t / (t + 237.3)) / pow(t + 237.3, 2) AS es_slope, degrees(acos(greatest(-1, least(1, mu0)))) AS sza FROM i2),
i4 AS (SELECT *, cp * p / (0.622 * lv) AS psy, cos(radians(sza)) AS mu, t_a - (h_c - 10) * 9.8 * (1 + lv * r / (287.04 * t_a)) / (cp + lv * lv * r * 0.622 / (287.04 * t_a * t_a)) AS low FROM i3),
i5 AS (SELECT *, 1.24 * pow(ea / low, 1.0 / 7) * 5.670373e-8 * pow(low, 4) AS sky_lw, CASE WHEN sza < 90 THEN 1320 * pow(10, -1.195 + 0.4459 * log10(mu) - 0.0345 * pow(log10(mu), 2)) ELSE 0 END AS vap, CASE WHEN sza < 90 THEN greatest(0, 599.94 * mu * exp(-0.185 * p / 1313.25 / mu)) ELSE 0 END AS bv FROM i4),
i6 AS (SELECT *, CASE WHEN sza < 90 THEN greatest(0, 0.4 * (599.94 * mu - bv)) ELSE 0 END AS dv, CASE WHEN sza < 90 THEN greatest(0, mu * (720.06 * exp(-0.06 * p / 1313.25 / mu) - vap)) ELSE 0 END AS bn, CASE WHEN sza < 90 THEN greatest(0, 0.6 * (720.06 * mu - bv - vap)) ELSE 0 END AS dn FROM i5),
i7 AS (SELECT *, CASE WHEN bv + dv > 0 THEN bv + dv ELSE 1e-6 END AS pv, CASE WHEN bn + dn > 0 THEN bn + dn ELSE 1e-6 END AS pn FROM i6),
i8 AS (SELECT *, least(1, s_dn / (pv + pn)) AS clear, pv / (pv + pn) AS fv FROM i7),
i9 AS (SELECT *, (1 - greatest(0, least(1, bv / pv * (1 - pow((0.9 - least(0.9, clear)) / 0.7, 0.6667))))) * fv + (1 - greatest(0, least(1, bn / pn * (1 - pow((0.88 - least(0.88, clear)) / 0.68, 0.6667))))) * (1 - fv) AS shade FROM i8)"""

_BARE = f"""b0 AS (SELECT *, (1 - 0.15 * fv - 0.25 * (1 - fv)) * s_dn AS sn, 0.95 * (sky_lw - 5.670373e-8 * pow(t_r, 4)) AS ln_ FROM i9 WHERE usable AND bare),
b1 AS (SELECT *, sn + ln_ AS rn, 0.35 * (sn + ln_) AS g0 FROM b0),
bs(id, step, inv, us, ended) AS (
 SELECT id, 0, CAST(0 AS DOUBLE), greatest(0.01, u * 0.41 / ln(1000)), FALSE FROM b1
 UNION ALL
 SELECT id, step + 1, new, greatest(0.01, u * 0.41 / (ln(1000) - ({_psi_momentum('(10 * new)')}) + ({_psi_momentum('(0.01 * new)')}))), abs(inv - new) < 1e-3 * abs(new) FROM (
  SELECT *, -0.41 * 9.8 * (h + 0.61 * t_a * cp * le / lv) / (t_a * rho * cp * us * us * us) AS new FROM (
   SELECT *, CASE WHEN le0 < 0 THEN least(h0, rn - g0) ELSE h0 END AS h, greatest(le0, 0) AS le FROM (
    SELECT *, rn - g0 - h0 AS le0 FROM (
     SELECT *, rho * cp * (t_r - t_a) / greatest(0.1, (ln(1000) - ({_psi_heat('(10 * inv)')}) + ({_psi_heat('(0.01 * inv)')})) / (us * 0.41)) AS h0 FROM bs JOIN b1 USING (id) WHERE step < 15 AND NOT ended))))),
bl AS (SELECT bs.*, lead(inv) OVER (PARTITION BY id ORDER BY step) AS after FROM bs QUALIFY step = max(step) OVER (PARTITION BY id) - 1),
bo AS (SELECT *, greatest(0.1, (ln(1000) - ({_psi_heat('(10 * inv)')}) + ({_psi_heat('(0.01 * inv)')})) / (us * 0.41)) AS ra FROM bl JOIN b1 USING (id)),
bp AS (SELECT *, rho * cp * (t_r - t_a) / ra AS h0 FROM bo),
bq AS (SELECT *, rn - g0 - h0 < 0 AS dry, CASE WHEN rn - g0 - h0 < 0 THEN least(h0, rn - g0) ELSE h0 END AS h FROM bp),
bare_rows AS (SELECT id, CASE WHEN dry THEN 15 ELSE 10 END AS flag, CAST(0 AS DOUBLE) AS sn_c, sn AS sn_s, t_r AS t_s, CAST(NULL AS DOUBLE) AS t_c, CAST(NULL AS DOUBLE) AS t_ac, ln_ AS ln_s, CAST(0 AS DOUBLE) AS ln_c, CAST(0 AS DOUBLE) AS le_c, CAST(0 AS DOUBLE) AS hf_c,
 CASE WHEN dry THEN 0 ELSE rn - g0 - h0 END AS le_s, h AS hf_s, CASE WHEN dry THEN greatest(g0, rn - h) ELSE g0 END AS g, CAST(NULL AS DOUBLE) AS r_s, CAST(NULL AS DOUBLE) AS r_x, ra AS r_a, us AS u_star, nullif(after, 0) AS inv_obukhov, step AS steps FROM bq)"""

_BAND = ", ".join(f"{e} AS {c}" for c, e in zip(("tb", "ab", "tf", "af"), (*_layer("kb", "eff", "root", "ground"), *_layer("kd", "lai", "root", "ground"))))
_CANOPY = f"""c0 AS (SELECT *, h_c / 8 AS z0, 0.65 * h_c AS d0, lai / f_c AS dense, 1 / {_SPHERE} AS kn, {_extinction("radians(vza)")} AS kv, {_extinction("radians(least(sza, 89))")} AS kb, {_DIFFUSE_K} AS td FROM i9 WHERE usable AND NOT bare),
c1 AS (SELECT *, -ln(greatest(1e-36, 1 - f_c * (1 - exp(-kn * dense)))) / (dense * kn) AS clump, -ln(td) / lai AS kd FROM c0),
c2 AS (SELECT *, 1 - exp(-kv * dense / (1 + (1 / clump - 1) * exp(-2.2 * pow(radians(vza), 3.34)))) AS ft, dense / (1 + (1 / clump - 1) * exp(-2.2 * pow(radians(least(sza, 89)), 3.34))) AS eff FROM c1),
bands AS (SELECT c2.id, kb, kd, eff, lai, s_dn, shade, CASE WHEN name = 'vis' THEN fv ELSE 1 - fv END AS share, sqrt(1 - leaf) AS root, ground FROM c2, (VALUES ('vis', 0.15, 0.15), ('nir', 0.65, 0.25)) AS b(name, leaf, ground)),
sums AS (SELECT id, sum((1 - tb) * (1 - ab) * s_dn * (1 - shade) * share + (1 - tf) * (1 - af) * s_dn * shade * share) AS sc, sum((1 - ground) * (tb * s_dn * (1 - shade) * share + tf * s_dn * shade * share)) AS ss FROM (SELECT *, {_BAND} FROM bands) GROUP BY id),
c3 AS (SELECT c2.*, sc, ss, {_layer("kd", "lai", "sqrt(0.98)", "0.05")[0]} AS thru, {_layer("kd", "lai", "sqrt(0.98)", "0.05")[1]} AS alb, ln((10 - d0) / z0) AS lz FROM c2 JOIN sums USING (id))"""


def _trial(source: str) -> str:
    """One trial of every state in `source` (state columns joined with c3): all that it finds."""
    wind = lambda area, z: f"greatest(0.01, top * exp(-0.28 * pow({area}, 2.0 / 3) * pow(h_c / 0.1, 1.0 / 3) * (1 - ({z}) / h_c)))"
    soil = lambda dt: f"greatest(0.1, 1 / (0.0038 * pow(greatest(0, {dt}), 1.0 / 3) + 0.012 * us_low))"
    layers = [
        f"greatest(0.1, (lz - ({_psi_heat('((10 - d0) * inv)')}) + ({_psi_heat('(z0 * inv)')})) / (us * 0.41)) AS ra, greatest(0.01, us / 0.41 * (ln((h_c - d0) / z0) - ({_psi_momentum('((h_c - d0) * inv)')}) + ({_psi_momentum('(z0 * inv)')}))) AS top",
        f"{wind('dense', 'd0 + z0')} AS us_leaf, {wind('lai', '0.01')} AS us_low",
        f"greatest(0.1, 90 / lai * sqrt(0.1 / us_leaf)) AS rx, {soil('ts - tc')} AS rs0, 0.98 * 5.670373e-8 * pow(tc, 4) AS leaves, 0.95 * 5.670373e-8 * pow(ts, 4) AS floor_",
        "(1 - thru) * ((1 - alb) * (sky_lw + floor_) - 2 * leaves) AS lnc, 0.95 * (thru * sky_lw + (1 - thru) * leaves) - floor_ AS lns",
        "sc + lnc AS rnc, ss + lns AS rns, (sc + lnc) * (1 - a * 10 * es_slope / (10 * es_slope + psy)) AS hc",
        "hc / (rho * cp) AS heat, 1 / ra + 1 / rs0 + 1 / rx AS cond",
        "(t_a / ra + t_r / (rs0 * (1 - ft)) + heat * rx * cond) / (1 / ra + 1 / rs0 + ft / (rs0 * (1 - ft))) AS lin",
        "lin * (1 + rs0 / ra) - heat * rx * rs0 * cond - t_a * rs0 / ra AS ground_t",
        "lin + (pow(t_r, 4) - ft * pow(lin, 4) - (1 - ft) * pow(ground_t, 4)) / (4 * (1 - ft) * pow(ground_t, 3) * (1 + rs0 / ra) + 4 * ft * pow(lin, 3)) AS tc1",
        "pow(t_r, 4) - ft * pow(tc1, 4) AS soil4",
        "isnan(soil4) OR soil4 < 0 AS bad, sqrt(sqrt(abs(soil4) / (1 - ft))) AS ts1",
        f"{soil('ts1 - tc1')} AS rs",
        "(t_a / ra + ts1 / rs + tc1 / rx) / (1 / ra + 1 / rs + 1 / rx) AS tac",
        "rho * cp * (ts1 - tac) / rs AS hs0, 0.35 * rns AS gs0, rnc - hc AS lec",
        "CASE WHEN lec = 0 THEN least(hs0, rns - gs0) ELSE hs0 END AS hs",
        "CASE WHEN lec = 0 THEN greatest(gs0, rns - hs) ELSE gs0 END AS gs, CASE WHEN lec = 0 THEN 0 ELSE rns - gs0 - hs0 END AS les",
        "-0.41 * 9.8 * (hc + hs + 0.61 * t_a * cp * (lec + les) / lv) / (t_a * rho * cp * us * us * us) AS new",
        f"greatest(0.01, u * 0.41 / (lz - ({_psi_momentum('((10 - d0) * new)')}) + ({_psi_momentum('(z0 * new)')}))) AS us1, les < 0 AND a > 0 AS again",
    ]
    for layer in layers:
        source = f"SELECT *, {layer} FROM ({source})"
    return source


def _close(x: str, y: str) -> str:
    return f"coalesce(abs({y} - {x}) <= 1e-3 * abs({x}), FALSE)"


_SETTLED = f"(({_close('new', 'h1')} AND {_close('h0', 'h2')}) OR ({_close('new', 'h2')} AND {_close('h0', 'h3')} AND {_close('h1', 'h4')}))"
_LEAF = f"""vs(id, k, step, a, inv, us, tc, ts, h0, h1, h2, h3, h4, ended) AS (
 SELECT id, 0, 0, CAST(1.26 AS DOUBLE), CAST(0 AS DOUBLE), greatest(0.01, u * 0.41 / lz), least(t_r, t_a), sqrt(sqrt((pow(t_r, 4) - ft * pow(least(t_r, t_a), 4)) / (1 - ft))), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), FALSE FROM c3
 UNION ALL
 SELECT id, k + 1, CASE WHEN again THEN step ELSE step + 1 END, CASE WHEN again THEN greatest(0, a - 0.1) ELSE 1.26 END, new, us1, tc1, ts1,
  CASE WHEN again THEN h0 ELSE new END, CASE WHEN again THEN h1 ELSE h0 END, CASE WHEN again THEN h2 ELSE h1 END, CASE WHEN again THEN h3 ELSE h2 END, CASE WHEN again THEN h4 ELSE h3 END,
  bad OR (NOT again AND (step = 14 OR {_SETTLED}))
 FROM ({_trial("SELECT * FROM vs JOIN c3 USING (id) WHERE NOT ended")})),
vl AS (SELECT * FROM vs QUALIFY k = max(k) OVER (PARTITION BY id) - 1),
vo AS ({_trial("SELECT * FROM vl JOIN c3 USING (id)")}),
leaf_rows AS (SELECT id, CASE WHEN bad THEN 255 WHEN a <= 0 THEN 5 WHEN a < 1.26 - 1e-9 THEN 3 ELSE 0 END AS flag, sc AS sn_c, ss AS sn_s, CASE WHEN NOT bad THEN ts1 END AS t_s, CASE WHEN NOT bad THEN tc1 END AS t_c, CASE WHEN NOT bad THEN tac END AS t_ac, CASE WHEN NOT bad THEN lns END AS ln_s, CASE WHEN NOT bad THEN lnc END AS ln_c,
 CASE WHEN NOT bad THEN lec END AS le_c, CASE WHEN NOT bad THEN hc END AS hf_c, CASE WHEN NOT bad THEN les END AS le_s, CASE WHEN NOT bad THEN hs END AS hf_s, CASE WHEN NOT bad THEN gs END AS g, CASE WHEN NOT bad THEN rs END AS r_s, CASE WHEN NOT bad THEN rx END AS r_x, CASE WHEN NOT bad THEN ra END AS r_a,
 CASE WHEN NOT bad THEN us1 END AS u_star, CASE WHEN NOT bad THEN nullif(new, 0) END AS inv_obukhov, step AS steps FROM vo)"""


def balance_ctes(rows: str) -> str:
    """CTEs up to `results` (id and the columns of SHOWN, not rounded) of rows (id, doy, hr, t_r, t_a, u, ea, s_dn, lai, h_c, vza, f_c, p)."""
    lost = ", ".join(f"CAST(NULL AS {'INT' if c == 'steps' else 'DOUBLE'})" for c in list(SHOWN)[1:-2])
    every = f"SELECT * FROM bare_rows UNION ALL SELECT * FROM leaf_rows UNION ALL SELECT id, 255, {lost} FROM i9 WHERE NOT usable"
    return f"{_INPUT.format(rows=rows)}, {_BARE}, {_CANOPY}, {_LEAF}, results AS (SELECT *, hf_c + hf_s AS h, le_c + le_s AS le FROM ({every}) z)"


def balance_sql(lai: str = "lai", f_c: str = "0.8", where: str = "TRUE", columns: tuple[str, ...] = tuple(SHOWN)) -> str:
    """The balance of station rows."""
    rounded = {c: f"CAST({c} AS INT)" if c in ("flag", "steps") else f"round({c}, {SHOWN[c]}) + 0e0" for c in columns}
    names = ", ".join(f"{e} AS {c}" if c in SURE else f"CASE WHEN steps < {LAST} OR steps IS NULL THEN {e} END AS {c}" for c, e in rounded.items())
    return f"WITH RECURSIVE {balance_ctes(_STATION.format(lai=lai, f_c=f_c, where=where))} SELECT id, {names} FROM results"


#: Best clear scene of a pixel and day with the weather at its time, its canopy, and the day's mean radiation.
_SCENES = """wx AS (SELECT hour, t2m, greatest(1, sqrt(u100 * u100 + v100 * v100)) AS wind, 8 + u100 AS ea, nullif(ssrd, 0) / 3600 AS s_dn FROM met_hourly),
mixed AS (SELECT o.pixel, o.seq, o.ts, o.lst, o.vza, o.bayes, o.confidence, extract(minute FROM o.ts) / 60e0 AS part, a.t2m AS t0, b.t2m AS t1, a.wind AS w0, b.wind AS w1, a.ea AS e0, b.ea AS e1, a.s_dn AS s0, b.s_dn AS s1
 FROM lst_obs o JOIN wx a ON a.hour = date_trunc('hour', o.ts) JOIN wx b ON b.hour = date_trunc('hour', o.ts) + INTERVAL 1 HOUR),
scenes AS (SELECT *, CAST(ts AS DATE) AS day, t0 - (t0 - t1) * part AS air FROM mixed WHERE vza < 45 AND bayes <> 2 AND (confidence < 16384 OR confidence >= 32678) AND lst >= 273.15 AND lst - (t0 - (t0 - t1) * part) >= -2
 QUALIFY row_number() OVER (PARTITION BY pixel, CAST(ts AS DATE) ORDER BY lst DESC, seq) = 1),
means AS (SELECT CAST(hour AS DATE) AS day, sum(s_dn) / 24 AS s_mean FROM wx WHERE s_dn <> 0 GROUP BY 1),
lines AS (SELECT pixel * 100000 + extract(year FROM day) % 100 * 1000 + extract(doy FROM day) AS id, pixel, day, s_mean, CAST(extract(doy FROM day) AS DOUBLE) AS doy, extract(hour FROM ts) + part AS hr, lst AS t_r, air AS t_a, w0 - (w0 - w1) * part AS u, e0 - (e0 - e1) * part AS ea, s0 - (s0 - s1) * part AS s_dn,
 0.5 + (pixel % 30) / 10e0 AS lai, 0.2 + (pixel % 10) / 20e0 AS h_c, CAST(vza AS DOUBLE) AS vza, 0.8e0 AS f_c, 1013.25e0 AS p FROM scenes JOIN means USING (day))"""
_DAILY = f"""WITH RECURSIVE {_SCENES}, {balance_ctes("SELECT id, doy, hr, t_r, t_a, u, ea, s_dn, lai, h_c, vza, f_c, p FROM lines")},
daily AS (SELECT lines.pixel, lines.day, flag, steps, 86400000 * lines.s_mean * le / nullif(lines.s_dn, 0) / (lv * (999.83952 + t * (16.945176 + t * (-7.9870401e-3 + t * (-46.170461e-6 + t * (105.56302e-9 - 280.54253e-12 * t))))) / (1 + 16.897850e-3 * t)) AS et FROM lines JOIN results USING (id) JOIN i9 USING (id))"""
#: Daily ET of `lines` and `results`.
ET_OF_LINES = _DAILY[_DAILY.index("86400000 *") : _DAILY.index(" AS et FROM lines")]
BEST_SCENES = _SCENES[: _SCENES.index(",\nlines AS")]
DAILY_ET = f"{_DAILY} SELECT pixel, day, CAST(flag AS INT) AS flag, CAST(steps AS INT) AS steps, CASE WHEN steps < {LAST} THEN round(et, 2) + 0e0 END AS et FROM daily"
ET_MEDIAN = f"{_DAILY} SELECT pixel, round(median(CASE WHEN et <= 0 OR et > 12 THEN 0 ELSE et END), 1) AS et_median, count(*) AS n_days FROM daily WHERE et IS NOT NULL GROUP BY pixel"

#: Digits of the columns of a result table; those not named are exact.
TABLE_DIGITS = {
    "Time": 6, "LAI": 3, "f_g": 3, "VZA": 3, "SZA": 4, "SAA": 4, "L_dn": 3, "Rn_model": 1, "Rn_sw_veg": 2, "Rn_sw_soil": 2, "Rn_lw_veg": 1, "Rn_lw_soil": 1, "T_C": 2, "T_S": 2, "T_AC": 2,
    "LE_model": 1, "H_model": 1, "LE_C": 1, "H_C": 1, "LE_S": 1, "H_S": 1, "G_model": 1, "R_S": 1, "R_x": 1, "R_A": 1, "u_friction": 3, "L": 0, "Skyl": 5, "z_0M": 4, "d_0": 4,
}
_TABLE = {
    "Year": "2024e0", "DOY": "doy", "Time": "hr", "LAI": "lai", "f_g": "1e0", "VZA": "vza", "SZA": "sza", "SAA": "CASE WHEN w > 0 THEN 360 - degrees(half) ELSE degrees(half) END", "L_dn": "sky_lw",
    "Rn_model": "sn_c + sn_s + ln_c + ln_s", "Rn_sw_veg": "sn_c", "Rn_sw_soil": "sn_s", "Rn_lw_veg": "ln_c", "Rn_lw_soil": "ln_s", "T_C": "t_c", "T_S": "t_s", "T_AC": "t_ac", "LE_model": "le", "H_model": "h",
    "LE_C": "le_c", "H_C": "hf_c", "LE_S": "le_s", "H_S": "hf_s", "G_model": "g", "R_S": "r_s", "R_x": "r_x", "R_A": "r_a", "u_friction": "u_star", "L": "1000 * inv_obukhov", "Skyl": "shade",
    "z_0M": "CASE WHEN bare THEN 1e-2 ELSE h_c / 8 END", "d_0": "CASE WHEN bare THEN 0 ELSE 0.65 * h_c END",
}
_ANGLES = """n0 AS (SELECT *, radians(15 * (hr - 12) + (0.258 * cos(dec) - 7.416 * sin(dec) - 3.648 * cos(2 * dec) - 9.228 * sin(2 * dec)) / 4 - 2) AS w FROM i9),
n1 AS (SELECT *, acos(greatest(-1, least(1, (sin(dec) * cos(radians(52)) - cos(w) * cos(dec) * sin(radians(52))) / nullif(sin(radians(sza)), 0)))) AS half FROM n0)"""
_WINDY = _STATION.replace("CAST(u AS DOUBLE) AS u", "CAST(u + 6 AS DOUBLE) AS u")
RESULT_TABLE = f"""WITH RECURSIVE {balance_ctes(_WINDY.format(lai="lai", f_c="0.8", where="TRUE"))}, {_ANGLES}
SELECT {", ".join(f"round({e}, {TABLE_DIGITS[c]}) + 0e0 AS {c}" if c in TABLE_DIGITS else f"{e} AS {c}" for c, e in _TABLE.items())}, CAST(flag AS INT) AS flag FROM n1 JOIN results USING (id)"""
