"""Hourly weather, indices and daily records."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import calendar, heat, psychro, scaling, solar
from heatgrid.functions import utci as climate_index
from heatgrid.operators import climatology, daily, ingest
from heatgrid.plans import fixtures as fx
from heatgrid.plans.common import Query, pick, rounded, table, with_ctes
from heatgrid.session import scratch_path
from heatgrid.sources import weather as weather_source

QUERIES: dict[str, Query] = {}


def _case(x: str, bands, default: str) -> str:
    arms = " ".join(f"WHEN {x} >= {e}e0 THEN '{label}'" for e, label in sorted(bands, key=lambda b: -b[0]))
    return f"CASE {arms} ELSE '{default}' END"


# --- moist air ---------------------------------------------------------------


def moist_air(spark, sf):
    h = fx.hourly(spark, sf)
    return rounded(
        h.select(
            "row_id",
            psychro.saturation_vapour_pressure("T2M").alias("svp"),
            psychro.vapour_pressure("T2M", "T2MDEW").alias("vp"),
            psychro.vapour_pressure("T2M", F.col("T2MDEW") + F.lit(10.0)).alias("vp_clamped"),
            F.col("RH2M").alias("rh"),
            psychro.specific_humidity(psychro.vapour_pressure("T2M", "T2MDEW"), "PS").alias("q"),
            psychro.wind_at_height("WS10M").alias("wind2m"),
            psychro.dewpoint_from_rh("T2M", "RH2M").alias("dewpoint"),
            psychro.apparent_temperature("T2M", "RH2M", "WS10M").alias("apparent"),
        )
    )


_vp = fx.svp("least(td, t2m)")
QUERIES["moist_air"] = (
    moist_air,
    with_ctes(
        pick(
            ["row_id"],
            [
                f"{fx.svp('t2m')} AS svp",
                f"{_vp} AS vp",
                f"{fx.svp('least(td + 10.0e0, t2m)')} AS vp_clamped",
                f"{fx.rh('t2m', 'td')} AS rh",
                f"0.622e0 * {_vp} / greatest(ps - 0.378e0 * {_vp}, 1e-6) AS q",
                "greatest(ws10 * (ln(2.0e0 / 0.03e0) / ln(10.0e0 / 0.03e0)), 0.13e0) AS wind2m",
                "least(td, t2m) AS dewpoint",
                f"t2m + 0.33e0 * (({fx.rh('t2m', 'td')}) / 100.0e0 * 6.105e0 * exp(17.27e0 * t2m / (237.7e0 + t2m))) - 0.70e0 * ws10 - 4.0e0 AS apparent",
            ],
            "hourly",
        ),
        fx.HOURLY,
    ),
)

HI_SQL = """hi0 AS (SELECT *, t2m * 9.0e0 / 5.0e0 + 32.0e0 AS f FROM moist),
hi1 AS (SELECT *, 0.5e0 * (f + 61.0e0 + (f - 68.0e0) * 1.2e0 + rh * 0.094e0) AS simple,
  -42.379e0 + 2.04901523e0 * f + 10.14333127e0 * rh - 0.22475541e0 * f * rh - 0.00683783e0 * f * f - 0.05481717e0 * rh * rh
  + 0.00122874e0 * f * f * rh + 0.00085282e0 * f * rh * rh - 0.00000199e0 * f * f * rh * rh AS regress FROM hi0),
hi2 AS (SELECT *, CASE
   WHEN (simple + f) / 2.0e0 < 80.0e0 THEN simple
   WHEN rh < 13.0e0 AND f BETWEEN 80.0e0 AND 112.0e0 THEN regress - (13.0e0 - rh) / 4.0e0 * sqrt(greatest((17.0e0 - abs(f - 95.0e0)) / 17.0e0, 0.0e0))
   WHEN rh > 85.0e0 AND f BETWEEN 80.0e0 AND 87.0e0 THEN regress + (rh - 85.0e0) / 10.0e0 * ((87.0e0 - f) / 5.0e0)
   ELSE regress END AS hif FROM hi1),
hi AS (SELECT *, (hif - 32.0e0) * 5.0e0 / 9.0e0 AS heat_index FROM hi2)"""


def comfort_indices(spark, sf):
    m = fx.moist(spark, sf)
    return rounded(
        m.select(
            "row_id",
            "heat_index",
            F.col("wbgt").alias("wbgt_shade"),
            heat.heat_index_category("heat_index").alias("hi_band"),
            heat.wbgt_category("wbgt").alias("wbgt_band"),
            heat.wbgt_risk_colour("wbgt").alias("risk_colour"),
            heat.utci_category("utci").alias("utci_band"),
        )
    )


QUERIES["comfort_indices"] = (
    comfort_indices,
    with_ctes(
        pick(
            [
                "row_id",
                _case("heat_index", heat.HEAT_INDEX_BANDS, "Safe") + " AS hi_band",
                _case("wbgt", heat.WBGT_BANDS, "Low") + " AS wbgt_band",
                _case("wbgt", heat.RISK_COLOURS, "Green (Low)") + " AS risk_colour",
                _case("utci", heat.UTCI_BANDS, "Extreme cold stress") + " AS utci_band",
            ],
            ["heat_index", "wbgt AS wbgt_shade"],
            "hi",
        ),
        fx.HOURLY,
        fx.MOIST,
        HI_SQL,
    ),
)

# --- sun and radiation -------------------------------------------------------


def _sun(df):
    short = {"T2M": "t2m", "T2MDEW": "td", "ALLSKY_SFC_SW_DWN": "ghi", "WS10M": "ws10", "RH2M": "rh"}
    return daily.with_sun(df.withColumnsRenamed(short))


def _fourier(b: str, series) -> str:
    mean, harmonics = series
    parts = [f"({mean!r})::DOUBLE"]
    for k, (c, s) in enumerate(harmonics, start=1):
        parts.append(f"({c!r})::DOUBLE * cos({b} * {k}.0e0) + ({s!r})::DOUBLE * sin({b} * {k}.0e0)")
    return "(" + " + ".join(parts) + ")"


SUN_SQL = f"""sun0 AS (SELECT *, ts_utc + INTERVAL 30 MINUTE AS mid FROM hourly),
sun1 AS (SELECT *, dayofyear(mid) AS mdoy, 2.0e0 * pi() * (dayofyear(mid) - 1.0e0) / 365.0e0 AS b,
   extract(hour FROM mid) + extract(minute FROM mid) / 60.0e0 + floor(extract(second FROM mid)) / 3600.0e0 AS hh FROM sun0),
sun2 AS (SELECT *, 12.0e0 - lon / 15.0e0 - 229.18e0 * {_fourier('b', solar.EQUATION_OF_TIME)} / 60.0e0 AS noon,
   {_fourier('b', solar.DECLINATION)} AS decl, 1366.1e0 * {_fourier('b', solar.DISTANCE)} AS top FROM sun1),
sun3 AS (SELECT *, least(greatest(sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((hh - noon) * 15.0e0)), 0.0e0), 1.0e0) AS cosz FROM sun2),
sun4 AS (SELECT *, least(greatest(ghi / (top * greatest(cosz, 0.065e0)), 0.0e0), 1.0e0) AS kt FROM sun3),
sun5 AS (SELECT *, CASE WHEN cosz < cos(radians(87.0e0)) THEN ghi ELSE ghi * CASE WHEN kt <= 0.22e0 THEN 1.0e0 - 0.09e0 * kt
   WHEN kt <= 0.8e0 THEN 0.9511e0 - 0.1604e0 * kt + 4.388e0 * kt * kt - 16.638e0 * kt * kt * kt + 12.336e0 * kt * kt * kt * kt ELSE 0.165e0 END END AS dhi FROM sun4),
sun AS (SELECT *, CASE WHEN cosz < cos(radians(87.0e0)) THEN 0.0e0 ELSE greatest(ghi - dhi, 0.0e0) / greatest(cosz, 1e-6) END AS dni,
   CASE WHEN ghi > 1.0e0 THEN least(greatest(ghi - dhi, 0.0e0) / ghi, 1.0e0) ELSE 0.0e0 END AS direct_fraction FROM sun5)"""


def solar_geometry(spark, sf):
    s = _sun(fx.hourly(spark, sf))
    noon = solar.solar_noon_utc("lon", F.dayofyear(F.col("ts_utc") + F.expr("INTERVAL 30 MINUTES")))
    return rounded(s.select("row_id", "cosz", "dni", "dhi", "direct_fraction", noon.alias("noon")))


QUERIES["solar_geometry"] = (
    solar_geometry,
    with_ctes(pick(["row_id"], ["cosz", "dni", "dhi", "direct_fraction", "noon"], "sun"), fx.HOURLY, SUN_SQL),
)

RAD_SQL = f"""rad0 AS (SELECT *, least(ghi, 1.1e0 * 1367.0e0 * cosz) AS g FROM sun),
rad1 AS (SELECT *, direct_fraction * g AS bh, CASE WHEN cosz < 0.0873e0 THEN 0.0e0
   ELSE least(direct_fraction * g / greatest(cosz, 0.0873e0), 1367.0e0) END AS beam,
   greatest(g - direct_fraction * g, 0.0e0) AS diffuse, {_vp} AS e,
   least(greatest(0.575e0 * pow(greatest({_vp}, 1e-4) * 10.0e0, 1.0e0 / 7.0e0), 0.5e0), 1.0e0) AS emis,
   degrees(asin(cosz)) AS elev, {fx.rh('t2m', 'td')} AS rh,
   greatest(ws10 * (ln(2.0e0 / 0.03e0) / ln(10.0e0 / 0.03e0)), 0.13e0) AS ws2 FROM rad0),
rad2 AS (SELECT *, 0.308e0 * cos(radians(elev * (0.998e0 - elev * elev / 50000.0e0))) AS fp,
   0.95e0 * (beam / 4.0e0 + diffuse / 2.0e0 + 0.1e0 * g) AS sw_globe, 0.85e0 * (beam / 4.0e0 + diffuse / 2.0e0 + 0.1e0 * g) AS sw_wick FROM rad1),
rad AS (SELECT *, pow(greatest(0.70e0 * (fp * beam + 0.5e0 * diffuse + 0.1e0 * g) / (0.97e0 * 5.67e-8)
   + 0.5e0 * pow(t2m + 273.15e0, 4) * (emis + 0.999e0), 1.0e0), 0.25e0) - 273.15e0 AS tmrt FROM rad2)"""


def radiation_budget(spark, sf):
    s = daily.with_radiation(_sun(fx.hourly(spark, sf)))
    return rounded(
        s.select("row_id", "sw_globe", "sw_wick", F.col("emissivity").alias("emis"), F.col("area_factor").alias("fp"), "tmrt")
    )


QUERIES["radiation_budget"] = (
    radiation_budget,
    with_ctes(pick(["row_id"], ["sw_globe", "sw_wick", "emis", "fp", "tmrt"], "rad"), fx.HOURLY, SUN_SQL, RAD_SQL),
)

# Fixed points as a recursion that carries each row until its own step is small.
_FILM = "(({a}) + ({b})) / 2.0e0"
GLOBE_SQL = """globe AS (
  SELECT row_id, 0 AS k, t2m + 273.15e0 AS ta, ws2, ps, sw_globe AS sw, emis, t2m + 273.15e0 AS x, 1.0e0 AS move FROM rad
  UNION ALL
  SELECT row_id, k + 1, ta, ws2, ps, sw, emis, nx, abs(nx - x) FROM (
    SELECT *, x + 0.5e0 * (ta + (sw + 0.95e0 * 5.67e-8 * (0.5e0 * (emis + 0.999e0) * pow(ta, 4) - pow(x, 4))) / h - x) AS nx FROM (
      SELECT *, greatest(cbrt(pow(nuf, 3) + pow(2.0e0 + 0.589e0 * pow(gr * pr, 0.25e0) / pow(1.0e0 + pow(0.469e0 / pr, 9.0e0 / 16.0e0), 4.0e0 / 9.0e0), 3)) * kk / 0.15e0, 1e-6) AS h FROM (
        SELECT *, 2.0e0 + 0.6e0 * sqrt(greatest(rho * ws2 * 0.15e0 / mu, 1e-3)) * cbrt(pr) AS nuf,
          9.81e0 / greatest(film, 1.0e0) * abs(x - ta) * pow(0.15e0, 3) / greatest(pow(mu / rho, 2), 1e-12) AS gr FROM (
          SELECT *, 1003.5e0 * mu / kk AS pr FROM (
            SELECT *, ps * 1000.0e0 / (8314.34e0 / 28.97e0 * film) AS rho, 1.458e-6 * pow(film, 1.5e0) / (film + 110.4e0) AS mu,
              0.02624e0 * pow(film / 300.0e0, 0.8646e0) AS kk FROM (
              SELECT *, (ta + x) / 2.0e0 AS film FROM globe WHERE k < 50 AND move >= 0.02e0))))))),
globe_out AS (SELECT row_id, arg_max(x, k) - 273.15e0 AS tg FROM globe GROUP BY 1)"""
WICK_SQL = f"""wick AS (
  SELECT row_id, 0 AS k, t2m AS ta, td, ws2, ps, sw_wick AS sw, emis, e, t2m AS x, 1.0e0 AS move FROM rad
  UNION ALL
  SELECT row_id, k + 1, ta, td, ws2, ps, sw, emis, e, nx, abs(nx - x) FROM (
    SELECT *, x + 0.4e0 * (least(greatest(ta + (gain - lam * hm * rho * 0.622e0 * (es - e) / greatest(ps, 1e-6)) / greatest(h, 1e-6), td - 1.0e0), ta + 4.0e0) - x) AS nx FROM (
      SELECT *, flow * pow(1003.5e0 * mu / kk, 0.44e0) * kk / 0.007e0 AS h, flow * pow(mu / (rho * dv), 0.44e0) * dv / 0.007e0 AS hm,
        sw + 0.95e0 * 5.67e-8 * (0.5e0 * (emis + 0.999e0) * pow(ta + 273.15e0, 4) - pow(x + 273.15e0, 4)) AS gain,
        {fx.svp('x')} AS es, (2.501e0 - 0.00237e0 * x) * 1e6 AS lam FROM (
        SELECT *, 0.281e0 * pow(greatest(rho * ws2 * 0.007e0 / mu, 1e-3), 0.6e0) AS flow, 2.471e-5 * pow(film / 298.0e0, 1.75e0) / (ps / 101.325e0) AS dv FROM (
          SELECT *, ps * 1000.0e0 / (8314.34e0 / 28.97e0 * film) AS rho, 1.458e-6 * pow(film, 1.5e0) / (film + 110.4e0) AS mu,
            0.02624e0 * pow(film / 300.0e0, 0.8646e0) AS kk FROM (
            SELECT *, (ta + 273.15e0 + x + 273.15e0) / 2.0e0 AS film FROM wick WHERE k < 50 AND move >= 0.02e0)))))),
wick_out AS (SELECT row_id, arg_max(x, k) AS tnwb FROM wick GROUP BY 1)"""


def _utci_sql() -> str:
    """Nested Horner form of the published polynomial."""
    weights = dict(zip(climate_index.exponents(), climate_index.load_weights()))
    n = climate_index.DEGREE

    def level(prefix: tuple[int, ...], names: list[str]) -> str:
        room = n - sum(prefix)
        if not names:
            v, d, w, a = prefix
            return f"({weights[(a, w, d, v)]!r})::DOUBLE"
        out = level((*prefix, room), names[1:])
        for p in range(room - 1, -1, -1):
            out = f"({out} * {names[0]} + {level((*prefix, p), names[1:])})"
        return out

    return level((), ["pv", "dt", "wv", "t2m"])


UTCI_SQL = f"""uin AS (SELECT *, least(greatest(tmrt - t2m, -30.0e0), 70.0e0) AS dt, least(greatest(ws10, 0.5e0), 17.0e0) AS wv, t2m + 273.15e0 AS tk FROM rad),
uin2 AS (SELECT *, exp(2.7150305e0 * ln(1.0e0 + tk) + {' + '.join(f'({g!r})::DOUBLE * pow(tk, {i - 2})' for i, g in enumerate(climate_index.VAPOUR_G))}) * 0.01e0 * rh / 100.0e0 / 10.0e0 AS pv FROM uin),
uout AS (SELECT row_id, t2m + {_utci_sql()} AS utci FROM uin2)"""

SOLVED = (fx.HOURLY, SUN_SQL, RAD_SQL, GLOBE_SQL, WICK_SQL)


def globe_and_wet_bulb(spark, sf):
    h = fx.hourly(spark, sf)
    keyed = daily.hourly_indices(h.withColumn("cell_id", F.col("row_id")))
    return rounded(keyed.select(F.col("cell_id").alias("row_id"), "tg", "tnwb", "wbgt", "tmrt_globe"), 3)


QUERIES["globe_and_wet_bulb"] = (
    globe_and_wet_bulb,
    with_ctes(
        pick(
            ["row_id"],
            [
                "tg",
                "tnwb",
                "0.7e0 * tnwb + 0.2e0 * tg + 0.1e0 * t2m AS wbgt",
                "pow(greatest(pow(tg + 273.15e0, 4) + 1.10e8 / (0.95e0 * pow(0.15e0, 0.4e0)) * pow(ws2, 0.6e0) * (tg - t2m), 1.0e0), 0.25e0) - 273.15e0 AS tmrt_globe",
            ],
            "rad JOIN globe_out USING (row_id) JOIN wick_out USING (row_id)",
            digits=3,
        ),
        *SOLVED,
        recursive=True,
    ),
)


def utci_hourly(spark, sf):
    s = daily.with_radiation(_sun(fx.hourly(spark, sf)))
    return rounded(s.select("row_id", climate_index.utci("t2m", "tmrt", "ws10", "rh").alias("utci")), 3)


QUERIES["utci_hourly"] = (
    utci_hourly,
    with_ctes(pick(["row_id"], ["utci"], "uout", digits=3), fx.HOURLY, SUN_SQL, RAD_SQL, UTCI_SQL),
)


def hourly_indices_daily(spark, sf):
    """Full chain: weather -> every index -> daily records."""
    d = daily.aggregate_daily(daily.hourly_indices(fx.hourly(spark, sf)))
    return rounded(
        d.select("cell_id", "date", "wbgt_max", "wbgt_mean", "utci_max", "utci_min", "tmrt_max", "heat_index_max", "t2m_night_min", "wbgt_night_min", "utci_night_min"), 3
    )


QUERIES["hourly_indices_daily"] = (
    hourly_indices_daily,
    with_ctes(
        """, allh AS (SELECT rad.cell_id, rad.ts_ist, rad.t2m, 0.7e0 * tnwb + 0.2e0 * tg + 0.1e0 * rad.t2m AS wbgt, utci, tmrt, heat_index
  FROM rad JOIN globe_out USING (row_id) JOIN wick_out USING (row_id) JOIN uout USING (row_id) JOIN (SELECT row_id, heat_index FROM hi) hi USING (row_id)),
d AS (SELECT cell_id, ts_ist::DATE AS date, max(wbgt) AS wbgt_max, avg(wbgt) AS wbgt_mean, max(utci) AS utci_max, min(utci) AS utci_min,
  max(tmrt) AS tmrt_max, max(heat_index) AS heat_index_max FROM allh GROUP BY 1, 2),
n AS (SELECT cell_id, CASE WHEN hour(ts_ist) >= 22 THEN ts_ist::DATE + 1 ELSE ts_ist::DATE END AS date,
  min(t2m) AS t2m_night_min, min(wbgt) AS wbgt_night_min, min(utci) AS utci_night_min FROM allh WHERE hour(ts_ist) >= 22 OR hour(ts_ist) < 6 GROUP BY 1, 2)
"""
        + pick(["cell_id", "date"], ["wbgt_max", "wbgt_mean", "utci_max", "utci_min", "tmrt_max", "heat_index_max", "t2m_night_min", "wbgt_night_min", "utci_night_min"], "d LEFT JOIN n USING (cell_id, date)", digits=3),
        *SOLVED,
        UTCI_SQL,
        fx.MOIST,
        HI_SQL,
        recursive=True,
    ),
)

# --- daily records -----------------------------------------------------------

_STATS = [f"{c}_{s}" for c in ("t2m", "wbgt", "utci") for s in ("max", "mean", "min")]
DAILY_SQL = """daily AS (SELECT cell_id, ts_ist::DATE AS date, max(t2m) AS t2m_max, avg(t2m) AS t2m_mean, min(t2m) AS t2m_min,
  max(wbgt) AS wbgt_max, avg(wbgt) AS wbgt_mean, min(wbgt) AS wbgt_min, max(utci) AS utci_max, avg(utci) AS utci_mean, min(utci) AS utci_min,
  sum(greatest(wbgt - 28.0e0, 0.0e0)) AS wbgt_degree_hours,
  count(*) FILTER (WHERE wbgt >= 28.0e0) AS wbgt_hours_above_28, count(*) FILTER (WHERE wbgt >= 30.0e0) AS wbgt_hours_above_30,
  count(*) FILTER (WHERE wbgt >= 32.0e0) AS wbgt_hours_above_32, count(*) FILTER (WHERE wbgt >= 35.0e0) AS wbgt_hours_above_35
  FROM moist GROUP BY 1, 2),
nights AS (SELECT cell_id, CASE WHEN hour(ts_ist) >= 22 THEN ts_ist::DATE + 1 ELSE ts_ist::DATE END AS date,
  min(t2m) AS t2m_night_min, min(wbgt) AS wbgt_night_min, min(utci) AS utci_night_min
  FROM moist WHERE hour(ts_ist) >= 22 OR hour(ts_ist) < 6 GROUP BY 1, 2)"""


def daily_records(spark, sf):
    return rounded(daily.aggregate_daily(fx.moist(spark, sf), ("t2m", "wbgt", "utci")))


_HOURS = [f"wbgt_hours_above_{t}" for t in (28, 30, 32, 35)]
QUERIES["daily_records"] = (
    daily_records,
    with_ctes(
        pick(["cell_id", "date", *_HOURS], [*_STATS, "wbgt_degree_hours", "t2m_night_min", "wbgt_night_min", "utci_night_min"], "daily LEFT JOIN nights USING (cell_id, date)"),
        fx.HOURLY, fx.MOIST, DAILY_SQL,
    ),
)

QUERIES["night_minimum"] = (
    lambda spark, sf: rounded(daily.night_minimum(fx.moist(spark, sf))),
    with_ctes(pick(["cell_id", "date"], ["t2m_night_min", "wbgt_night_min", "utci_night_min"], "nights"), fx.HOURLY, fx.MOIST, DAILY_SQL),
)


def risk_band_shares(spark, sf):
    """Flagship: indices hourly first, daily maxima, share of cell-days per risk colour."""
    d = daily.aggregate_daily(fx.moist(spark, sf), ("wbgt",))
    return rounded(daily.band_shares(d.withColumn("risk_colour", heat.wbgt_risk_colour("wbgt_max")), "risk_colour"))


QUERIES["risk_band_shares"] = (
    risk_band_shares,
    with_ctes(
        f""", c AS (SELECT {_case('wbgt_max', heat.RISK_COLOURS, 'Green (Low)')} AS risk_colour FROM daily)
SELECT risk_colour, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM c), 4) + 0.0e0 AS share FROM c GROUP BY 1""",
        fx.HOURLY, fx.MOIST, DAILY_SQL,
    ),
)

QUERIES["hourly_first_vs_daily_first"] = (
    lambda spark, sf: rounded(daily.alert_rate_compare(fx.moist(spark, sf), 33.0)),
    with_ctes(
        f""", d AS (SELECT max(wbgt) AS a, max(t2m) AS t, avg(rh) AS r FROM moist GROUP BY cell_id, ts_ist::DATE),
e AS (SELECT a, {fx.shade('t', 'r')} AS b FROM d)
SELECT count(*) AS cell_days, round(avg((a > 33.0e0)::INT), 4) + 0.0e0 AS hourly_first_rate, round(avg((b > 33.0e0)::INT), 4) + 0.0e0 AS daily_first_rate FROM e""",
        fx.HOURLY, fx.MOIST,
    ),
)

QUERIES["clipping_report"] = (
    lambda spark, sf: daily.clipping_report(fx.moist(spark, sf).withColumn("tmrt", F.col("t2m") + (F.col("row_id") % 130) - 45.0)),
    with_ctes(
        """, x AS (SELECT (t2m + (row_id % 130) - 45.0e0) - t2m AS d, ws10 FROM moist)
SELECT count(*) AS n, count(*) FILTER (WHERE d < -30) AS tmrt_delta_below, count(*) FILTER (WHERE d > 70) AS tmrt_delta_above,
count(*) FILTER (WHERE ws10 < 0.5e0) AS wind_below, count(*) FILTER (WHERE ws10 > 17.0e0) AS wind_above FROM x""",
        fx.HOURLY, fx.MOIST,
    ),
)


def coords_attached(spark, sf):
    m = fx.moist(spark, sf)
    d = m.groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(F.max("t2m").alias("t2m_max"))
    return rounded(daily.attach_coords(d, m))


QUERIES["coords_attached"] = (
    coords_attached,
    with_ctes("SELECT cell_id, ts_ist::DATE AS date, round(max(t2m), 4) + 0.0e0 AS t2m_max, min(lat) AS lat, min(lon) AS lon FROM moist GROUP BY 1, 2", fx.HOURLY, fx.MOIST),
)

# --- legacy daily master table ------------------------------------------------


def _master(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate")
    return l.select(
        F.year("l_shipdate").alias("YEAR"),
        F.dayofyear("l_shipdate").alias("DOY"),
        (F.lit(22.0) + F.col("l_partkey") % 20).alias("T2M_MAX"),
        (F.lit(12.0) + F.col("l_partkey") % 9).alias("T2M_MIN"),
        (F.lit(40.0) + F.col("l_quantity")).alias("RH2M"),
        (F.col("l_discount") * F.lit(50.0)).alias("WS10M"),
        (F.col("l_suppkey") % 30).cast("int").alias("district"),
    )


MASTER_SQL = f"""master AS (SELECT year(l_shipdate) AS y, dayofyear(l_shipdate) AS doy, 22.0e0 + l_partkey % 20 AS tx, 12.0e0 + l_partkey % 9 AS tn,
  40.0e0 + l_quantity AS h, l_discount * 50.0e0 AS w, (l_suppkey % 30)::INTEGER AS district FROM lineitem),
legacy AS (SELECT *, make_date(y, 1, 1) + (doy - 1)::INTEGER AS date, {fx.shade('tx', 'h')} AS wbgt,
  tx + 0.33e0 * (h / 100.0e0 * 6.105e0 * exp(17.27e0 * tx / (237.7e0 + tx))) - 0.70e0 * w - 4.0e0 AS at_c FROM master)"""


def legacy_monthly_mean(spark, sf):
    d = daily.legacy_daily(_master(spark, sf))
    return rounded(
        d.groupBy("district", "month").agg(
            F.avg("WBGT").alias("wbgt_mean"), F.avg("AT_C").alias("at_mean"), F.avg("T2M_MEAN").alias("t2m_mean"),
            F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        )
    )


QUERIES["legacy_monthly_mean"] = (
    legacy_monthly_mean,
    with_ctes(
        "SELECT district, month(date)::INTEGER AS month, round(avg(wbgt), 4) + 0.0e0 AS wbgt_mean, round(avg(at_c), 4) + 0.0e0 AS at_mean, round(avg((tx + tn) / 2.0e0), 4) + 0.0e0 AS t2m_mean, min(date) AS first_date, max(date) AS last_date FROM legacy GROUP BY 1, 2",
        MASTER_SQL,
    ),
)


def red_days(spark, sf):
    d = daily.legacy_daily(_master(spark, sf))
    return d.where("WBGT_Risk = 'Red (Severe/Extreme)'").groupBy("district").agg(F.count("*").alias("red_days"))


QUERIES["red_days"] = (red_days, with_ctes("SELECT district, count(*) AS red_days FROM legacy WHERE wbgt >= 35.0e0 GROUP BY 1", MASTER_SQL))


def profile(spark, sf):
    from heatgrid.operators.metrics import profile as describe

    li = table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    return rounded(describe(li, ["l_quantity", "l_discount", "l_tax"]))


_PROFILE = "SELECT '{c}' AS column_name, (count(*) - count({c}))::DOUBLE AS nulls, count({c})::DOUBLE AS n, round(avg({c}), 4) + 0.0e0 AS mean, round(stddev_samp({c}), 4) + 0.0e0 AS std, min({c}) AS min, max({c}) AS max FROM li"
QUERIES["profile"] = (
    profile,
    with_ctes(" UNION ALL ".join(_PROFILE.format(c=c) for c in ("l_quantity", "l_discount", "l_tax")),
              "li AS (SELECT l_quantity, l_discount, CASE WHEN l_tax > 0.01e0 THEN l_tax END AS l_tax FROM lineitem)"),
)

# --- ingest ------------------------------------------------------------------


def cell_numbering(spark, sf):
    h = fx.hourly(spark, sf).select("lat", "lon")
    return ingest.cell_ids(h)


QUERIES["cell_numbering"] = (
    cell_numbering,
    with_ctes("SELECT lat, lon, (dense_rank() OVER (ORDER BY lat, lon) - 1)::INTEGER AS cell_id FROM (SELECT DISTINCT lat, lon FROM hourly)", fx.HOURLY),
)


def time_standard(spark, sf):
    """File stamps to UTC by a measured offset, then to Indian time."""
    e = table(spark, sf, "events")
    stamp = F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyyMMddHH"))
    t = e.select("event_id", stamp.alias("stamp"), (F.lit(5) + F.col("user_id") % 2).alias("offset_h"), F.to_date("ts").alias("d"))
    utc = t.withColumn("ts_utc", calendar.stamp_to_utc("stamp", "offset_h"))
    out = utc.withColumn("ts_ist", calendar.utc_to_ist("ts_utc"))
    return out.select(
        "event_id",
        F.date_format("ts_utc", "yyyy-MM-dd HH:mm").alias("utc"),
        F.date_format("ts_ist", "yyyy-MM-dd HH:mm").alias("ist"),
        calendar.leap_folded_doy("d").alias("doy"),
        calendar.ist_iso("ts_utc").alias("iso"),
    )


QUERIES["time_standard"] = (
    time_standard,
    f"""WITH s AS (SELECT event_id, ts::DATE AS d, CASE WHEN event_id % 50 <> 0 THEN date_trunc('hour', ts) - to_hours((5 + user_id % 2)::INTEGER) END AS u FROM events)
SELECT event_id, strftime(u, '%Y-%m-%d %H:%M') AS utc, strftime(u + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS ist, {fx.doy('d')}::INTEGER AS doy,
strftime(u + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS iso FROM s""",
)


def leap_days(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", calendar.leap_folded_doy("d").alias("doy"), calendar.date_of_year_day(F.year("d"), F.dayofyear("d")).alias("date"))


QUERIES["leap_days"] = (leap_days, f"SELECT o_orderkey, {fx.doy('o_orderdate')}::INTEGER AS doy, o_orderdate::DATE AS date FROM orders")


def utc_offsets(spark, sf):
    """Offsets measured from the irradiance phase, one cell per order bucket."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    hours = o.select(
        (F.col("o_custkey") % 20).cast("int").alias("cell_id"),
        (F.lit(81.5) + (F.col("o_custkey") % 20) * F.lit(0.25)).alias("lon"),
        F.dayofyear("d").alias("doy"),
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"),
        "o_orderkey",
    )
    noon = F.lit(12.0) - F.col("lon") / F.lit(15.0) + F.lit(5.0) + F.when(F.col("cell_id") >= 10, F.lit(1.0)).otherwise(F.lit(0.0))
    phase = (F.col("hour") + F.lit(0.5) - noon) / F.lit(12.0)
    sw = F.greatest(F.lit(0.0), F.lit(900.0) * F.cos(F.lit(3.141592653589793) * phase)) * (F.lit(1.0) + F.col("o_orderkey") % 3)
    measured = ingest.measure_offset(hours.withColumn("sw", F.when(F.col("hour") == 3, F.lit(None)).otherwise(sw)))
    return rounded(ingest.calibrate_offsets(measured, strict=False))


QUERIES["utc_offsets"] = (
    utc_offsets,
    f"""WITH h AS (SELECT (o_custkey % 20)::INTEGER AS cell_id, 81.5e0 + (o_custkey % 20) * 0.25e0 AS lon, dayofyear(o_orderdate) AS doy, x.hh, o_orderkey
  FROM orders, (SELECT unnest(range(0, 24)) AS hh) x),
n AS (SELECT *, 12.0e0 - lon / 15.0e0 + 5.0e0 + CASE WHEN cell_id >= 10 THEN 1.0e0 ELSE 0.0e0 END AS noon FROM h),
s AS (SELECT *, CASE WHEN hh = 3 THEN 0.0e0 ELSE greatest(0.0e0, 900.0e0 * cos(3.141592653589793e0 * ((hh + 0.5e0 - noon) / 12.0e0))) * (1.0e0 + o_orderkey % 3) END AS sw FROM n),
d AS (SELECT cell_id, lon, doy, sum(sw * (hh + 0.5e0)) AS num, sum(sw) AS den FROM s GROUP BY 1, 2, 3),
c AS (SELECT cell_id, lon, median(num / den) AS centroid, count(*) AS daylight_days FROM d WHERE den > 0 GROUP BY 1, 2),
years AS (SELECT cell_id, median(12.0e0 - lon / 15.0e0 - 229.18e0 * {_fourier('(2.0e0 * pi() * (dd - 1.0e0) / 365.0e0)', solar.EQUATION_OF_TIME)} / 60.0e0) AS noon FROM c, (SELECT unnest(range(1, 366)) AS dd) GROUP BY 1),
m AS (SELECT cell_id, daylight_days, centroid - noon AS measured_h FROM c JOIN years USING (cell_id))
SELECT cell_id, daylight_days, round(measured_h, 4) + 0.0e0 AS measured_h, round_even(measured_h, 0)::INTEGER AS offset_h,
round(abs(measured_h - round_even(measured_h, 0)), 4) + 0.0e0 AS residual_h, abs(measured_h - round_even(measured_h, 0)) > 0.25e0 AS ambiguous FROM m""",
)


def _weather_with_faults(spark, sf):
    h = fx.hourly(spark, sf)
    fault = {
        "T2M": F.when(F.col("row_id") % 17 == 0, F.lit(-999.0)).when(F.col("row_id") % 23 == 0, F.lit(75.0)).otherwise(F.col("T2M")),
        "PS": F.when(F.col("row_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("PS")),
        "ALLSKY_SFC_SW_DWN": F.when(F.col("row_id") % 29 == 0, F.lit(5.0)).otherwise(F.col("ALLSKY_SFC_SW_DWN")),
        "year": F.year("ts_ist"),
    }
    return ingest.without_fill_value(h.withColumns(fault))


FAULTS_SQL = f"""faults AS (SELECT cell_id, ts_ist, year(ts_ist) AS year,
  CASE WHEN row_id % 17 = 0 THEN NULL WHEN row_id % 23 = 0 THEN 75.0e0 ELSE t2m END AS t2m, td, ws10, {fx.rh('t2m', 'td')} AS rh,
  CASE WHEN row_id % 19 = 0 THEN NULL ELSE ps END AS ps, CASE WHEN row_id % 29 = 0 THEN 5.0e0 ELSE ghi END AS ghi FROM hourly)"""
_QC = [("T2M", "t2m", -20, 60), ("RH2M", "rh", 0, 100), ("T2MDEW", "td", -30, 45), ("PS", "ps", 80, 110), ("WS10M", "ws10", 0, 60), ("ALLSKY_SFC_SW_DWN", "ghi", 0, 1400)]
QC_SQL = (
    "qc AS (SELECT cell_id, year::INTEGER AS year, count(*) AS rows, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {n}_nan, count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS {n}_out_of_range" for n, c, lo, hi in _QC)
    + ", count(*) FILTER (WHERE td > t2m + 0.1e0) AS dewpoint_exceeds_temp, count(*) FILTER (WHERE (hour(ts_ist) >= 23 OR hour(ts_ist) <= 1) AND ghi > 1.0e0) AS irradiance_at_midnight,"
    " (CASE WHEN year % 4 = 0 THEN 8784 ELSE 8760 END)::BIGINT AS rows_expected FROM faults GROUP BY cell_id, year)"
)
QUERIES["qc_report"] = (
    lambda spark, sf: ingest.qc_report(_weather_with_faults(spark, sf)),
    with_ctes("SELECT *, rows - rows_expected AS rows_delta FROM qc", fx.HOURLY, FAULTS_SQL, QC_SQL),
)


def qc_report_csv(spark, sf):
    """The report as a CSV file and back."""
    report, path = ingest.qc_report(_weather_with_faults(spark, sf)), scratch_path(spark, "qc")
    weather_source.write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


QUERIES["qc_report_csv"] = (qc_report_csv, QUERIES["qc_report"][1])

_QC_COLS = [f"{n}_{k}" for n, *_ in _QC for k in ("nan", "out_of_range")] + ["dewpoint_exceeds_temp", "irradiance_at_midnight"]
QUERIES["qc_summary"] = (
    lambda spark, sf: ingest.qc_summary(ingest.qc_report(_weather_with_faults(spark, sf))),
    with_ctes(
        "SELECT count(*) AS cell_years, count(*) FILTER (WHERE rows <> rows_expected) AS wrong_row_count, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in _QC_COLS) + " FROM qc",
        fx.HOURLY, FAULTS_SQL, QC_SQL,
    ),
)


def _inventory(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 11 <> 0")
    return o.select(
        (F.lit(17.5) + (F.col("o_custkey") % 30) * F.lit(0.25)).alias("lat"),
        (F.lit(81.5) + F.floor(F.col("o_custkey") / 30) * F.lit(0.25)).alias("lon"),
        F.year("o_orderdate").alias("year"),
    )


INVENTORY_SQL = "inv AS (SELECT DISTINCT 17.5e0 + (o_custkey % 30) * 0.25e0 AS lat, 81.5e0 + (o_custkey // 30) * 0.25e0 AS lon, year(o_orderdate)::INTEGER AS year FROM orders WHERE o_orderkey % 11 <> 0)"
QUERIES["missing_members"] = (
    lambda spark, sf: ingest.missing_members(_inventory(spark, sf)),
    with_ctes("SELECT lat, lon, year FROM (SELECT DISTINCT lat, lon FROM inv), (SELECT DISTINCT year FROM inv) EXCEPT SELECT lat, lon, year FROM inv", INVENTORY_SQL),
)


def _gappy(spark, sf):
    """Hourly panel where every seventh cell of the lattice has no file."""
    h = fx.hourly(spark, sf)
    hour = F.date_trunc("hour", "ts_utc")
    by_hour = h.groupBy("cell_id", "lat", "lon", hour.alias("ts_utc")).agg(
        *[F.avg(c).alias(c) for c in ("T2M", "RH2M", "T2MDEW", "PS", "WS10M", "ALLSKY_SFC_SW_DWN")]
    )
    days = by_hour.withColumn("ts_utc", F.date_trunc("day", "ts_utc")).groupBy("cell_id", "lat", "lon", "ts_utc").agg(
        *[F.avg(c).alias(c) for c in ("T2M", "RH2M", "T2MDEW", "PS", "WS10M", "ALLSKY_SFC_SW_DWN")]
    )
    return days.withColumn("year", F.lit(2024))


def gap_filling(spark, sf):
    panel = _gappy(spark, sf)
    cells = panel.select("cell_id", "lat", "lon").distinct()
    have = panel.where("cell_id % 7 <> 3")
    missing = cells.where("cell_id % 7 = 3").select("lat", "lon", F.lit(2024).alias("year"))
    filled = ingest.fill_missing_cells(have, missing, cells)
    return rounded(filled.select("cell_id", F.to_date("ts_utc").alias("day"), "T2M", "PS", "is_interpolated"))


QUERIES["gap_filling"] = (
    gap_filling,
    with_ctes(
        """, hh AS (SELECT cell_id, lat, lon, date_trunc('hour', ts_utc) AS u, avg(t2m) AS t2m, avg(ps) AS ps FROM hourly GROUP BY 1, 2, 3, 4),
dd AS (SELECT cell_id, lat, lon, u::DATE AS day, avg(t2m) AS t2m, avg(ps) AS ps FROM hh GROUP BY 1, 2, 3, 4),
c AS (SELECT DISTINCT cell_id, lat, lon FROM dd),
nn AS (SELECT a.cell_id AS tid, b.cell_id AS cid, sqrt((b.lat - a.lat) ** 2 + (b.lon - a.lon) ** 2) AS d,
  row_number() OVER (PARTITION BY a.cell_id ORDER BY sqrt((b.lat - a.lat) ** 2 + (b.lon - a.lon) ** 2), b.cell_id) AS rk
  FROM c a JOIN c b ON a.cell_id % 7 = 3 AND b.cell_id % 7 <> 3),
w AS (SELECT tid, cid, rk, (1.0e0 / d) / sum(1.0e0 / d) OVER (PARTITION BY tid) AS w FROM nn WHERE rk <= 4),
j AS (SELECT tid, day, bool_or(rk = 1) AS ongrid, CASE WHEN count(*) = 4 THEN sum(w * t2m) END AS t2m, CASE WHEN count(*) = 4 THEN sum(w * ps) END AS ps FROM w JOIN dd ON dd.cell_id = cid GROUP BY 1, 2)
SELECT tid AS cell_id, day, round(t2m, 4) + 0.0e0 AS "T2M", round(ps, 4) + 0.0e0 AS "PS", true AS is_interpolated FROM j WHERE ongrid""",
        fx.HOURLY,
    ),
)

# --- climatology and the index -------------------------------------------------

_V2 = ("wbgt_max", "wbgt_night_min")
QUERIES["climatology"] = (
    lambda spark, sf: rounded(climatology.build_climatology(fx.panel(spark, sf), _V2)),
    with_ctes(pick(["cell_id", "doy"], [f"{v}_p{p}" for v in _V2 for p in (50, 90, 95, 98)], "clim"), fx.PANEL, fx.PANEL_DOY, fx.clim_sql(_V2)),
)

QUERIES["anomaly_rank"] = (
    lambda spark, sf: rounded(
        climatology.attach_anomaly(fx.panel(spark, sf), climatology.build_climatology(fx.panel(spark, sf), ("wbgt_max",))).select("cell_id", "date", "wbgt_max", "wbgt_max_p90", "wbgt_max_pct_rank")
    ),
    with_ctes(pick(["cell_id", "date"], ["wbgt_max", "wbgt_max_p90", "wbgt_max_pct_rank"], "indexed"), *fx.INDEX_CTES),
)

_PARTS = ["htsi_gate", "htsi_intensity", "htsi_anomaly", "htsi_night", "htsi_duration", "htsi"]
QUERIES["stress_index"] = (
    lambda spark, sf: rounded(fx.indexed(spark, sf).select("cell_id", "date", "spell_days", "htsi_band", *_PARTS)),
    with_ctes(pick(["cell_id", "date", "spell_days", "htsi_band"], _PARTS, "indexed"), *fx.INDEX_CTES),
)


def spells_by_calendar(spark, sf):
    """Hot spells on event days, once by rows and once by the calendar."""
    m = fx.moist(spark, sf).groupBy("cell_id", F.to_date("ts_ist").alias("date")).agg(F.max("wbgt").alias("w"))
    hot = F.col("w") >= 27.0
    rows = climatology.spell_length(m, hot, name="rows_spell")
    return climatology.spell_length(rows, hot, name="calendar_spell", calendar=True).select("cell_id", "date", "rows_spell", "calendar_spell")


QUERIES["spells_by_calendar"] = (
    spells_by_calendar,
    with_ctes(
        """, d AS (SELECT cell_id, ts_ist::DATE AS date, CASE WHEN max(wbgt) >= 27.0e0 THEN 1 ELSE 0 END AS hot FROM moist GROUP BY 1, 2),
g AS (SELECT *, sum(1 - hot) OVER w AS a, lag(date) OVER w AS p FROM d WINDOW w AS (PARTITION BY cell_id ORDER BY date)),
k AS (SELECT *, sum(CASE WHEN hot = 0 OR date - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY date) AS b FROM g)
SELECT cell_id, date, (sum(hot) OVER (PARTITION BY cell_id, a ORDER BY date))::INTEGER AS rows_spell, (sum(hot) OVER (PARTITION BY cell_id, b ORDER BY date))::INTEGER AS calendar_spell FROM k""",
        fx.HOURLY, fx.MOIST,
    ),
)

EHF_SQL = """three AS (SELECT *, CASE WHEN count(t2m_mean) OVER a = 3 THEN avg(t2m_mean) OVER a END AS m3,
  CASE WHEN count(t2m_mean) OVER b = 30 THEN avg(t2m_mean) OVER b END AS m30 FROM panel
  WINDOW a AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 32 PRECEDING AND 3 PRECEDING)),
p95 AS (SELECT cell_id, quantile_cont(t2m_mean, 0.95) AS p95 FROM panel GROUP BY 1)"""
QUERIES["excess_heat_factor"] = (
    lambda spark, sf: rounded(climatology.excess_heat_factor(fx.panel(spark, sf)).select("cell_id", "date", "ehi_sig", "ehi_accl", "ehf")),
    with_ctes(
        pick(["cell_id", "date"], ["m3 - p95 AS ehi_sig", "m3 - m30 AS ehi_accl", "CASE WHEN m30 IS NULL THEN NULL ELSE (m3 - p95) * greatest(1.0e0, m3 - m30) END AS ehf"], "three JOIN p95 USING (cell_id)"),
        fx.PANEL, EHF_SQL,
    ),
)

MEANS_SQL = """tr AS (SELECT cell_id, doy, avg(htsi) AS m FROM indexed WHERE date <= DATE '1999-12-31' GROUP BY 1, 2),
cm AS (SELECT cell_id, avg(m) AS cm FROM tr GROUP BY 1),
dense AS (SELECT cm.cell_id, d.d AS doy, coalesce(tr.m, cm.cm) AS m FROM cm CROSS JOIN (SELECT unnest(range(1, 366)) AS d) d LEFT JOIN tr ON tr.cell_id = cm.cell_id AND tr.doy = d.d),
means AS (SELECT cell_id, ((doy - 1 + o.o + 365) % 365 + 1)::INTEGER AS doy, avg(m) AS clim_htsi FROM dense, (SELECT unnest(range(-7, 8)) AS o) o GROUP BY 1, 2)"""
QUERIES["climatology_means"] = (
    lambda spark, sf: rounded(climatology.climatology_means(fx.indexed(spark, sf), "1999-12-31")),
    with_ctes(pick(["cell_id", "doy"], ["clim_htsi"], "means"), *fx.INDEX_CTES, MEANS_SQL),
)


def edge_calibration(spark, sf):
    from heatgrid.operators.index import calibrate_edges

    return rounded(calibrate_edges(fx.indexed(spark, sf)))


QUERIES["edge_calibration"] = (
    edge_calibration,
    with_ctes(pick([], [f"quantile_cont(htsi, {p}) AS edge_p{int(p * 100)}" for p in (0.90, 0.97, 0.99)], "indexed", "WHERE month(date) IN (3, 4, 5, 6)"), *fx.INDEX_CTES),
)


def top_days_by_season(spark, sf):
    from heatgrid.operators.index import top_share_by_season

    return rounded(top_share_by_season(fx.indexed(spark, sf)))


QUERIES["top_days_by_season"] = (
    top_days_by_season,
    with_ctes(
        ", cut AS (SELECT quantile_cont(htsi, 0.99) AS c FROM indexed) SELECT quarter(date)::INTEGER AS quarter, count(*) AS days, round(avg((htsi >= c)::INT), 4) + 0.0e0 AS top_share FROM indexed, cut GROUP BY 1",
        *fx.INDEX_CTES,
    ),
)


def scaling_curves(spark, sf):
    """Every piecewise scaling over the events' values."""
    e = table(spark, sf, "events").select("event_id", (F.col("value") % 60.0 / F.lit(1.01)).alias("v"), (F.col("event_id") % 12).alias("s"))
    return rounded(
        e.select(
            "event_id",
            scaling.scale_intensity("v").alias("intensity"),
            scaling.scale_anomaly(F.col("v") * 1.7).alias("anomaly"),
            scaling.scale_night_relief("v").alias("night"),
            scaling.scale_duration("s").alias("duration"),
            scaling.physiological_gate("v").alias("gate"),
            scaling.stress_band(F.col("v") * 1.2).alias("band"),
            scaling.probability_exceeding(F.col("v") - 5, "v", F.col("v") + 7, 30.0).alias("p_exceed"),
        )
    )


QUERIES["scaling_curves"] = (
    scaling_curves,
    with_ctes(
        pick(
            ["event_id", fx.band_sql("(v * 1.2e0)") + " AS band"],
            [
                f"({fx.intensity_sql('v')}) AS intensity",
                f"({fx.ANOMALY.replace('{x}', '(v * 1.7e0)')}) AS anomaly",
                f"({fx.night_sql('v')}) AS night",
                "least(greatest(100.0e0 * (1.0e0 - exp(-1.6e0 * (s / 5.0e0))), 0.0e0), 100.0e0) AS duration",
                "least(greatest((v - 27.0e0) / 4.0e0, 0.0e0), 1.0e0) AS gate",
                "1.0e0 - least(greatest(CASE WHEN 30.0e0 <= v THEN 0.5e0 - (v - 30.0e0) * 0.4e0 / 5.0e0 ELSE 0.5e0 + (30.0e0 - v) * 0.4e0 / 7.0e0 END, 0.0e0), 1.0e0) AS p_exceed",
            ],
            "e",
        ),
        "e AS (SELECT event_id, value % 60.0e0 / 1.01e0 AS v, event_id % 12 AS s FROM events)",
    ),
)
