"""Views that give the supplied tables the shape of the operators' inputs.

Each view is plain arithmetic on table columns, so that Spark and another SQL
engine derive the same rows. Tables grow, and the views grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.functions import calendar, heat, psychro, scaling
from heatgrid.functions.base import clip
from heatgrid.operators.climatology import attach_anomaly, build_climatology
from heatgrid.operators.index import compute_index
from heatgrid.plans.common import table
from heatgrid.session import cut_lineage

#: Customers for each cell of the panel, and its fewest cells: the lattice grows with the tables.
CUSTOMERS_A_CELL, FEWEST_CELLS = 37, 10


def n_cells(spark: SparkSession, sf: str) -> int:
    """Cells of the panel; the count comes from the table's footers."""
    return max(table(spark, sf, "customer").count() // CUSTOMERS_A_CELL, FEWEST_CELLS)


N_CELLS = f"(SELECT greatest(count(*) // {CUSTOMERS_A_CELL}, {FEWEST_CELLS}) FROM customer)"


def _mod(c: str, factor: int, mod: int = 997) -> Column:
    return (F.col(c) * F.lit(factor)) % F.lit(mod)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly weather from ``events``: one observation per event, cell = user."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    t = F.lit(10.0) + F.lit(24.0) * _mod("event_id", 37) / F.lit(997.0)
    hour = F.hour("ts") + F.minute("ts") / F.lit(60.0)
    sun = F.greatest(F.lit(0.0), F.lit(950.0) * F.sin(F.lit(3.141592653589793) * (hour - F.lit(6.0)) / F.lit(12.0)))
    base = e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("int").alias("cell_id"),
        (F.lit(17.5) + (F.col("user_id") % 20) * F.lit(0.25)).alias("lat"),
        (F.lit(81.5) + F.floor(F.col("user_id") / 20) * F.lit(0.25)).alias("lon"),
        F.col("ts").alias("ts_ist"),
        calendar.ist_to_utc("ts").alias("ts_utc"),
        t.alias("T2M"),
        (t - F.lit(24.0) * _mod("event_id", 53) / F.lit(997.0)).alias("T2MDEW"),
        (F.lit(8.0) * _mod("event_id", 71) / F.lit(997.0)).alias("WS10M"),
        (F.lit(98.0) + F.lit(4.0) * _mod("event_id", 13) / F.lit(997.0)).alias("PS"),
        sun.alias("ALLSKY_SFC_SW_DWN"),
    )
    return base.withColumn("RH2M", psychro.relative_humidity("T2M", "T2MDEW"))


HOURLY = """hourly AS (
  SELECT event_id AS row_id, user_id::INTEGER AS cell_id,
         17.5e0 + (user_id % 20) * 0.25e0 AS lat, 81.5e0 + (user_id // 20) * 0.25e0 AS lon,
         ts AS ts_ist, ts - INTERVAL 330 MINUTE AS ts_utc,
         10.0e0 + 24.0e0 * ((event_id * 37) % 997) / 997.0e0 AS t2m,
         10.0e0 + 24.0e0 * ((event_id * 37) % 997) / 997.0e0 - 24.0e0 * ((event_id * 53) % 997) / 997.0e0 AS td,
         8.0e0 * ((event_id * 71) % 997) / 997.0e0 AS ws10,
         98.0e0 + 4.0e0 * ((event_id * 13) % 997) / 997.0e0 AS ps,
         greatest(0.0e0, 950.0e0 * sin(3.141592653589793e0 * (extract(hour FROM ts) + extract(minute FROM ts) / 60.0e0 - 6.0e0) / 12.0e0)) AS ghi
  FROM events)"""


def svp(t: str) -> str:
    return f"(0.61121e0 * exp((18.678e0 - ({t}) / 234.5e0) * (({t}) / (257.14e0 + ({t})))))"


def rh(t: str, td: str) -> str:
    return f"least(greatest(100.0e0 * {svp(f'least({td}, {t})')} / {svp(t)}, 0.0e0), 100.0e0)"


def shade(t: str, h: str) -> str:
    return f"(0.567e0 * {t} + 0.393e0 * (({h}) / 100.0e0 * 6.105e0 * exp(17.27e0 * {t} / (237.7e0 + {t}))) + 3.94e0)"


def moist(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows with humidity and the shade index standing in for WBGT."""
    return hourly(spark, sf).select(
        "row_id", "cell_id", "lat", "lon", "ts_ist", F.col("T2M").alias("t2m"), F.col("WS10M").alias("ws10"), F.col("RH2M").alias("rh"),
    ).withColumn("wbgt", heat.wbgt_shade("t2m", "rh")).withColumns(
        {"utci": F.col("wbgt") + F.lit(4.0), "heat_index": heat.heat_index("t2m", "rh")}
    )


MOIST = f"""moist0 AS (SELECT row_id, cell_id, lat, lon, ts_ist, t2m, ws10, {rh('t2m', 'td')} AS rh FROM hourly),
moist AS (SELECT *, {shade('t2m', 'rh')} AS wbgt, {shade('t2m', 'rh')} + 4.0e0 AS utci FROM moist0)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily cell records from ``orders``: seven years of days on a lattice that grows with the customers."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    price = F.col("o_totalprice")
    return o.groupBy(
        (F.col("o_custkey") % n_cells(spark, sf)).cast("int").alias("cell_id"), F.to_date("o_orderdate").alias("date")
    ).agg(
        F.max(F.lit(24.0) + (price % F.lit(2000.0)) / F.lit(101.0)).alias("t2m_max"),
        F.avg(F.lit(20.0) + (price % F.lit(1500.0)) / F.lit(101.0)).alias("t2m_mean"),
        F.max(F.lit(26.0) + (price % F.lit(2400.0)) / F.lit(101.0)).alias("utci_max"),
        F.max(F.lit(24.0) + (price % F.lit(1300.0)) / F.lit(101.0)).alias("wbgt_max"),
        F.min(F.lit(20.0) + (price % F.lit(1100.0)) / F.lit(101.0)).alias("wbgt_night_min"),
    )


PANEL = f"""panel AS (
  SELECT (o_custkey % {N_CELLS})::INTEGER AS cell_id, o_orderdate::DATE AS date,
         max(24.0e0 + (o_totalprice % 2000.0e0) / 101.0e0) AS t2m_max,
         avg(20.0e0 + (o_totalprice % 1500.0e0) / 101.0e0) AS t2m_mean,
         max(26.0e0 + (o_totalprice % 2400.0e0) / 101.0e0) AS utci_max,
         max(24.0e0 + (o_totalprice % 1300.0e0) / 101.0e0) AS wbgt_max,
         min(20.0e0 + (o_totalprice % 1100.0e0) / 101.0e0) AS wbgt_night_min
  FROM orders GROUP BY 1, 2)"""

DOY_SQL = (
    "(dayofyear({d}) - CASE WHEN dayofyear(make_date(year({d}), 12, 31)) = 366 AND dayofyear({d}) > 59 THEN 1 ELSE 0 END)"
)


def doy(d: str) -> str:
    return DOY_SQL.format(d=d)


PANEL_DOY = f"panel_doy AS (SELECT *, {doy('date')}::INTEGER AS doy FROM panel)"


def clim_sql(values=("wbgt_max",), pcts=(50, 90, 95, 98)) -> str:
    """Fan-out form of the climatology: every record serves 31 days of year."""
    cols = ", ".join(f"quantile_cont({v}, {p / 100}) AS {v}_p{p}" for v in values for p in pcts)
    return f"""fan AS (
  SELECT cell_id, ((doy - 1 + o.o + 365) % 365 + 1)::INTEGER AS doy, {', '.join(values)}
  FROM panel_doy, (SELECT unnest(range(-15, 16)) AS o) o),
pooled AS (SELECT cell_id, doy, {cols} FROM fan GROUP BY 1, 2),
frame AS (SELECT cell_id, d.d::INTEGER AS doy FROM (SELECT DISTINCT cell_id FROM panel), (SELECT unnest(range(1, 366)) AS d) d),
clim AS (SELECT frame.cell_id, frame.doy, pooled.* EXCLUDE (cell_id, doy) FROM frame LEFT JOIN pooled USING (cell_id, doy))"""


def interp_sql(x: str, knots) -> str:
    out = [f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {knots[0][0]}e0 THEN {knots[0][1]}e0"]
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out.append(f"WHEN {x} <= {x1}e0 THEN {y0}e0 + ({y1}e0 - {y0}e0) / ({x1}e0 - ({x0}e0)) * ({x} - ({x0}e0))")
    return " ".join(out) + f" ELSE {knots[-1][1]}e0 END"


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {lo}e0), {hi}e0) END"


RANK_SQL = """CASE WHEN wbgt_max IS NULL OR wbgt_max_p50 IS NULL THEN NULL ELSE least(greatest(
  CASE WHEN wbgt_max <= wbgt_max_p50 THEN 50.0e0 * wbgt_max / greatest(wbgt_max_p50, 1e-6)
       WHEN wbgt_max <= wbgt_max_p90 THEN 50.0e0 + 40.0e0 * (wbgt_max - wbgt_max_p50) / greatest(wbgt_max_p90 - wbgt_max_p50, 1e-6)
       WHEN wbgt_max <= wbgt_max_p95 THEN 90.0e0 + 5.0e0 * (wbgt_max - wbgt_max_p90) / greatest(wbgt_max_p95 - wbgt_max_p90, 1e-6)
       WHEN wbgt_max <= wbgt_max_p98 THEN 95.0e0 + 3.0e0 * (wbgt_max - wbgt_max_p95) / greatest(wbgt_max_p98 - wbgt_max_p95, 1e-6)
       ELSE 98.0e0 + 2.0e0 * (wbgt_max - wbgt_max_p98) / greatest(wbgt_max_p98 - wbgt_max_p95, 1e-6) END, 0.0e0), 100.0e0) END"""

BAND_SQL = "CASE WHEN {x} >= 63.5e0 THEN 'Emergency' WHEN {x} >= 59.5e0 THEN 'Warning' WHEN {x} >= 48.5e0 THEN 'Watch' ELSE 'Normal' END"


def band_sql(x: str) -> str:
    return BAND_SQL.format(x=x)


NIGHT_SQL = clip_sql("({x} - 26.0e0) / 6.0e0 * 100.0e0", 0.0, 100.0)


def night_sql(x: str) -> str:
    return NIGHT_SQL.replace("{x}", x)


INTENSITY = interp_sql("{x}", scaling.INTENSITY_KNOTS)
ANOMALY = interp_sql("{x}", scaling.ANOMALY_KNOTS)


def intensity_sql(x: str) -> str:
    return INTENSITY.replace("{x}", x)


INDEXED = f"""ranked AS (SELECT panel_doy.*, clim.* EXCLUDE (cell_id, doy), {RANK_SQL} AS wbgt_max_pct_rank
  FROM panel_doy LEFT JOIN clim USING (cell_id, doy)),
flagged AS (SELECT *, CASE WHEN wbgt_max >= wbgt_max_p90 THEN 1 ELSE 0 END AS hot FROM ranked),
islands AS (SELECT *, sum(1 - hot) OVER (PARTITION BY cell_id ORDER BY date) AS island FROM flagged),
spelled AS (SELECT *, (sum(hot) OVER (PARTITION BY cell_id, island ORDER BY date))::INTEGER AS spell_days FROM islands),
gated AS (SELECT *, {clip_sql('(wbgt_max - 27.0e0) / 4.0e0', 0.0, 1.0)} AS htsi_gate,
  {intensity_sql('utci_max')} AS htsi_intensity,
  {night_sql('coalesce(wbgt_night_min, 0.0e0)')} AS htsi_night FROM spelled),
parts AS (SELECT *, ({ANOMALY.replace('{x}', 'wbgt_max_pct_rank')}) * htsi_gate AS htsi_anomaly,
  least(greatest(100.0e0 * (1.0e0 - exp(-1.6e0 * (spell_days / 5.0e0))), 0.0e0), 100.0e0) * htsi_gate AS htsi_duration FROM gated),
scored AS (SELECT *, 0.5e0 * htsi_intensity + 0.2e0 * htsi_anomaly + 0.2e0 * htsi_night + 0.1e0 * htsi_duration AS htsi FROM parts),
indexed AS (SELECT *, {band_sql('htsi')} AS htsi_band FROM scored)"""

INDEX_CTES = (PANEL, PANEL_DOY, clim_sql(), INDEXED)


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with climatology, anomaly rank, components, index and band."""
    daily = cut_lineage(panel(spark, sf))  # feeds the climatology and the index
    return compute_index(attach_anomaly(daily, build_climatology(daily, ("wbgt_max",))))


# Cells of the panel: lattice position and district by arithmetic on the id.


def panel_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Cell of every order: the cells of the panel, many times over."""
    return table(spark, sf, "orders").select((F.col("o_custkey") % n_cells(spark, sf)).cast("int").alias("cell_id"))


def panel_cells(df: DataFrame) -> DataFrame:
    c = F.col("cell_id")
    return df.select("cell_id").distinct().select(
        "cell_id",
        (F.lit(18.0) + (c % 8) * F.lit(0.25)).alias("lat"),
        (F.lit(83.0) + F.floor(c / 8) * F.lit(0.25)).alias("lon"),
        (c % 10 + 1).cast("int").alias("ahs_code"),
    )


PANEL_CELLS_SQL = """panel_cells AS (
  SELECT cell_id, 18.0e0 + (cell_id % 8) * 0.25e0 AS lat, 83.0e0 + (cell_id // 8) * 0.25e0 AS lon,
         (cell_id % 10 + 1)::INTEGER AS ahs_code
  FROM (SELECT DISTINCT cell_id FROM panel))"""


# --- people ------------------------------------------------------------------


def districts_sql() -> str:
    from heatgrid.operators.places import DISTRICTS

    rows = []
    for code, name, _, _, _, _, _, pop, c_lat, c_lon, area, _ in DISTRICTS:
        rows.append(f"({code}, '{name}', {pop}, {c_lat}e0, {c_lon}e0, {area})")
    return "districts(ahs_code, district, pop_2011, c_lat, c_lon, area_km2) AS (VALUES " + ", ".join(rows) + ")"


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("cell_id", "lat", "lon").distinct()


EVENT_CELLS = "event_cells AS (SELECT DISTINCT cell_id, lat, lon FROM hourly)"


def wards(spark: SparkSession, sf: str) -> DataFrame:
    """Wards from ``customer``: spread over the lattice, city = nation."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name")
    return c.select(
        F.col("c_custkey").alias("ward_id"),
        F.col("c_name").alias("ward_name"),
        F.col("c_nationkey").alias("city"),
        (F.col("c_nationkey") + 1).alias("ahs_code"),
        (F.lit(17.5) + F.lit(4.5) * _mod("c_custkey", 37) / F.lit(997.0)).alias("lat"),
        (F.lit(81.5) + F.lit(1.7) * _mod("c_custkey", 53, 991) / F.lit(991.0)).alias("lon"),
        (F.lit(1000.0) + F.col("c_custkey") * F.lit(17.0)).alias("population"),
        (_mod("c_custkey", 1, 23) * F.lit(0.7)).alias("elderly_pct"),
        F.when(F.col("c_custkey") % 9 != 0, _mod("c_custkey", 1, 31) * F.lit(1.1)).alias("slum_pop_pct"),
        (_mod("c_custkey", 1, 11) / F.lit(11.0)).alias("built_up_frac"),
        (F.lit(0.75) + F.lit(0.6) * _mod("c_custkey", 1, 13) / F.lit(13.0)).alias("vuln_mult"),
    )


WARDS = """wards AS (SELECT c_custkey AS ward_id, c_name AS ward_name, c_nationkey AS city, c_nationkey + 1 AS ahs_code,
  17.5e0 + 4.5e0 * ((c_custkey * 37) % 997) / 997.0e0 AS lat, 81.5e0 + 1.7e0 * ((c_custkey * 53) % 991) / 991.0e0 AS lon,
  1000.0e0 + c_custkey * 17.0e0 AS population, (c_custkey % 23) * 0.7e0 AS elderly_pct,
  CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 31) * 1.1e0 END AS slum_pop_pct, (c_custkey % 11) / 11.0e0 AS built_up_frac,
  0.75e0 + 0.6e0 * (c_custkey % 13) / 13.0e0 AS vuln_mult FROM customer)"""


def deaths_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Survey rows as text from ``lineitem``: repeated keys, unknown days, three age columns."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    s = lambda c: c.cast("string")
    q = F.col("l_quantity").cast("int")
    return li.select(
        s(F.col("l_suppkey") % 30 + 1).alias("district"),
        s(F.col("l_orderkey")).alias("hl_id"),
        s(F.col("l_linenumber")).alias("house_no"),
        F.lit("1").alias("house_hold_no"),
        F.lit("1").alias("m_serial_no"),
        s(F.lit(1) + F.col("l_partkey") % 3).alias("year"),
        F.lit("1").alias("rural"),
        F.col("l_returnflag").alias("deceased_sex"),
        s(F.col("l_orderkey") % 33).alias("date_of_death"),
        F.when(F.col("l_orderkey") % 41 == 0, F.lit("na")).otherwise(s(F.month("l_shipdate"))).alias("month_of_death"),
        s(F.lit(2005) + F.col("l_suppkey") % 8).alias("year_of_death"),
        F.when(q < 5, s(q)).alias("age_of_death_below_one_month"),
        F.when((q >= 5) & (q < 10), s(q)).alias("age_of_death_below_eleven_month"),
        F.when(q >= 10, s(q * 2)).alias("age_of_death_above_one_year"),
        F.lit("2").alias("place_of_death"),
        s(F.rint("l_extendedprice").cast("int")).alias("wt"),
    )


DEATHS = """deaths_raw AS (SELECT (l_suppkey % 30 + 1)::INTEGER AS ahs_code, l_orderkey, l_linenumber, l_returnflag, l_suppkey, l_orderkey % 33 AS d,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE month(l_shipdate) END AS month, (2005 + l_suppkey % 8)::INTEGER AS year,
  l_quantity::INTEGER AS q, CASE WHEN l_quantity >= 10 THEN (l_quantity * 2)::INTEGER::VARCHAR END AS above,
  CASE WHEN l_quantity < 5 THEN l_quantity::INTEGER::VARCHAR END AS below1, CASE WHEN l_quantity >= 5 AND l_quantity < 10 THEN l_quantity::INTEGER::VARCHAR END AS below11,
  (1 + l_partkey % 3)::VARCHAR AS survey_round, round_even(l_extendedprice, 0)::INTEGER AS wt FROM lineitem),
ranked_deaths AS (SELECT *, row_number() OVER (PARTITION BY ahs_code, l_orderkey, l_linenumber, l_returnflag, d, month, year, above
  ORDER BY survey_round, below1 NULLS FIRST, below11 NULLS FIRST, wt::VARCHAR) AS rn FROM deaths_raw),
deaths AS (SELECT *, CASE WHEN q >= 10 THEN q * 2.0e0 WHEN q >= 5 THEN q / 12.0e0 ELSE q / 365.25e0 END AS age_years,
  CASE WHEN year BETWEEN 2007 AND 2011 AND month IS NOT NULL AND d BETWEEN 1 AND 31 THEN try_cast(year || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) END AS date
  FROM ranked_deaths WHERE rn = 1)"""


def deaths(spark: SparkSession, sf: str) -> DataFrame:
    from heatgrid.operators.mortality import clean_deaths

    return clean_deaths(deaths_raw(spark, sf))


# --- forecasts and alerts ------------------------------------------------------


def place_days(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts in long form: every panel day is lead k of the issue k rows earlier."""
    p = panel(spark, sf)
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("date")
    rows = p.withColumn("seq", F.row_number().over(w)).withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(5))))
    c, s, k = F.col("cell_id"), F.col("seq") - F.col("lead"), F.col("lead")
    h = F.lit(30.0) + (F.col("wbgt_max") - F.lit(24.0)) * F.lit(3.1)
    out = rows.where(s >= 1).select(
        F.date_add(F.lit("2024-01-01").cast("date"), s).alias("as_of"),
        F.when(c % 2 == 0, F.lit("ward")).otherwise(F.lit("district")).alias("scope"),
        c.cast("string").alias("place_id"),
        k.alias("lead"),
        F.date_add(F.lit("2024-01-01").cast("date"), s + k).alias("date"),
        h.alias("htsi"),
        (h - F.lit(5.0)).alias("q10"),
        (h + F.lit(5.0)).alias("q90"),
        (((c * 29 + s * 17 + k * 13) % 100) / F.lit(100.0)).alias("p_warning"),
        (((c * 31 + s * 7 + k * 5) % 100) / F.lit(100.0)).alias("p_watch"),
        scaling.stress_band(h).alias("band"),
        F.col("wbgt_max").alias("wbgt"),
        F.col("utci_max").alias("utci"),
        F.col("wbgt_night_min").alias("night_wbgt"),
        (F.greatest(h - F.lit(48.5), F.lit(-3.0)) * (c + 1) / F.lit(97.0)).alias("excess_deaths"),
        clip(h - F.lit(40.0), 0.0, 100.0).alias("mri"),
        F.concat(F.lit("Place "), c.cast("string")).alias("name"),
        F.when(c % 2 == 0, (c % 5).cast("string")).alias("city"),
        (c % 10 + 1).cast("string").alias("district"),
    )
    return out.withColumns({"excess_low": F.col("excess_deaths") * F.lit(0.5), "excess_high": F.col("excess_deaths") * F.lit(1.7), "ed_surge": F.col("excess_deaths") * F.lit(15.0)})


PLACE_DAYS = """seqs AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY date) AS seq, 30.0e0 + (wbgt_max - 24.0e0) * 3.1e0 AS h FROM panel),
place_days0 AS (SELECT a.cell_id AS c, a.seq AS s, k.k::INTEGER AS lead, b.h, b.wbgt_max, b.utci_max, b.wbgt_night_min
  FROM seqs a, (SELECT unnest(range(0, 6)) AS k) k, seqs b WHERE b.cell_id = a.cell_id AND b.seq = a.seq + k.k),
place_days AS (SELECT DATE '2024-01-01' + s::INTEGER AS as_of, CASE WHEN c % 2 = 0 THEN 'ward' ELSE 'district' END AS scope, c::VARCHAR AS place_id, lead,
  DATE '2024-01-01' + (s + lead)::INTEGER AS date, h AS htsi, h - 5.0e0 AS q10, h + 5.0e0 AS q90,
  ((c * 29 + s * 17 + lead * 13) % 100) / 100.0e0 AS p_warning, ((c * 31 + s * 7 + lead * 5) % 100) / 100.0e0 AS p_watch,
  CASE WHEN h >= 63.5e0 THEN 'Emergency' WHEN h >= 59.5e0 THEN 'Warning' WHEN h >= 48.5e0 THEN 'Watch' ELSE 'Normal' END AS band,
  wbgt_max AS wbgt, utci_max AS utci, wbgt_night_min AS night_wbgt, greatest(h - 48.5e0, -3.0e0) * (c + 1) / 97.0e0 AS excess_deaths,
  greatest(h - 48.5e0, -3.0e0) * (c + 1) / 97.0e0 * 0.5e0 AS excess_low, greatest(h - 48.5e0, -3.0e0) * (c + 1) / 97.0e0 * 1.7e0 AS excess_high,
  greatest(h - 48.5e0, -3.0e0) * (c + 1) / 97.0e0 * 15.0e0 AS ed_surge,
  least(greatest(h - 40.0e0, 0.0e0), 100.0e0) AS mri, 'Place ' || c AS name, CASE WHEN c % 2 = 0 THEN (c % 5)::VARCHAR END AS city, (c % 10 + 1)::VARCHAR AS district
  FROM place_days0)"""
