"""Published check values and physical invariants of the thermal indices."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heatgrid.functions import heat, psychro, radiation, solvers, utci
from heatgrid.operators import daily


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("t, e", [(0, 0.6112), (10, 1.2281), (20, 2.3393), (30, 4.2470), (40, 7.3849), (50, 12.352)])
def test_saturation_vapour_pressure(spark, t, e):
    assert one(spark, psychro.saturation_vapour_pressure(F.lit(float(t)))) == pytest.approx(e, rel=2e-3)


@pytest.mark.parametrize(
    "f, rh, hi", [(80, 40, 80), (84, 60, 88), (90, 40, 91), (90, 60, 100), (90, 80, 113), (96, 50, 108), (100, 40, 109), (104, 50, 131), (110, 40, 136)]
)
def test_heat_index_chart(spark, f, rh, hi):
    c = one(spark, heat.heat_index(F.lit((f - 32) * 5 / 9), F.lit(float(rh))))
    assert c * 9 / 5 + 32 == pytest.approx(hi, abs=2)


@pytest.mark.parametrize("t, r, v, rh, expected", [(30, 50, 1, 50, 35.5), (25, 25, 1, 50, 24.6), (40, 60, 2, 70, 55.8)])
def test_utci_published_values(spark, t, r, v, rh, expected):
    args = [F.lit(float(x)) for x in (t, r, v, rh)]
    assert one(spark, utci.utci(*args)) == pytest.approx(expected, abs=0.3)


def test_utci_responds_to_wind_and_radiation(spark):
    rows = spark.createDataFrame([(float(r), float(v)) for r in (30, 45, 60) for v in (1, 4, 9)], "r double, v double")
    got = {(x.r, x.v): x.u for x in rows.withColumn("u", utci.utci(F.lit(34.0), "r", "v", F.lit(50.0))).collect()}
    assert all(got[(30.0, v)] < got[(45.0, v)] < got[(60.0, v)] for v in (1.0, 4.0, 9.0))
    assert all(got[(r, 1.0)] > got[(r, 9.0)] for r in (45.0, 60.0))


def test_utci_weights_follow_the_degree_rule():
    assert len(utci.exponents()) == len(utci.load_weights()) == 210
    assert max(sum(e) for e in utci.exponents()) == 6


def test_wind_profile_and_floor(spark):
    assert one(spark, psychro.wind_at_height(F.lit(5.0))) == pytest.approx(5 * 0.72295, rel=1e-4)
    assert one(spark, psychro.wind_at_height(F.lit(0.0))) == 0.13


def test_dewpoint_round_trip(spark):
    df = spark.range(1, 400).select((F.col("id") % 50).cast("double").alias("t"), (F.col("id") % 97 + 3.0).alias("rh"))
    back = df.withColumn("td", psychro.dewpoint_from_rh("t", "rh")).withColumn("back", psychro.relative_humidity("t", "td"))
    assert back.agg(F.max(F.abs(F.col("back") - F.col("rh")))).first()[0] < 1e-6


def test_dewpoint_above_air_is_clamped(spark):
    assert one(spark, psychro.relative_humidity(F.lit(25.0), F.lit(27.0))) == pytest.approx(100.0)


def hours(spark, n=600, seed=3):
    rnd = random.Random(seed)
    start = datetime(2024, 4, 1)
    rows = [
        (i % 5, 20.0, 85.0, start + timedelta(hours=i), rnd.uniform(5, 48), rnd.uniform(-5, 32), rnd.uniform(0, 15), rnd.uniform(95, 102), rnd.uniform(0, 1100))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "cell_id int, lat double, lon double, ts_utc timestamp, T2M double, T2MDEW double, WS10M double, PS double, ALLSKY_SFC_SW_DWN double")
    return df.withColumn("ts_ist", (F.col("ts_utc") + F.expr("INTERVAL 330 MINUTES")).cast("timestamp_ntz"))


def test_random_weather_stays_physical(spark):
    out = daily.hourly_indices(hours(spark)).toPandas()
    cols = ["wbgt", "tg", "tnwb", "tmrt", "tmrt_globe", "utci", "heat_index", "wbgt_shade"]
    assert out[cols].notna().all().all()
    assert (out.tg >= out.t2m - 25).all() and (out.tg <= out.t2m + 60).all()
    assert (out.tnwb <= out.t2m + 4.001).all()
    assert out.rh.between(0, 100).all()


def test_indices_do_not_depend_on_partitioning(spark):
    h = hours(spark)
    key = ["cell_id", "ts_ist"]
    a = daily.hourly_indices(h.coalesce(1)).toPandas().sort_values(key).reset_index(drop=True)
    b = daily.hourly_indices(h.repartition(7, "T2M")).toPandas().sort_values(key).reset_index(drop=True)
    assert (a[["wbgt", "utci", "tmrt"]] - b[["wbgt", "utci", "tmrt"]]).abs().max().max() == 0.0


def test_missing_inputs_stay_missing(spark):
    h = hours(spark, 20).withColumn("T2M", F.when(F.col("cell_id") == 1, F.lit(float("nan"))).otherwise(F.col("T2M")))
    out = daily.hourly_indices(h).where("cell_id = 1").agg(*[F.count(c) for c in ("wbgt", "utci", "tg", "tmrt", "heat_index")]).first()
    assert list(out) == [0] * 5


def test_solver_survives_impossible_rows(spark):
    rows = [(60.0, 59.0, 0.0, 80.0, 1400.0, 1.0, 1.0), (-20.0, -40.0, 30.0, 110.0, 0.0, 0.0, 0.0), (45.0, 45.0, 0.13, 100.0, 1400.0, 0.01, 1.0), (30.0, -30.0, 0.0, 100.0, 900.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "t2m double, td double, ws double, ps double, ghi double, cosz double, direct_fraction double")
    ready = daily.with_radiation(df)
    out = ready.select(
        solvers.globe_temperature("t2m", "ws", "ps", "sw_globe", "emissivity").alias("g"),
        solvers.natural_wet_bulb("t2m", "td", "ws", "ps", "sw_wick", "emissivity", "vapour").alias("w"),
    ).toPandas()
    assert out.notna().all().all() and (out.abs() < 200).all().all()


def test_wind_cools_and_sun_heats_the_globe(spark):
    df = spark.createDataFrame([(float(s), float(w)) for s in (0, 400, 900) for w in (0.5, 3, 8)], "ghi double, ws double")
    full = df.withColumns({"t2m": F.lit(35.0), "td": F.lit(22.0), "cosz": F.lit(0.9), "direct_fraction": F.lit(0.7), "ps": F.lit(100.0)})
    got = daily.with_radiation(full).withColumn("g", solvers.globe_temperature("t2m", "ws", "ps", "sw_globe", "emissivity"))
    t = {(r.ghi, r.ws): r.g for r in got.collect()}
    assert all(t[(0.0, w)] < t[(400.0, w)] < t[(900.0, w)] for w in (0.5, 3.0, 8.0))
    assert t[(900.0, 0.5)] > t[(900.0, 3.0)] > t[(900.0, 8.0)] > 35.0


def test_standing_person_faces_less_of_a_high_sun(spark):
    df = spark.createDataFrame([(0.1,), (0.95,)], "c double").withColumn("f", radiation.projected_area_factor("c"))
    low, high = (r.f for r in df.orderBy("c").collect())
    assert high < 0.2 < low


def test_noon_sun_is_high_in_the_tropics(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 1, 6, 0), 900.0), (datetime(2024, 6, 1, 18, 0), 0.0)], "ts_utc timestamp, ghi double")
    rows = daily.with_sun(df.withColumns({"lat": F.lit(20.0), "lon": F.lit(85.0)})).orderBy("ts_utc").collect()
    assert rows[0].cosz > 0.97 and rows[1].cosz == 0.0
    assert 0.0 < rows[0].direct_fraction <= 1.0 and rows[1].dni == 0.0


def test_night_belongs_to_the_day_it_ends_on(spark):
    rows = [(1, datetime(2024, 5, 1, 23), 20.0), (1, datetime(2024, 5, 2, 3), 22.0), (1, datetime(2024, 5, 2, 12), 35.0), (1, datetime(2024, 5, 3, 12), 36.0)]
    h = spark.createDataFrame(rows, "cell_id int, ts_ist timestamp_ntz, wbgt double").withColumns({"t2m": F.col("wbgt"), "utci": F.col("wbgt")})
    out = {str(r.date): r.wbgt_night_min for r in daily.aggregate_daily(h, ("t2m", "wbgt", "utci")).collect()}
    assert out == {"2024-05-01": None, "2024-05-02": 20.0, "2024-05-03": None}
