"""Brute-force and metamorphic tests of the table operators."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatgrid.functions import scaling
from heatgrid.operators import climatology, features, index, mortality, nearest, places, ranking, risk, siting
from heatgrid.params import ExposureResponse

# --- order statistics with one value holding a third of the rows ---------------


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = [(i, 7.5 if i % 3 == 0 else round(rnd.gauss(0, 10), 1), i % 2) for i in range(900)]
    return spark.createDataFrame(rows, "id int, v double, g int").repartition(6), pd.DataFrame(rows, columns=["id", "v", "g"])


def test_exact_quantiles_match_numpy(spark, skewed):
    df, pdf = skewed
    got = ranking.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.973, 1.0], list("abcde"), by=["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g], np.quantile(part.v, [0.0, 0.1, 0.5, 0.973, 1.0]))


def test_ranks_match_pandas(spark, skewed):
    df, pdf = skewed
    got = ranking.with_rank_desc(df, "v").toPandas().set_index("id")["rank"].sort_index()
    assert (got.to_numpy() == pdf.v.rank(ascending=False, method="min").to_numpy()).all()
    mean = ranking.average_ranks(df, "v", "r").toPandas().set_index("v")["r"]
    assert np.allclose(pdf.v.map(mean), pdf.v.rank())


def test_auc_and_ap_by_hand(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z)
    assert ranking.roc_auc(df, "p", F.col("y") == 1).first().auc == pytest.approx(wins / 9)
    assert ranking.average_precision(df, "p", F.col("y") == 1).first().average_precision == pytest.approx((1 / 1 + 2 / 3 + 3 / 6) / 3)


def test_tiers_follow_qcut(spark, skewed):
    df, pdf = skewed
    distinct = pdf.drop_duplicates("v").sort_values("v")
    sdf = spark.createDataFrame(distinct[["id", "v"]])
    got = ranking.quantile_tiers(sdf, "v", list("abcde")).toPandas().set_index("id").tier
    want = pd.qcut(distinct.set_index("id").v, 5, labels=list("abcde")).astype(str)
    assert (got.loc[want.index] == want).all()


# --- nearest neighbours -----------------------------------------------------------


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(1)
    cells = [(i, 18 + rnd.random() * 4, 83 + rnd.random() * 4) for i in range(40)] + [(99, 30.0, 95.0)]
    points = [(i, 17 + rnd.random() * 6, 82 + rnd.random() * 6) for i in range(60)] + [(100, 29.0, 94.0), (101, 29.0, 94.0)]
    got = nearest.inverse_distance_weights(
        spark.createDataFrame(points, "ward_id int, lat double, lon double"), spark.createDataFrame(cells, "cell_id int, lat double, lon double")
    ).toPandas()
    k = math.cos(math.radians(20.5))
    for pid, lat, lon in points:
        d = sorted((math.hypot((x - lon) * k, y - lat), c) for c, y, x in cells)[:4]
        mine = got[got.ward_id == pid].sort_values(["distance", "cell_id"])
        assert list(mine.cell_id) == [c for _, c in d]
        w = np.array([1 / max(x, 1e-4) ** 2 for x, _ in d])
        assert np.allclose(mine.weight, w / w.sum())


def test_nearest_in_a_dense_spot(spark):
    rnd = random.Random(8)
    cells = [(i, 20 + rnd.random() * 0.01, 85 + rnd.random() * 0.01) for i in range(300)] + [(900 + i, 25.0 + i, 85.0) for i in range(4)]
    points = [(i, 20 + rnd.random() * 0.02, 85 + rnd.random() * 0.02) for i in range(20)] + [(50, 26.4, 85.3)]
    got = nearest.nearest_k(
        spark.createDataFrame(points, "ward_id int, lat double, lon double"), spark.createDataFrame(cells, "cell_id int, lat double, lon double"), 3, lon_scale=1.0
    ).toPandas()
    for _, lat, lon in points:
        want = [c for _, c in sorted((math.hypot(x - lon, y - lat), c) for c, y, x in cells)[:3]]
        assert list(got[(got.lat == lat) & (got.lon == lon)].sort_values("rank").cell_id) == want


def test_nearest_meets_few_targets_of_a_dense_city(spark):
    rnd = random.Random(18)
    cells = [(i, 20 + rnd.random() * 0.01, 85 + rnd.random() * 0.01, 1.0) for i in range(4000)] + [(9000 + i, 20.005, 85.005, 1.0) for i in range(300)] + [(9900 + i, 22.0 + i, 87.0, 1.0 + i) for i in range(6)]
    points = [(20 + 0.003 * i * i, 85 - 0.002 * i * i) for i in range(25)] + [(20.005, 85.005)]
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    df = spark.createDataFrame(cells, "cell_id int, lat double, lon double, size double")
    ps = spark.createDataFrame(points, "lat double, lon double")
    got = nearest.nearest_k(ps, df.mapInPandas(counted, df.schema), 5, lon_scale=0.9, scale="size").toPandas()
    assert reads.value == len(cells)
    for lat, lon in points:
        want = [c for _, c in sorted((math.sqrt(((x - lon) * 0.9) ** 2 + (y - lat) ** 2) / z, c) for c, y, x, z in cells)[:5]]
        assert list(got[(got.lat == lat) & (got.lon == lon)].sort_values("rank").cell_id) == want
    near, found = nearest.candidates(ps, df, 5, "cell_id", [], 0.9, "size")
    assert near.join(found, ["_level", "_y", "_x"]).count() < len(points) * 8 * nearest.LEAF
    assert found.where("_tlat = 20.005 AND _tlon = 85.005").count() == 5


# --- places -------------------------------------------------------------------------


def test_district_totals(spark):
    r = places.district_table(spark).agg(F.count("*"), F.sum("pop_2011"), F.sum("area_km2")).first()
    assert r[0] == 30 and r[1] == 41_974_218 and r[2] == 155_707


def test_spellings_resolve(spark):
    names = [
        ("KEONJHAR (KENDUJHAR)", 6), ("Kendujhar", 6), ("keonjhar", 6), ("NUAPARHA", 25), ("Nuapada", 25), ("SUBARNAPUR", 23), ("SONAPUR", 23),
        ("BALASORE", 8), ("Baleshwar", 8), ("Khordha_Bhubaneswar", 17), ("Angul", 15), ("377", 17), ("17", 17), ("jajpur", 13),
    ]
    df = spark.createDataFrame(names, "key string, want int")
    got = places.resolve_keys(df, "key", places.crosswalk(places.district_table(spark)))
    assert got.where("ahs_code <> want").count() == 0


@pytest.mark.parametrize("key", ["Atlantis", "31", "400"])
def test_unknown_key_stops_the_job(spark, key):
    df = spark.createDataFrame([(key,)], "key string")
    with pytest.raises(Exception, match="unresolvable"):
        places.resolve_keys(df, "key", places.crosswalk(places.district_table(spark))).collect()


def test_hole_filling(spark):
    rows = [(y * 3 + x, 20 + y * 0.25, 85 + x * 0.25, False, (y, x) != (1, 1)) for y in range(3) for x in range(3)]
    df = spark.createDataFrame(rows, "cell_id int, lat double, lon double, is_sea boolean, inside boolean")
    assert places.fill_holes(df).where("inside").count() == 9


# --- climatology ------------------------------------------------------------------------


def daily_frame(spark, days=800, cells=2, seed=2):
    rnd = random.Random(seed)
    start = date(2019, 1, 1)
    rows = [(c, start + timedelta(days=i), rnd.uniform(20, 40)) for c in range(cells) for i in range(days) if rnd.random() > 0.1]
    return spark.createDataFrame(rows, "cell_id int, date date, wbgt_max double"), rows


def folded(d: date) -> int:
    n = d.timetuple().tm_yday
    leap = date(d.year, 12, 31).timetuple().tm_yday == 366
    return n - 1 if leap and n > 59 else n


def test_climatology_matches_brute_force(spark):
    df, rows = daily_frame(spark)
    got = climatology.build_climatology(df, ("wbgt_max",)).toPandas().set_index(["cell_id", "doy"])
    assert len(got) == 730
    for cell, doy in [(0, 1), (0, 60), (1, 59), (1, 365), (0, 200)]:
        near = {(doy - 1 + o) % 365 + 1 for o in range(-15, 16)}
        pool = [v for c, d, v in rows if c == cell and folded(d) in near]
        assert np.allclose(got.loc[(cell, doy)], np.percentile(pool, [50, 90, 95, 98]))


def test_climatology_ignores_row_order(spark):
    df, _ = daily_frame(spark, 400)
    a = climatology.build_climatology(df, ("wbgt_max",)).orderBy("cell_id", "doy").collect()
    b = climatology.build_climatology(df.orderBy(F.rand(3)).repartition(5), ("wbgt_max",)).orderBy("cell_id", "doy").collect()
    assert a == b


def test_leap_day_folds_onto_28_february(spark):
    from heatgrid.functions.calendar import leap_folded_doy

    df = spark.createDataFrame([(date(2024, 2, 28),), (date(2024, 2, 29),), (date(2024, 3, 1),), (date(2023, 3, 1),), (date(2024, 12, 31),)], "d date")
    assert [r[0] for r in df.select(leap_folded_doy("d")).collect()] == [59, 59, 60, 60, 365]


def test_spells_reset(spark):
    hot = [1, 1, 0, 1, 1, 1, 0]
    df = spark.createDataFrame([(1, date(2024, 1, 1) + timedelta(days=i), bool(h)) for i, h in enumerate(hot)], "cell_id int, date date, hot boolean")
    got = [r.spell_days for r in climatology.spell_length(df, F.col("hot")).orderBy("date").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 0]


def test_index_of_a_mild_day_is_gated(spark):
    row = [(1, date(2024, 1, 1), 26.0, 25.0, 99.0, 34.0, 15.0)]
    df = spark.createDataFrame(row, "cell_id int, date date, wbgt_max double, wbgt_max_p90 double, wbgt_max_pct_rank double, utci_max double, wbgt_night_min double")
    r = index.compute_index(df).first()
    assert r.htsi_anomaly == 0.0 and r.htsi_duration == 0.0 and r.htsi_band == "Normal"
    assert r.htsi == pytest.approx(0.5 * r.htsi_intensity)


# --- risk -------------------------------------------------------------------------------


def rr(spark, lags, v=1.0, which="central"):
    c = ExposureResponse()
    cols = [F.lit(x) for x in lags]
    return spark.range(1).select(scaling.relative_risk(scaling.lagged_log_risk(cols, c, which), F.lit(v)).alias("r")).first().r


def test_risk_curve_anchors(spark):
    c = ExposureResponse()
    assert rr(spark, [c.reference] * 4) == pytest.approx(1.20)
    assert rr(spark, [c.threshold - 1] * 4) == 1.0
    assert rr(spark, [c.reference] * 4, which="low") < rr(spark, [c.reference] * 4) < rr(spark, [c.reference] * 4, which="high")
    assert rr(spark, [500.0] * 4) == pytest.approx(c.max_rr)
    assert rr(spark, [c.reference, None, None, None]) < rr(spark, [c.reference] * 4)


def test_mortality_index_scale(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (1.25,), (5.0,)], "rr double")
    assert [r[0] for r in df.select(scaling.mortality_risk_index("rr")).collect()] == [0.0, 0.0, 50.0, 100.0]


def test_lag_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        ExposureResponse(lag_weights=(0.5, 0.2))


def test_payload_falls_back_to_the_default(spark):
    df = spark.createDataFrame([(date(2024, 5, 1), 1), (date(2024, 5, 2), 2)], "as_of date, x int")
    assert [r.x for r in risk.payload_as_of(df, "2024-05-02", "2024-05-01").collect()] == [2]
    assert [r.x for r in risk.payload_as_of(df, "2030-01-01", "2024-05-01").collect()] == [1]


def test_dedupe_keeps_one_of_many_copies(spark):
    rows = [("a", str(i % 3), i) for i in range(300)] + [("b", "9", 1)]
    df = spark.createDataFrame(rows, "k string, survey string, x int").repartition(5)
    got = mortality.dedupe_first(df, ["k"], ["survey"]).orderBy("k").collect()
    assert [(r.k, r.survey, r.x) for r in got] == [("a", "0", 0), ("b", "9", 1)]


def test_dedupe_equals_a_plain_sort(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", str(rnd.randrange(200))]), rnd.choice([None, "x", "y"]), rnd.choice("123"), rnd.choice([None, 1, 2])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, l string, survey string, x int").repartition(5)
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0)):
        first.setdefault(r[:2], r)
    out = mortality.dedupe_first(df, ["k", "l"], ["survey"])
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, first.values()))


def test_dedupe_does_not_sort_rows_that_stand_alone(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("t").alias("survey"))
    plan = mortality.dedupe_first(df, ["k"], ["survey"])._jdf.queryExecution().executedPlan().toString()
    alone = plan.split("SortAggregate")[0]
    assert "LeftAnti" in alone and "Sort " not in alone


def test_features_know_nothing_ahead(spark):
    df, _ = daily_frame(spark, 120, 1)
    base = df.withColumns({"htsi": F.col("wbgt_max"), "utci_max": F.col("wbgt_max"), "t2m_max": F.col("wbgt_max"), "wbgt_night_min": F.col("wbgt_max"), "spell_days": F.lit(0), "wbgt_max_p90": F.lit(30.0), "lat": F.lit(20.0), "lon": F.lit(85.0)})
    means = climatology.climatology_means(base, "2030-01-01")
    cut = date(2019, 3, 15)
    cols = [c for c in features.feature_columns() if c != "clim_p90_target"]
    full = features.build_features(base, means, 2).where(F.col("date") <= F.lit(cut)).select("date", *cols).orderBy("date").collect()
    past = features.build_features(base.where(F.col("date") <= F.lit(cut)), means, 2).select("date", *cols).orderBy("date").collect()
    assert full == past and len(cols) == 43


# --- siting -------------------------------------------------------------------------------


def cover(spark, wards, n, radius):
    w = spark.createDataFrame(wards, "city string, ward_id string, lat double, lon double, demand double").withColumn("excess", F.col("demand"))
    return (*siting.cooling_plan(w, n, radius), w)


def test_largest_demand_is_served_first(spark):
    wards = [("c", "a", 20.0, 85.0, 1.0), ("c", "b", 20.001, 85.0, 1.0), ("c", "z", 20.1, 85.1, 5.0)]
    chosen, _, _ = cover(spark, wards, 1, 0.5)
    assert [r.site_id for r in chosen.collect()] == ["z"]
    chosen, covered, w = cover(spark, wards, 2, 0.5)
    assert siting.cover_summary(chosen, covered, w).first().covered_demand_share == 1.0


def test_never_more_centres_than_asked_or_sites(spark):
    wards = [("c", str(i), 20 + i * 0.1, 85.0, 1.0) for i in range(5)]
    assert cover(spark, wards, 3, 1.0)[0].count() == 3
    assert cover(spark, wards, 9, 1.0)[0].count() == 5


def test_only_touched_sites_are_summed_again(spark):
    """Far groups of wards: a round looks at the pairs of one group, not at all."""
    rnd = random.Random(2)
    wards = [("c", f"{g:02d}{i}", 20 + g * 0.2 + rnd.random() * 0.002, 85.0, float(rnd.randint(1, 50))) for g in range(20) for i in range(8)]
    w = spark.createDataFrame(wards, "city string, ward_id string, lat double, lon double, demand double")
    pairs = siting.coverage_pairs(w, w, 1.0, site_id="ward_id")
    recomputed = []
    chosen, _ = siting.max_cover(pairs, w, 6, recomputed=recomputed)
    assert [r.site_id for r in chosen.orderBy("rank").collect()] == greedy(wards, 6, 1.0)
    assert recomputed[0] == 20 * 64 and all(n <= 64 for n in recomputed[1:]) and len(recomputed) == 6


def test_coverage_is_compressed_and_whole(spark):
    rnd = random.Random(5)
    spots = [(20 + rnd.random() * 0.02, 85 + rnd.random() * 0.02) for _ in range(12)]
    wards = [("c", f"{i:04d}", *rnd.choice(spots), 1.0) for i in range(400)]
    w = spark.createDataFrame(wards, "city string, ward_id string, lat double, lon double, demand double")
    pairs, members = siting.coverage(w, 1.0)
    assert pairs.count() <= 12 * 12 and members.count() == 400
    left, right = (members.select(F.col("spot").alias(f"{side}_spot"), F.col("ward_id").alias(side)) for side in ("site", "ward"))
    whole = pairs.join(left, "site_spot").join(right, "ward_spot").select("site", "ward")
    want = siting.coverage_pairs(w, w, 1.0, site_id="ward_id").select("site_id", "ward_id")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))
    assert pairs.agg(F.sum(F.col("n_sites") * F.col("n_wards"))).first()[0] == want.count()


def test_weights_meet_the_values_once_for_each_set_of_cells(spark):
    rnd = random.Random(9)
    cells = {f"w{i}": rnd.choice([(1, 2), (2, 3), (1, 4)]) for i in range(30)}
    weights = [(w, c, rnd.random()) for w, cs in cells.items() for c in cs] + [("w0", 2, 0.5), (None, 1, 1.0)]
    values = [(c, d, float(rnd.randint(0, 9)) if (c, d) != (1, 1) else None) for c in (1, 2, 3) for d in (0, 1)] + [(3, 0, 2.0)]
    w, v = spark.createDataFrame(weights, "ward_id string, cell_id int, weight double"), spark.createDataFrame(values, "cell_id int, d int, x double")
    points = spark.createDataFrame([(f"w{i}", i) for i in range(30) if i != 7] + [("w3", 99)], "ward_id string, area int")
    got = sorted((r.ward_id, r.d, r.area, None if r.x is None else round(r.x, 9)) for r in nearest.apply_weights(v, w, ["x"], ["d"], points=points).collect())
    want = []
    for ward, area in [(f"w{i}", i) for i in range(30) if i != 7] + [("w3", 99)]:
        own = [(c, f) for p, c, f in weights if p == ward]
        for d in (0, 1):
            met = [(f, x) for c, f in own for k, e, x in values if k == c and e == d]
            full = sum(x is not None for _, x in met) == len(own)
            if met:
                want.append((ward, d, area, round(sum(f * x for f, x in met), 9) if full else None))
    assert got == sorted(want, key=lambda r: r[:3])


def test_lags_shuffle_the_forecast_once(spark):
    f = spark.range(60).select(F.lit(date(2024, 1, 1)).alias("as_of"), (F.col("id") % 10).alias("place_id"), (F.col("id") / 10).cast("int").alias("lead"), F.col("id").cast("double").alias("htsi"))
    h = f.where("lead = 0").withColumn("lead", F.lit(-1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = risk.lead_lags(f, h)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {(r.place_id, r.lead): (r.lag0, r.lag1, r.lag2) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows[3, 0] == (3.0, 3.0, None) and rows[3, 2] == (23.0, 13.0, 3.0) and len(rows) == 60


def test_coverage_query_lists_every_pair_of_wards(spark, tmp_path):
    """Wards at one spot are pairs of their own: customers 10403 apart share a place."""
    from heatgrid.plans import alerting

    ids = [1, 2, 1 + 101 * 103, 1 + 2 * 101 * 103, 40]
    spark.createDataFrame([(k, "n", 3, 1.0) for k in ids], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = alerting.QUERIES["coverage_pairs"][0](spark, str(tmp_path))
    assert got.columns == ["city", "site_id", "ward_id", "distance_km"]
    rows = {(r.site_id, r.ward_id): r.distance_km for r in got.collect()}
    same = ids[0], ids[2], ids[3]
    assert all(rows[a, b] == 0.0 for a in same for b in same) and all((a, a) in rows for a in ids)
    assert all((b, a) in rows for a, b in rows) and got.count() == len(rows)


def greedy(wards, n, radius):
    def km(a, b):
        p = math.pi / 180
        h = math.sin((b[2] - a[2]) * p / 2) ** 2 + math.cos(a[2] * p) * math.cos(b[2] * p) * math.sin((b[3] - a[3]) * p / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    left, out = {w[1]: w[4] for w in wards}, []
    near = {s[1]: [w[1] for w in wards if km(s, w) <= radius] for s in wards}
    sites = sorted(near)
    for k in range(n):
        gains = [(-sum(left.get(w, 0) for w in near[s]), s) for s in sites]
        if not gains:
            break
        g, s = min(gains)
        if g >= 0 and k:
            break
        out.append(s)
        sites.remove(s)
        for w in near[s]:
            left.pop(w, None)
    return out


def test_cover_matches_plain_greedy_in_two_cities(spark):
    rnd = random.Random(9)
    wards = [(c, f"{c}{i:02d}", 20 + rnd.random() * 0.05, 85 + rnd.random() * 0.05, float(rnd.randint(1, 50))) for c in "xy" for i in range(25)]
    chosen, _, _ = cover(spark, wards, 4, 1.5)
    got = chosen.toPandas().sort_values("rank")
    for c in "xy":
        assert list(got[got.city == c].site_id) == greedy([w for w in wards if w[0] == c], 4, 1.5)


def test_copies_at_one_spot_are_covered_together(spark):
    wards = [("c", f"{i:03d}", 20.0, 85.0, 1.0) for i in range(50)] + [("c", "900", 20.2, 85.0, 30.0)]
    chosen, covered, w = cover(spark, wards, 2, 0.5)
    assert [(r.site_id, r.gain) for r in chosen.orderBy("rank").collect()] == [("000", 50.0), ("900", 30.0)]
    assert covered.count() == 51 and siting.cover_summary(chosen, covered, w).first().covered_wards == 51


def test_measures_combine_on_what_remains(spark):
    w = spark.createDataFrame([("c", "a", 10.0, 5.0, 20.0), ("c", "b", 10.0, 5.0, 20.0)], "city string, ward_id string, excess double, low double, high double")
    r = siting.counterfactual(w, w.where("ward_id = 'a'"), work_hours=True, advisories=True).first()
    assert r.baseline_excess == 20.0
    assert r.after_excess == pytest.approx(10 * 0.92 * 0.95 * (0.85 + 1))
    assert r.averted_excess == pytest.approx(20 - r.after_excess)


def test_coverage_pairs_meet_by_spot(spark, monkeypatch):
    """Sites of one spot are compared once, in groups; ids may repeat or be missing."""
    monkeypatch.setattr(siting, "HELD", 2)
    spots = [(20.0, 85.0), (20.0, 85.005), (20.2, 85.0), (None, 85.0)]
    rows = [("a" if i % 5 else None, None if i == 7 else i // 2, *spots[i % 4]) for i in range(40)]
    w = spark.createDataFrame(rows, "city string, ward_id long, lat double, lon double")
    got = siting.coverage_pairs(w, w, 1.0, site_id="ward_id")
    near = lambda x, y: x[0] == y[0] == "a" and None not in x[2:] and None not in y[2:] and x[2] == y[2] == 20.0 or x[2:] == y[2:] == (20.2, 85.0) and x[0] == y[0] == "a"
    want = sorted(((x[1], y[1]) for x in rows for y in rows if near(x, y)), key=str)
    assert sorted(((r.site_id, r.ward_id) for r in got.collect()), key=str) == want and len(want) > 200
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 2
