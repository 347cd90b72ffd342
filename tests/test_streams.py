"""Streams agree with the batch operators; late rows are left out; dispatch is once-only."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heatgrid.operators import alerts, climatology, daily, index, risk
from heatgrid.params import AlertParams
from heatgrid.streaming import alerts as alert_streams
from heatgrid.streaming import daily as daily_streams
from heatgrid.streaming import live

HOURLY = "cell_id int, ts_ist timestamp_ntz, t2m double, wbgt double, utci double"
DAY = "struct<lead: int, htsi: double, band: string, p_warning: double, p_watch: double, q10: double, q90: double>"


def land(df, path, name):
    df.coalesce(1).write.parquet(f"{path}/{name}")


def source(spark, schema, path, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).parquet(str(path))


def hourly_rows(n_days=4):
    rnd = random.Random(2)
    start = datetime(2024, 5, 1)
    return [(c, start + timedelta(hours=h), *(rnd.uniform(20, 36) for _ in range(3))) for c in (1, 2) for h in range(24 * n_days)]


def test_stream_equals_batch(spark, tmp_path):
    rows = hourly_rows()
    df = spark.createDataFrame(rows, HOURLY)
    for d in range(1, 5):
        land(df.where(F.dayofmonth("ts_ist") == d), tmp_path, f"d{d}")
    out = daily_streams.run_to_table(daily_streams.stream_daily(source(spark, HOURLY, tmp_path), ("t2m", "wbgt", "utci")), "daily")
    batch = daily.aggregate_daily(df, ("t2m", "wbgt", "utci")).where("date < '2024-05-04'")
    cols = ["cell_id", "date", "wbgt_max", "t2m_min", "wbgt_hours_above_30"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_late_rows_are_left_out(spark, tmp_path):
    import os
    import time

    df = spark.createDataFrame(hourly_rows(3), HOURLY)
    late = spark.createDataFrame([(1, datetime(2024, 5, 1, 12), 99.0, 99.0, 99.0)], HOURLY)
    after = spark.createDataFrame([(1, datetime(2024, 5, 6, 12), 20.0, 20.0, 20.0)], HOURLY)
    for i, part in enumerate((df, after, late)):
        land(part, tmp_path, f"p{i}")
        stamp = time.time() - 100 + 10 * i
        for root, _, files in os.walk(f"{tmp_path}/p{i}"):
            for f in files:
                os.utime(os.path.join(root, f), (stamp, stamp))
    stats = {}
    out = daily_streams.run_to_table(daily_streams.stream_daily(source(spark, HOURLY, tmp_path), ("t2m", "wbgt", "utci")), "late", stats)
    top = {str(r.date): r.wbgt_max for r in out.where("cell_id = 1").collect()}
    assert top["2024-05-01"] < 99.0 and len(top) == 3
    assert stats["late_rows"] == 1


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_levels_as_a_stream_equal_the_fold(spark, tmp_path, rocksdb):
    rnd = random.Random(4)
    cfg = AlertParams(lead_days=1, margin=1.0)
    band = lambda h: "Emergency" if h >= 63.5 else "Warning" if h >= 59.5 else "Watch" if h >= 48.5 else "Normal"
    rows = []
    for p in range(3):
        for i in range(25):
            hs = [rnd.uniform(35, 70) for _ in range(3)]
            rows.append((date(2024, 5, 1) + timedelta(days=i), "ward", str(p), [(k, h, band(h), 0.0, 0.0, h - 5, h + 5) for k, h in enumerate(hs)]))
    schema = f"as_of date, scope string, place_id string, days array<{DAY}>"
    df = spark.createDataFrame(rows, schema)
    for i, (a, b) in enumerate([("2024-05-01", "2024-05-09"), ("2024-05-10", "2024-05-17"), ("2024-05-18", "2024-05-31")]):
        land(df.where(F.col("as_of").between(a, b)), tmp_path, f"{i}")
    land(alert_streams.closing_day(df, 3), tmp_path, "end")
    out = daily_streams.run_to_table(alert_streams.stream_state(source(spark, schema, tmp_path, 1000), cfg, "3 days"), "levels")
    changes, rejected = alert_streams.split_outcomes(out)
    fold = alerts.transitions(alerts.run_state(alerts.target_level(df, cfg), cfg))
    got = sorted((r.place_id, r.date, r.from_level, r.to_level) for r in changes.collect())
    assert rejected.count() == 0 and max(r[1] for r in got) >= date(2024, 5, 23)  # the last days are there
    want = sorted((r.place_id, r.date, r["from"], r.to) for r in fold.collect())
    assert got == want and len(got) > 10


def test_a_late_emergency_still_raises_the_alert(spark, tmp_path, rocksdb):
    import os
    import time

    cfg = AlertParams(lead_days=1, margin=1.0)
    schema = f"as_of date, scope string, place_id string, days array<{DAY}>"
    row = lambda i, h, b: (date(2024, 5, 1) + timedelta(days=i), "ward", "1", [(0, h, b, 0.0, 0.0, h - 5, h + 5)])
    for n, files in enumerate([(0, 1, 2, 4, 5), (6, 7), (3,), (30,)]):
        land(spark.createDataFrame([row(i, *((70.0, "Emergency") if i == 3 else (30.0, "Normal"))) for i in files], schema), tmp_path, f"{n}")
        stamp = time.time() - 100 + 10 * n
        for root, _, names in os.walk(f"{tmp_path}/{n}"):
            for f in names:
                os.utime(os.path.join(root, f), (stamp, stamp))
    found = {}
    for lateness in ("10 days", "1 day"):
        out = daily_streams.run_to_table(alert_streams.stream_state(source(spark, schema, tmp_path), cfg, lateness), "late-levels")
        changes, rejected = alert_streams.split_outcomes(out)
        found[lateness] = [(str(r.date), r.to_level) for r in changes.orderBy("date", F.desc("level")).collect()], [tuple(r) for r in rejected.collect()]
    assert found["10 days"][0][0] == ("2024-05-04", "Emergency") and found["10 days"][1] == []
    assert found["1 day"] == ([], [("ward", "1", date(2024, 5, 4), "Emergency", 3)])


class Place:
    """State of one place, held in memory as a processor sees it, with its timers; counts how often it is woken."""

    def __init__(self):
        self.timers, self.woken, self.watermark = set(), 0, 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    def getValueState(self, name, schema):
        return State()

    getListState = getValueState

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def advance(self, processor, day):
        self.watermark = day * alert_streams.DAY_MS
        out = []
        for at in sorted(t for t in self.timers if t <= self.watermark):
            self.timers.discard(at)
            self.woken += 1
            out += [tuple(r) for pdf in processor.handleExpiredTimer(("ward", "1"), self, None) for r in pdf.itertuples(index=False)]
        return out


class State:
    def __init__(self):
        self.clear()

    def clear(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def update(self, value):
        self.held = [value]

    def appendValue(self, value):
        self.held.append(value)

    def appendList(self, values):
        self.held += values

    def get(self):
        return iter(self.held) if not self.held or len(self.held) > 1 or isinstance(self.held[0][0], bytes) else self.held[0]


def test_a_place_is_woken_once_however_many_days_wait():
    import pandas as pd

    cfg = AlertParams(lead_days=1, margin=1.0)
    rnd = random.Random(8)
    told = [(d, *rnd.choice([(0, 30.0), (1, 50.0), (2, 60.0), (3, 70.0), (0, None)])) for d in range(100, 160)]
    first, second = [x for x in told if x[0] % 3], [x for x in told if not x[0] % 3]
    moves, place, processor = [], Place(), alert_streams.LevelProcessor(cfg, alert_streams.BAND_EDGES)
    processor.init(place)
    for part in (first, second):
        rows = pd.DataFrame(part, columns=["day", "target_level", "htsi_today"])
        assert list(processor.handleInputRows(("ward", "1"), iter([rows[:7], rows[7:]]), place)) == []
    for day in (120, 121, 159):
        moves += place.advance(processor, day)
    want, level, since, below = [], 0, 100, 0
    for day, target, htsi in told:
        to, below = alert_streams.next_level(level, since, below, target, htsi, day, alert_streams.BAND_EDGES, cfg)
        if to != level:
            want.append((alert_streams.EPOCH + timedelta(days=day), to))
            level, since, below = to, day, 0
    assert [(r[2], r[5]) for r in moves] == want and len(want) > 5
    assert place.woken == 3 and not place.timers
    late = next(processor.handleInputRows(("ward", "1"), iter([pd.DataFrame([(159, 2, 60.0)], columns=["day", "target_level", "htsi_today"])]), place))
    assert late.to_numpy().tolist() == [["ward", "1", alert_streams.EPOCH + timedelta(days=159), None, "Warning", 2, "rejected"]]


def test_closing_an_empty_feed(spark):
    assert alert_streams.closing_day(spark.createDataFrame([], f"as_of date, scope string, place_id string, days array<{DAY}>"), 3).count() == 0


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    import os
    import time

    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        parts = [[(1, datetime(2024, 5, d), 20.0, 20.0, 20.0)] for d in (20, 21)] + [[(1, datetime(2024, 5, 1, i % 24), 20.0, 20.0, 20.0)] for i in range(12)]
        for i, rows in enumerate(parts):
            land(spark.createDataFrame(rows, HOURLY), tmp_path, f"p{i:02}")
            stamp = time.time() - 1000 + 10 * i
            for root, _, files in os.walk(f"{tmp_path}/p{i:02}"):
                for f in files:
                    os.utime(os.path.join(root, f), (stamp, stamp))
        stats = {}
        daily_streams.run_to_table(daily_streams.stream_daily(source(spark, HOURLY, tmp_path), ("t2m", "wbgt", "utci")), "many", stats)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert stats["late_rows"] == 12


def test_dispatch_owes_nothing_twice(spark, tmp_path):
    schema = "alert_id string, scope string, place_id string, city string, district string, level int, since date"
    a = spark.createDataFrame([("A", "ward", "1", "c", "9", 2, date(2024, 5, 1)), ("B", "ward", "2", "c", "9", 2, date(2024, 5, 2))], schema)
    subs = spark.createDataFrame([(1, 1, ["1"], None, ["c"])], "id long, min_level int, wards array<string>, districts array<string>, cities array<string>")
    log = tmp_path / "log"
    for i in range(2):
        land(a, tmp_path / "in", f"{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        alert_streams.dispatch_stream(stream, subs, str(log), str(tmp_path / f"ck{i}")).awaitTermination()
    rows = lambda: sorted((r.alert_id, r.subscription_id, r.status) for r in spark.read.schema(alert_streams.LOG).parquet(str(log)).collect())
    assert rows() == [("A", 1, "sent"), ("B", 1, "sent")]


def test_dispatch_reads_the_log_of_its_own_days_alone(spark, tmp_path):
    schema = "alert_id string, scope string, place_id string, city string, district string, level int, since date"
    subs = spark.createDataFrame([(1, 1, ["1"], None, None)], "id long, min_level int, wards array<string>, districts array<string>, cities array<string>")
    log = tmp_path / "log"
    spark.createDataFrame([("A", 1, "sent", date(2024, 5, 1)), ("F", 1, "failed", date(2024, 5, 1))], alert_streams.LOG).write.partitionBy("since").parquet(str(log))
    (log / "since=2020-01-01").mkdir()
    (log / "since=2020-01-01" / "old.parquet").write_text("an old day that cannot be read")
    land(spark.createDataFrame([(x, "ward", "1", None, "9", 2, date(2024, 5, 1)) for x in "AFN"], schema), tmp_path / "in", "0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    alert_streams.dispatch_stream(stream, subs, str(log), str(tmp_path / "ck")).awaitTermination()
    sent = spark.read.schema(alert_streams.LOG).parquet(str(log)).where("since = date'2024-05-01' AND status = 'sent'")
    assert sorted(r.alert_id for r in sent.collect()) == ["A", "F", "N"]


def live_inputs(spark):
    doys = range(1, 366)
    clim = spark.createDataFrame([(c, d, 26.0 + c, 30.0, 32.0, 34.0) for c in (1, 2, 3) for d in doys], "cell_id int, doy int, wbgt_max_p50 double, wbgt_max_p90 double, wbgt_max_p95 double, wbgt_max_p98 double")
    cells = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "cell_id int, ahs_code int")
    base = spark.createDataFrame([(a, d, 1e6 * a, 30.0 + a) for a in (1, 2) for d in doys], "ahs_code int, doy int, pop_now double, expected_deaths double")
    return clim, cells, base, spark.createDataFrame([(1, 1.0), (2, 1.2)], "ahs_code int, vuln_mult double")


@pytest.mark.parametrize("files", [2, 1000])
def test_live_payload_equals_the_batch_chain(spark, tmp_path, rocksdb, files):
    """Days with holes, cells without a district or a climatology, several batches and one."""
    import time

    rnd, cols = random.Random(6), ("t2m", "wbgt", "utci")
    start = datetime(2024, 5, 1)
    rows = [(c, start + timedelta(hours=h), *(rnd.choice([None, rnd.uniform(20, 36), rnd.uniform(20, 36)]) for _ in cols)) for c in (1, 2, 3, 4) for h in range(24 * 6) if rnd.random() < 0.7 and not (c == 2 and 48 <= h < 72)]
    df = spark.createDataFrame(rows, HOURLY)
    for d in range(1, 7):
        land(df.where(F.dayofmonth("ts_ist") == d), tmp_path, f"d{d}")
        time.sleep(0.05)
    land(spark.createDataFrame([(-1, datetime(2024, 5, 20), 1.0, 1.0, 1.0)], HOURLY), tmp_path, "end")
    clim, cells, base, vuln = live_inputs(spark)
    out = daily_streams.run_to_table(live.live_payload(source(spark, HOURLY, tmp_path, files), clim, cells, base, vuln, cols), "live")
    days = index.compute_index(climatology.attach_anomaly(daily.aggregate_daily(df, cols), clim)).join(cells, "cell_id")
    batch = risk.district_risk(days, base, vuln)
    names = [c for c in batch.columns if c != "date"]
    value = lambda df: [[r.date, *(None if r[c] is None else round(r[c], 9) for c in names)] for r in df.orderBy("ahs_code", "date").collect()]
    assert value(out) == value(batch) and out.count() == 12
    assert out.where("lag1 IS NOT NULL").count() == 10


def test_live_feed_uses_the_batch_projection(spark, tmp_path):
    import json

    n = 30
    doc = {"cell_id": 3, "lat": 20.0, "lon": 85.0, "hourly": {"time": [(datetime(2024, 5, 1) + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(n)], "temperature_2m": [30.0] * n, "dew_point_2m": [22.0] * n, "surface_pressure": [1000.0] * n, "wind_speed_10m": [2.0] * n, "shortwave_radiation": [300.0] * n}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    out = daily_streams.run_to_table(daily_streams.live_hourly(spark, str(tmp_path)), "live")
    from heatgrid.sources.weather import read_nwp

    batch = daily.hourly_indices(read_nwp(spark, str(tmp_path)))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
