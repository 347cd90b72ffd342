"""State-machine scenarios, texts and documents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heatgrid.functions import calendar, geo, text
from heatgrid.operators import alerts, serve
from heatgrid.params import AlertParams

EDGES = (48.5, 59.5, 63.5)
CFG = AlertParams(min_dwell_days=2, margin=3.0, lead_days=2, watch_lead_days=5, watch_probability=0.5)
DAY = "struct<lead: int, htsi: double, band: string, p_warning: double, p_watch: double, q10: double, q90: double>"
SCHEMA = f"as_of date, scope string, place_id string, days array<{DAY}>"


def band(h):
    return "Emergency" if h >= 63.5 else "Warning" if h >= 59.5 else "Watch" if h >= 48.5 else "Normal"


def days(hs, warning=(), watch=()):
    pad = lambda xs, k: float(xs[k]) if k < len(xs) else 0.0
    return [(k, float(h), band(h), pad(warning, k), pad(watch, k), h - 5.0, h + 5.0) for k, h in enumerate(hs)]


def frame(spark, sequence, place="p"):
    return spark.createDataFrame([(date(2024, 5, 1) + timedelta(days=i), "ward", place, d) for i, d in enumerate(sequence)], SCHEMA)


def target(spark, d, cfg=CFG):
    return alerts.target_level(frame(spark, [d]), cfg).first()


def run(spark, sequence, cfg=CFG):
    return alerts.run_state(alerts.target_level(frame(spark, sequence), cfg), cfg, EDGES).first()


def test_observed_band_rules_a_calm_forecast(spark):
    t = target(spark, days([60, 40, 40, 40, 40, 40]))
    assert (t.target_band, t.trigger_lead) == ("Warning", 0)


def test_tomorrows_warning_escalates_today(spark):
    t = target(spark, days([40, 61, 40, 40, 40, 40]))
    assert (t.target_band, t.trigger_lead) == ("Warning", 1) and "D+1" in t.reason


def test_far_leads_raise_a_watch_at_most(spark):
    assert target(spark, days([40, 40, 40, 64, 40, 40], [0, 0, 0, 0.3])).target_band == "Normal"
    t = target(spark, days([40, 40, 40, 64, 40, 40], [0, 0, 0, 0.7]))
    assert (t.target_band, t.trigger_lead) == ("Watch", 3)


def test_escalation_skips_levels(spark):
    r = run(spark, [days([40] * 6), days([66] + [40] * 5)])
    assert r.band == "Emergency"
    assert (r.transitions[0]["kind"], r.transitions[0]["from"]) == ("escalate", "Normal")


def test_a_level_holds_inside_the_margin(spark):
    assert run(spark, [days([h] + [40] * 5) for h in (61, 58, 57)]).level == 2


def test_levels_fall_one_step_at_a_time(spark):
    r = run(spark, [days([66] + [40] * 5)] + [days([30] * 6)] * 3)
    assert r.band == "Warning" and r.transitions[-1]["kind"] == "de-escalate"


def test_oscillation_does_not_flap(spark):
    r = run(spark, [days([h] + [40] * 5) for h in (61, 55) * 4])
    assert len(r.transitions) == 1


def test_transitions_carry_reason_and_trigger(spark):
    t = run(spark, [days([40, 62, 40, 40, 40, 40])]).transitions[0]
    assert t["reason"] and t["trigger"]["lead"] == 1 and t["date"] == date(2024, 5, 1)


def test_validated_probability_escalates(spark):
    cfg = AlertParams(min_dwell_days=2, margin=3.0, lead_days=2, thresholds={1: (0.25, 0.3), 2: (0.25, 0.3)})
    t = target(spark, days([40, 45, 40, 40, 40, 40], [0, 0.4]), cfg)
    assert (t.target_band, t.trigger_lead) == ("Warning", 1) and "validated trigger" in t.reason
    assert target(spark, days([40, 45, 40, 40, 40, 40], [0, 0.1], [0, 0.35]), cfg).target_band == "Watch"


def test_state_ignores_row_order(spark):
    seq = [days([h] + [40] * 5) for h in (61, 30, 30, 30, 62, 40, 30)]
    df = alerts.target_level(frame(spark, seq), CFG)
    a = alerts.run_state(df, CFG, EDGES).first()
    b = alerts.run_state(df.orderBy(F.rand(4)).repartition(3), CFG, EDGES).first()
    assert a == b


# --- messages ----------------------------------------------------------------------

DAY_ROW = ("A-1", "Puri", "Warning", 1, date(2024, 5, 30), 64.2, 35.4, 27.1, 0.42, 0.21, 0.71, 6.3)
DAY_COLS = "alert_id string, name string, band string, lead int, date date, htsi double, wbgt double, night_wbgt double, excess_deaths double, excess_low double, excess_high double, ed_surge double"
TEMPLATES = [
    (lang, b, f"{b} {lang}", "{level} for {place}", "{place} {day}: stress {htsi}", "{htsi} {day} {wbgt} {night} {excess} {excessLow}-{excessHigh}", "now", "next day", "on {date}")
    for lang in ("en", "hi", "or")
    for b in ("Normal", "Watch", "Warning", "Emergency")
]
AUDIENCES = [(lang, who, b, ["drink", "expect {ed} visits", "{nothing}rest"]) for lang in ("en", "hi", "or") for who in ("public", "hospitals") for b in ("Normal", "Watch", "Warning", "Emergency")]


def dictionaries(spark):
    cols = ["language", "band", "label", "headline", "sms", "description", "today", "tomorrow", "on_date"]
    return spark.createDataFrame(TEMPLATES, cols), spark.createDataFrame(AUDIENCES, ["language", "audience", "band", "actions"])


def advisory(spark, lang, who="public", **change):
    row = dict(zip([c.split()[0] for c in DAY_COLS.split(", ")], DAY_ROW)) | change
    a = spark.createDataFrame([tuple(row.values())], DAY_COLS)
    out = alerts.render_advisories(a, *dictionaries(spark))
    return out.where((F.col("language") == lang) & (F.col("audience") == who)).first()


def test_placeholders_are_filled(spark):
    for lang in ("en", "hi", "or"):
        a = advisory(spark, lang, "hospitals")
        assert not any("{" in s for s in (a.sms, a.headline, a.description, *a.actions[:2]))
    assert advisory(spark, "en").sms == "Puri next day: stress 64"
    assert advisory(spark, "en", "hospitals").actions[1] == "expect 6 visits"


def test_figures_are_written_out_before_languages_and_audiences(spark):
    row = dict(zip([c.split()[0] for c in DAY_COLS.split(", ")], DAY_ROW))
    a = spark.createDataFrame([tuple(row.values())] * 2, DAY_COLS)
    out = alerts.render_advisories(a, *dictionaries(spark))
    assert out.count() == 2 * 3 * 2  # alerts that repeat stay
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(lines) if "Join" in x]
    assert len(joins) == 2 and min(i for i, x in enumerate(lines) if "format_string(" in x) > max(joins)


def test_local_digits(spark):
    assert "୬୪" in advisory(spark, "or").sms
    assert "୨୦୨୪-୦୫-୩୦" in advisory(spark, "or", lead=3).description


def test_quiet_places_get_no_alert_text(spark):
    a = advisory(spark, "en", band="Normal")
    assert a.sms is None and a.headline is None and a.actions == []


def document(spark, mode="replay", name="A & B <Ward>"):
    a = spark.createDataFrame([DAY_ROW], DAY_COLS).withColumns(
        {"name": F.lit(name), "scope": F.lit("ward"), "place_id": F.lit("12"), "sent": F.lit("2024-05-29T06:00:00+05:30"), "q10": F.lit(58.1), "q90": F.lit(69.9), "mri": F.lit(31.5), "p_warning": F.lit(0.82)}
    ).withColumn("ring", geo.square_ring(F.lit(20.305), F.lit(85.805), 0.01))
    return alerts.alert_documents(a, alerts.render_advisories(a, *dictionaries(spark)), "x@example.org", "Sender", mode=mode).first().document


def test_document_is_well_formed_and_ordered(spark):
    doc = document(spark)
    root = ET.fromstring(doc.encode())
    ns = "{urn:oasis:names:tc:emergency:cap:1.2}"
    assert [c.tag.removeprefix(ns) for c in root][:8] == ["identifier", "sender", "sent", "status", "msgType", "scope", "note", "info"]
    assert len(root.findall(f"{ns}info")) == 3
    assert "<language>or-IN</language>" in doc and "<severity>Severe</severity>" in doc and "<polygon>20.30000,85.80000 " in doc
    assert "A &amp; B &lt;Ward&gt;" in doc


def test_live_documents_are_actual(spark):
    assert "<status>Exercise</status>" in document(spark) and "<status>Actual</status>" in document(spark, "live")


def test_masking_and_timestamps(spark):
    df = spark.createDataFrame([("+919876543210", datetime(2024, 5, 30, 6, 30))], "a string, t timestamp")
    r = df.select(text.mask_address("a").alias("m"), calendar.ist_iso("t").alias("t")).first()
    assert (r.m, r.t) == ("*********3210", "2024-05-30T12:00:00+05:30")


def test_messages_by_channel(spark):
    df = spark.createDataFrame([("whatsapp", "hi", ["a", "b"]), ("sms", "hi", ["a"])], "channel string, sms string, actions array<string>")
    assert sorted(r[0] for r in df.select(alerts.message_text(df)).collect()) == ["hi", "hi\n\n• a\n• b"]


def test_each_subscriber_gets_an_alert_once(spark):
    a = spark.createDataFrame([("A", "ward", "1", "c", "9", 2), ("B", "district", "9", None, "9", 1)], "alert_id string, scope string, place_id string, city string, district string, level int")
    s = spark.createDataFrame(
        [(1, 1, ["1"], None, ["c"]), (2, 3, ["1"], None, None), (3, 1, None, ["9"], None), (4, None, ["9"], None, None)],
        "id long, min_level int, wards array<string>, districts array<string>, cities array<string>",
    )
    m = alerts.match_subscriptions(a, s)
    assert sorted((r[0], r[1]) for r in m.collect()) == [("A", 1), ("B", 3)]
    log = spark.createDataFrame([("A", 1, "failed"), ("B", 3, "sent")], "alert_id string, subscription_id long, status string")
    assert [tuple(r) for r in alerts.undelivered(m, log).collect()] == [("A", 1)]


def test_worst_lead_prefers_the_earliest(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "ward", "1", k, date(2024, 1, 1), h, "x") for k, h in enumerate((50.0, 60.0, 60.0, 10.0, 99.0))], "as_of date, scope string, place_id string, lead int, date date, htsi double, band string")
    assert serve.worst_lead(df).first().lead == 1


def test_action_plan_covers_four_agencies(spark):
    rows = [("en", w, "Warning", ["x"]) for w in ("municipal", "hospitals", "power_utility", "schools", "public")]
    plan = alerts.action_plan(spark.createDataFrame(rows, ["language", "audience", "band", "actions"]), "Warning").first().plan
    assert set(plan) == {"municipal", "hospitals", "power_utility", "schools"}


@pytest.mark.parametrize("k, want", [(0, None), (1, 1), (2, 3), (3, 3), (4, 5), (5, 5)])
def test_explained_horizon(spark, k, want):
    assert spark.range(1).select(text.explained_horizon(F.lit(k)).alias("h")).first().h == want


def test_matches_are_not_shuffled_as_pairs(spark):
    """Alerts that meet a subscriber by ward and by city are one pair; nothing gathers the pairs after the join."""
    places = [("a1", "ward", "1", "9", None, 2), ("a2", "ward", "2", "9", None, 1), ("a3", "district", "5", None, "5", 3), ("a1", "ward", "1", "9", None, 3), ("a4", "ward", "7", None, None, 3)]
    wants = [(10, 1, ["1", "2"], None, ["9"]), (11, 3, ["1"], ["5"], ["9", "9"]), (11, 2, None, None, ["9"]), (12, None, None, ["5", None], None), (13, 1, ["7"], None, None), (None, 1, ["2"], None, None)]
    a = spark.createDataFrame(places, "alert_id string, scope string, place_id string, city string, district string, level int")
    s = spark.createDataFrame(wants, "id long, min_level int, wards array<string>, districts array<string>, cities array<string>")
    out = alerts.match_subscriptions(a, s)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join Inner")[0]
    want = set()
    for alert, scope, place, city, district, level in places:
        for i, least, wards, districts, cities in wants:
            met = (scope == "ward" and (place in (wards or []) or (city is not None and city in (cities or [])))) or (scope == "district" and district in (districts or []))
            if met and level >= (least or 1):
                want.add((alert, i))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_deliveries_meet_groups_of_subscribers(spark, monkeypatch):
    """What is owed comes from groups of subscribers: equal to the pairs less the log, and no pair is shuffled."""
    monkeypatch.setattr(alerts, "HELD", 3)
    a = spark.createDataFrame(
        [(f"A{i}", "ward" if i % 3 else "district", str(i % 4), str(i % 2), str(i % 3), i % 4) for i in range(12)] + [("A1", "ward", "9", "1", "0", 3), (None, "ward", "1", "0", "0", 2)],
        "alert_id string, scope string, place_id string, city string, district string, level int",
    )
    s = spark.createDataFrame(
        [(i, i % 4, [str(i % 4), str(i % 3)] if i % 2 else None, [str(i % 3)], [str(i % 2), None, "1"]) for i in range(40)] + [(None, 1, ["1"], ["0"], ["0"]), (3, 1, ["2"], None, ["1"])],
        "id long, min_level int, wards array<string>, districts array<string>, cities array<string>",
    )
    plain = lambda df: sorted(map(tuple, df.select("alert_id", "subscription_id").collect()), key=str)
    want = set()
    for r in a.collect():
        for p in s.collect():
            meets = (r.scope == "ward" and (r.place_id in (p.wards or []) or r.city in (p.cities or []))) or (r.scope == "district" and r.district in (p.districts or []))
            if meets and r.level >= p.min_level:
                want.add((r.alert_id, p.id))
    found = alerts.find_matches(a, s)
    pairs = plain(alerts.match_subscriptions(a, s))
    assert pairs == plain(found.pairs()) == sorted(want, key=str) and len(pairs) > 150
    log = spark.createDataFrame([(*p, "failed" if i % 6 == 0 else "sent") for i, p in enumerate(pairs) if i % 3 == 0], "alert_id string, subscription_id long, status string")
    owed = alerts.undelivered(found, log)
    gone = {p for i, p in enumerate(pairs) if i % 3 == 0 and i % 6 and None not in p}
    assert plain(owed) == plain(alerts.undelivered(alerts.match_subscriptions(a, s), log)) == [p for p in pairs if p not in gone]
    assert "array_except" in owed._jdf.queryExecution().optimizedPlan().toString()
    from heatgrid.streaming.alerts import deliveries

    sent = {(r.alert_id, r.subscription_id): r.sent for r in deliveries(log.unionByName(log)).collect()}
    assert sent == {(r.alert_id, r.subscription_id): 2 for r in log.collect()}
